"""Secret scan with an incremental blob ledger, in DataFrame functions only.

Texts are addressed by their SHA-256 (a blob); a rule is addressed by its name and version. The
ledger, a table in the shared folder, holds the spans of every (blob, rule, version) scanned so
far, an empty list included. A scan reads one text of each blob that lacks a pair, appends the
missing pairs, and joins the ledger back to every document that carries the blob.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType
from pyspark.sql.window import Window

from cardwatch.llm.common import quoted, release, text_of, written
from cardwatch.session import scratch_path


@dataclass(frozen=True)
class Rule:
    """A pattern; a match counts if ``group`` of it has ``least`` characters or more."""

    name: str
    pattern: str
    group: int = 0
    least: int = 1
    version: str = "1"


# The rules of the contract. Runs of hex digits and access keys are greedy, so
# their least length can be part of the pattern; a short assignment still uses up its text.
RULES = (
    Rule("assign", r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?"
         r"([A-Za-z0-9+/_.=-]+)", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)

#: What a removed secret leaves in the text.
MARK = "[SECRET]"

LEDGER = StructType([
    StructField("blob", StringType()),
    StructField("rule", StringType()),
    StructField("version", StringType()),
    StructField("spans", ArrayType(StructType([
        StructField("start", LongType()), StructField("end", LongType())]))),
])


def open_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger at ``path``, created empty if it isn't there."""
    try:
        return spark.read.schema(LEDGER).parquet(path)
    except Exception as error:  # the reader's error for an absent path
        if "PATH_NOT_FOUND" not in str(error):
            raise
    spark.createDataFrame([], LEDGER).write.parquet(path)
    return spark.read.schema(LEDGER).parquet(path)


def _lengths(rule: Rule):
    """Lengths of the text between matches, of the matches, and of the group that is measured."""
    p, text = F.lit(rule.pattern), F.col("text")
    sizes = lambda a: F.transform(a, lambda x: F.length(x).cast("long"))
    zipped = F.arrays_zip(sizes(F.split(text, rule.pattern, -1)).alias("gap"),
                          sizes(F.regexp_extract_all(text, p, F.lit(0))).alias("hit"),
                          sizes(F.regexp_extract_all(text, p, F.lit(rule.group))).alias("part"))
    return F.when(F.rlike(text, p), zipped)


def scan_blobs(todo: DataFrame, rules=RULES) -> DataFrame:
    """(blob, rule, spans) of the matches in ``todo`` (blob, text, pending rule names).

    Offsets are code points, the end exclusive. A match starts behind all earlier gaps and matches.
    """
    found = F.array(*[
        F.struct(F.lit(r.name).alias("rule"), F.lit(r.least).alias("least"),
                 F.when(F.array_contains("pending", r.name), _lengths(r)).alias("m"))
        for r in rules])
    each = (todo.select("blob", F.explode(found).alias("f")).where("f.m is not null")
            .select("blob", "f.rule", "f.least", F.posexplode("f.m").alias("i", "m")))
    line = Window.partitionBy("blob", "rule").orderBy("i")
    ends = each.withColumn(
        "end", F.sum(F.col("m.gap") + F.coalesce("m.hit", F.lit(0))).over(line))
    hits = ends.where("m.hit is not null and m.part >= least").select(
        "blob", "rule", F.struct((F.col("end") - F.col("m.hit")).alias("start"), "end").alias("s"))
    return hits.groupBy("blob", "rule").agg(F.sort_array(F.collect_set("s")).alias("spans"))


def update_ledger(docs: DataFrame, path: str, rules=RULES) -> DataFrame:
    """Scan what the ledger lacks of ``docs`` (blob, text); returns the ledger's current pairs.

    One text of each blob is scanned, whatever rows carry it: copies are put together before the shuffle.
    """
    spark = docs.sparkSession
    wanted = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(r.version).alias("version"))
                       for r in rules])
    blobs = docs.select("blob").distinct()
    pairs = blobs.select("blob", F.explode(wanted).alias("p")).select("blob", "p.*")
    unseen = pairs.join(open_ledger(spark, path), ["blob", "rule", "version"], "left_anti")
    unseen = written(unseen, "ledger-unseen")
    pending = unseen.groupBy("blob").agg(F.collect_set("rule").alias("pending"))
    todo = docs.dropDuplicates(["blob"]).join(pending, "blob").select("blob", "text", "pending")
    found = scan_blobs(todo, rules)
    fresh = unseen.join(found, ["blob", "rule"], "left").select(
        "blob", "rule", "version",
        F.coalesce("spans", F.array().cast(LEDGER["spans"].dataType)).alias("spans"))
    fresh.write.mode("append").parquet(path)
    release(docs)
    now = F.struct("rule", "version").isin([
        F.struct(F.lit(r.name), F.lit(r.version)) for r in rules])
    return open_ledger(spark, path).where(now)


def scan_documents(docs: DataFrame, ledger: str | None = None, id_col: str = "doc_id",
                   text_col: str = "text", rules=RULES) -> DataFrame:
    """(row, spans): each row of ``docs`` as a struct, and the sorted (start, kind, end) of its secrets.

    Null text counts as empty and has none; repeated rows are scanned once and each get the
    findings; an empty table scans nothing. ``kind`` is the rule's place in ``rules``. Without
    ``ledger`` a new one is begun in the shared folder.
    """
    path = ledger or scratch_path(docs.sparkSession, "ledger")
    blob = F.sha2(text_of(text_col), 256).alias("blob")
    known = update_ledger(docs.select(blob, text_of(text_col).alias("text")), path, rules)
    kind = F.array_position(F.array(*[F.lit(r.name) for r in rules]), F.col("rule")).cast("int") - 1
    hits = known.select("blob", kind.alias("kind"), F.explode("spans").alias("s"))
    by_blob = hits.groupBy("blob").agg(F.sort_array(F.collect_set(
        F.struct(F.col("s.start").alias("start"), "kind", F.col("s.end").alias("end")))).alias("spans"))
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    rows = docs.select(F.struct(*[quoted(c) for c in docs.columns]).alias("row"), blob)
    return rows.join(by_blob, "blob", "left").select("row", F.coalesce("spans", none).alias("spans"))


def secret_report(docs: DataFrame, ledger: str | None = None, rules=RULES) -> DataFrame:
    """Counts by kind and the spans of every document as text."""
    slim = docs.select(quoted("doc_id"), text_of("text").alias("text"))
    out = scan_documents(slim, ledger, rules=rules)
    names = F.array(*[F.lit(r.name) for r in rules])
    texts = F.transform("spans", lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string")))
    spans = F.concat_ws(",", texts)
    kinds = F.transform("spans", lambda s: s["kind"])
    others = [F.size(F.array_remove(kinds, F.lit(k))) for k in range(len(rules))]
    counts = [(F.size(kinds) - n).cast("long").alias(f"n_{r.name}") for n, r in zip(others, rules, strict=True)]
    return out.select("row.doc_id", *counts, F.sha2(spans, 256).alias("base_sha256"), spans.alias("spans"))


def redact(docs: DataFrame, ledger: str | None = None, id_col: str = "doc_id", text_col: str = "text",
           mark: str = MARK) -> DataFrame:
    """``docs`` with every found span replaced by ``mark``; overlapping spans become one.

    Columns stay as they are, but for the text of documents with findings.
    """
    out = scan_documents(docs, ledger, id_col, text_col)
    field = lambda c: F.col("row").getField(c)
    text = field(text_col)
    zero = F.struct(F.lit("").alias("done"), F.lit(0).cast("long").alias("at"))

    def step(acc, s):
        gap = F.substring(text, acc["at"].cast("int") + 1, (s["start"] - acc["at"]).cast("int"))
        grown = F.struct(F.concat(acc["done"], gap, F.lit(mark)).alias("done"), s["end"].alias("at"))
        inside = F.struct(acc["done"].alias("done"), F.greatest(acc["at"], s["end"]).alias("at"))
        return F.when(s["start"] < acc["at"], inside).otherwise(grown)

    rest = lambda a: F.concat(a["done"], F.substr(text, (a["at"] + 1).cast("int")))
    clean = F.when(F.size("spans") == 0, text).otherwise(F.aggregate("spans", zero, step, rest))
    return out.select(*[(clean if c == text_col else field(c)).alias(c) for c in docs.columns])
