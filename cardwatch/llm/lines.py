"""Line deduplication: repeated runs of lines by distributed prefix doubling over line ids.

All documents, in ascending id order, are one long sequence of lines. The rank of a line is the place
of its first equal; doubling pairs the rank of a place with the rank of the place 1, 2, 4, ... lines on
and ranks the pairs again by their first place, dropping places whose pair is unique, until runs are
``least`` lines long. A run whose rank is an earlier place that doesn't overlap it is a later copy. It
goes if it has ``least`` lines, one with a word at least, or at any step before that ``words`` words;
so a passage on one long line counts as well as one over many short lines. Copies that touch join into
maximal runs. The first copy of a run stays whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cardwatch.llm.common import numbered, quoted, spread_join, text_of, written

#: Lines of the shortest run that counts as repeated, and words that let a shorter one count.
LEAST, WORDS = 3, 50
#: A word of the contracts.
WORD = r"[^\x20\x09-\x0D]+"


def _ordered(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Rows (uid, id, text) and (uid, base, n): each row's lines take the places from ``base`` on.

    Places follow the id (a missing one first), then the text's hash. The rows are put in order by their
    ids and counts alone; only sums of ranges go through one line.
    """
    rows = numbered(docs.select(quoted(id_col).alias("id"), text_of(text_col).alias("text")), "line-rows", "uid")
    order = [F.col("id").asc_nulls_first(), F.col("h"), F.col("uid")]
    slim = rows.select("uid", "id", F.xxhash64("text").alias("h"), F.size(F.split("text", "\n")).alias("n"))
    ranged = written(slim.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "line-ranges")
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    parts = ranged.groupBy("part").agg(F.sum("n").alias("total")).withColumn(
        "first", F.coalesce(F.sum("total").over(before.orderBy("part")), zero))
    inner = F.coalesce(F.sum("n").over(before.partitionBy("part").orderBy(*order)), zero)
    based = ranged.withColumn("inner", inner).join(parts.drop("total"), "part")
    return rows, based.select("uid", (F.col("first") + F.col("inner")).alias("base"), "n")


def _ranked(pairs: DataFrame) -> DataFrame:
    """Places (at, left, w, x, y) whose pair (x, y) occurs twice or more, with rank, its first place."""
    first = pairs.groupBy("x", "y").agg(F.min("at").alias("rank"), F.count("*").alias("c")).where("c > 1")
    return written(spread_join(pairs, first.drop("c"), ["x", "y"]).select("at", "left", "w", "rank"), "line-ranks")


def _paired(ranks: DataFrame, step: int) -> DataFrame:
    """Pairs of the ranks of a place and of the place ``step`` lines on in the same row.

    ``w`` adds up; at the last step, where the two may overlap, it only tells whether there is a word.
    """
    on = ranks.select((F.col("at") - step).alias("at"), F.col("rank").alias("y"), F.col("w").alias("v"))
    here = ranks.where(F.col("left") > step).withColumnRenamed("rank", "x")
    return here.join(on, "at").select("at", "left", (F.col("w") + F.col("v")).alias("w"), "x", "y")


def _later(ranks: DataFrame, size: int, words: int) -> DataFrame:
    """(at, size) of the runs of ``size`` lines and ``words`` words that have an earlier copy beside them."""
    return ranks.where((F.col("rank") + size <= F.col("at")) & (F.col("w") >= words)).select(
        "at", F.lit(size).cast("long").alias("size"))


def repeated_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST,
                  words: int = WORDS) -> tuple[DataFrame, DataFrame]:
    """Rows (uid, id, text) and their later copies (uid, first, size): maximal runs of lines that go."""
    rows, based = _ordered(docs, id_col, text_col)
    based = written(based, "line-bases")
    # A row of fewer lines than a run and fewer letters than so many words can't hold either.
    parts = F.split("text", "\n")
    able = rows.where((F.size(parts) >= least) | (F.length("text") >= 2 * words - 1))
    lines = able.select("uid", F.posexplode(parts).alias("i", "line")).select(
        "uid", "i", F.regexp_count("line", F.lit(WORD)).cast("long").alias("w"),
        F.xxhash64("line").alias("x"), F.xxhash64(F.lit(1), "line").alias("y"))
    places = written(lines.join(based, "uid").select(
        "uid", "i", (F.col("base") + F.col("i")).alias("at"), (F.col("n") - F.col("i")).alias("left"), "w", "x", "y"),
        "line-places")
    ranks, size, copies = _ranked(places.drop("uid", "i")), 1, None
    while True:
        found = _later(ranks, size, words if size < least else 1)
        copies = found if copies is None else copies.unionByName(found)
        if size >= least:
            break
        step = min(size, least - size)
        ranks, size = _ranked(_paired(ranks, step)), size + step
    return rows, _joined(places.select("uid", "i", "at").join(copies, "at"))


def _joined(found: DataFrame) -> DataFrame:
    """(uid, first, size) of maximal runs from runs (uid, i, size) of lines that touch or overlap."""
    line = Window.partitionBy("uid").orderBy("i", "size")
    end = F.max(F.col("i") + F.col("size")).over(line.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.coalesce((F.col("i") > end).cast("int"), F.lit(0))
    run = found.withColumn("fresh", fresh).withColumn("run", F.sum("fresh").over(line))
    return run.groupBy("uid", "run").agg(
        F.min("i").cast("long").alias("first"), F.max(F.col("i") + F.col("size")).alias("stop")).select(
        "uid", "first", (F.col("stop") - F.col("first")).alias("size"))


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                        least: int = LEAST, words: int = WORDS) -> DataFrame:
    """(doc_id, n_lines, n_removed, n_runs, kept) of every row; ``kept`` is the text without later copies.

    Lines end at a newline; blank ones count, but a run of blank ones alone stays; null is one empty line, as is the empty text; of repeated
    rows all but the first lose their runs; an empty table gives an empty result.
    """
    rows, runs = repeated_runs(docs, id_col, text_col, least, words)
    runs = runs.groupBy("uid").agg(F.sum("size").alias("n_removed"), F.count("*").alias("n_runs"),
                                   F.sort_array(F.collect_list(F.struct("first", "size"))).alias("runs"))
    lines = F.split("text", "\n")
    gone = F.flatten(F.transform("runs", lambda r: F.sequence(r["first"], r["first"] + r["size"] - 1)))
    marked = F.array_except(F.sequence(F.lit(0).cast("long"), F.size(lines).cast("long") - 1), gone)
    kept = F.array_join(F.transform(marked, lambda i: F.element_at(lines, (i + 1).cast("int"))), "\n")
    zero = F.lit(0).cast("long")
    # Texts are joined by the same plan at every size: neither side has a proven bound.
    return rows.join(runs.hint("merge"), "uid", "left").select(
        F.col("id").alias("doc_id"), F.size(lines).cast("long").alias("n_lines"),
        F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_runs", zero).alias("n_runs"),
        F.when(F.col("runs").isNull(), F.col("text")).otherwise(kept).alias("kept"))


def line_report(docs: DataFrame) -> DataFrame:
    """The lines of every row, with the digest of what stays; see :func:`drop_repeated_lines`."""
    return drop_repeated_lines(docs).select(
        "doc_id", "n_lines", "n_removed", "n_runs", F.sha2("kept", 256).alias("kept_sha256"))
