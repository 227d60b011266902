"""Exact duplicates by distributed MSD radix partitioning.

Every text is a string of UTF-8 bytes. A round splits each open group by the next run of
bytes (the digit): a group is one (group, digit) pair, found by a combined aggregation. Groups
of one row leave at once, groups whose texts have ended are copies, and the others go on with
the following digit. Digits grow fourfold, so a text of n bytes takes about log4(n) rounds.
Equality is equality of bytes; no digest is involved.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardwatch.llm.common import SPACE, numbered, quoted, text_of, written

FIRST_DIGIT, GROWTH = 64, 4


def radix_groups(rows: DataFrame, body: str = "_body", uid: str = "_uid") -> DataFrame:
    """(uid, group) of each row whose ``body`` equals that of another row.

    ``rows`` is a written table with a binary ``body`` and a unique ``uid``; the label of a
    group is its smallest uid.
    """
    offset, width = 0, FIRST_DIGIT
    open_rows, bodies, closed = None, rows.select(uid, body), []
    while True:
        digit = F.substring(body, offset + 1, width).alias("_digit")
        ended = (F.octet_length(body) <= offset + width).alias("_ended")
        keyed = bodies.select(uid, digit, ended)
        if open_rows is None:
            keyed = keyed.withColumn("_group", F.lit(0).cast("long"))
        else:
            keyed = keyed.join(open_rows, uid)
        keys = ["_group", "_digit", "_ended"]
        groups = (keyed.groupBy(*keys).agg(F.count("*").alias("_n"), F.min(uid).alias("_next"))
                  .where("_n > 1"))
        split = written(keyed.join(groups, keys).select(uid, F.col("_next").alias("_group"), "_ended"),
                        "radix-round")
        closed.append(split.where("_ended").select(uid, "_group"))
        open_rows = split.where(~F.col("_ended")).select(uid, "_group")
        if open_rows.isEmpty():
            break
        if offset == 0:  # from here on only the rows that share their first digit are read
            bodies = written(bodies.join(open_rows.select(uid), uid, "left_semi"), "radix-open")
        offset, width = offset + width, width * GROWTH
    out = closed[0]
    for part in closed[1:]:
        out = out.unionByName(part)
    return out


def exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, keep_id, group_size, kept, text_sha256) of each row of ``docs``, ``row`` with all its columns.

    Texts are equal when they are after each run of white space became one blank; null counts as
    empty. The row with the smallest id stays; a missing id sorts last, and of rows with equal
    text and id one stays. An empty table gives an empty result.
    """
    norm = F.regexp_replace(text_of(text_col), SPACE + "+", " ")
    rows = numbered(docs.select(F.struct(*[quoted(c) for c in docs.columns]).alias("row"),
                                quoted(id_col).alias("_id"), norm.cast("binary").alias("_body"),
                                F.sha2(norm, 256).alias("text_sha256")), "radix-rows")
    member = radix_groups(rows)
    member = written(member.join(rows.select("_uid", "_id"), "_uid"), "radix-members")
    order = F.struct(F.col("_id").isNull().alias("no_id"), F.col("_id").alias("id"),
                     F.col("_uid").alias("uid"))
    groups = member.groupBy("_group").agg(F.count("*").alias("_size"), F.min(order).alias("_first"))
    labels = member.join(groups, "_group").select(
        "_uid", "_size", F.col("_first.id").alias("_keep"), F.col("_first.uid").alias("_keep_uid"))
    single = F.col("_size").isNull()
    return rows.drop("_body").join(labels, "_uid", "left").select(
        "row", F.when(single, F.col("_id")).otherwise(F.col("_keep")).alias("keep_id"),
        F.coalesce("_size", F.lit(1).cast("long")).alias("group_size"),
        (single | (F.col("_keep_uid") == F.col("_uid"))).alias("kept"), "text_sha256")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of every row of ``docs``."""
    slim = docs.select(quoted(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    return exact_copies(slim).select("row.doc_id", "keep_id", "group_size", "kept", "text_sha256")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with their columns unchanged."""
    return exact_copies(docs, id_col, text_col).where("kept").select("row.*")
