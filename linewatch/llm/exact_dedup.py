"""Exact duplicates: rows grouped by a 128-bit content hash, their bytes compared inside groups.

Only hashes are shuffled for all rows. Texts travel for the members of groups with two or more rows, to be compared with the
text of one row of their group; a hash shared by different texts therefore splits into one class per text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linewatch.llm.common import text_bytes, written
from linewatch.session import materialise


def exact_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", hash_bits: int = 128
) -> DataFrame:
    """``(doc_id, keep_id, group_size, kept, text_sha256)``, one row per input row.

    Texts are equal when their bytes are; null counts as empty. ``keep`` names the row that stays, "smallest" or "largest" id.
    Rows that repeat the kept id are all flagged as kept. A row without an id is never preferred to one with an id; a group
    of such rows has a null ``keep_id`` and keeps them. ``hash_bits`` below 128 is for tests of collisions. Other columns are
    not read; an empty table gives an empty result.

    A group may hold any share of the rows: groups are counted with map-side combine, and the joins that bring a group's figures
    back to its rows need no rows of a key together, so Spark splits them.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError(f"keep is smallest or largest, not {keep!r}")
    best = F.min if keep == "smallest" else F.max
    text = text_bytes(text_col)
    rows = docs.select(
        F.col(id_col).cast("long").alias("_id"),
        F.substring(F.md5(text), 1, hash_bits // 4).alias("_hash"),
        text.alias("_text"),
        F.sha2(text, 256).alias("_sha"),
    )
    slim = materialise(rows.select("_id", "_hash", "_sha"))
    # SHA-256 tells texts apart that share the grouping hash; figures are summed per task before they are shuffled.
    classes = materialise(slim.groupBy("_hash", "_sha").agg(F.count(F.lit(1)).alias("_n"), best("_id").alias("_keep")))

    # Bytes inside groups: every member is compared with one text of its class. Members are written first, so that a large
    # class may be split over tasks when they are found and again when they are compared.
    many = classes.filter("_n > 1").select("_hash", "_sha")
    members = written(rows.join(many, ["_hash", "_sha"], "left_semi").select("_hash", "_sha", "_text"), "members")
    model = members.groupBy("_hash", "_sha").agg(F.min("_text").alias("_model"))
    unlike = (
        members.join(model.withColumnsRenamed({"_hash": "_h", "_sha": "_s"}), (F.col("_hash") == F.col("_h")) & (F.col("_sha") == F.col("_s")))
        .filter(F.col("_text") != F.col("_model"))
        .select("_hash")
    )
    if not unlike.isEmpty():
        raise ValueError("two texts share both their MD5 and their SHA-256")
    of_row = classes.withColumnsRenamed({"_hash": "_h", "_sha": "_s"})
    found = slim.join(of_row, (F.col("_hash") == F.col("_h")) & (F.col("_sha") == F.col("_s")), "left")
    keep_id = F.when(F.col("_h").isNull(), F.col("_id")).otherwise(F.col("_keep"))
    return found.select(
        F.col("_id").alias("doc_id"),
        keep_id.alias("keep_id"),
        F.coalesce("_n", F.lit(1)).cast("long").alias("group_size"),
        F.col("_id").eqNullSafe(keep_id).alias("kept"),
        F.col("_sha").alias("text_sha256"),
    )
