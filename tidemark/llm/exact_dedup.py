"""Exact dedup by 128-bit content hash with a byte comparison inside groups.

Only DataFrame functions: no Python code runs on the executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import ascii_lower, fresh, own

_TEXT, _HASH, _SHA, _KEEP, _SIZE = "_xd_text", "_xd_hash", "_xd_sha", "_xd_keep", "_xd_size"


def duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min") -> DataFrame:
    """One row per document with its group of byte-identical normalised texts.

    Texts are equal when identical after lower-casing A-Z. The group key is the
    128-bit MD5 of the normalised text *and the text itself*, so two texts that
    collide in the hash fall into different groups: the aggregation compares
    their bytes. The pre-aggregation runs before the shuffle, so a group that
    holds a third of all rows leaves one row per task. The narrow rejoin is on
    (MD5, SHA-256); a hot key there is split by adaptive execution.

    Returns ``id_col``, keep_id, group_size, kept, text_sha256. Null text counts
    as empty; empty texts form one group. ``keep`` is 'min' or 'max' of the id.
    Rows that repeat an id and a text are all counted and share the verdict of
    their id; a null id is kept only if its whole group has null ids. An empty
    table gives an empty result. Other columns are ignored.
    """
    if keep not in ("min", "max"):
        raise ValueError("keep must be 'min' or 'max'")
    pick = F.min if keep == "min" else F.max
    base = docs.select(F.col(id_col).alias("_xd_id"), ascii_lower(F.col(text_col)).alias(_TEXT))
    hashed = base.select("_xd_id", F.unhex(F.md5(_TEXT)).alias(_HASH), _TEXT)
    classes = (
        hashed.groupBy(_HASH, _TEXT)
        .agg(pick("_xd_id").alias(_KEEP), F.count(F.lit(1)).alias(_SIZE))
        .select(_HASH, F.unhex(F.sha2(_TEXT, 256)).alias(_SHA), _KEEP, _SIZE)
    )
    rows = base.select("_xd_id", F.unhex(F.md5(_TEXT)).alias(_HASH), F.unhex(F.sha2(_TEXT, 256)).alias(_SHA))
    return rows.join(classes, [_HASH, _SHA]).select(
        F.col("_xd_id").alias(id_col),
        F.col(_KEEP).alias("keep_id"),
        F.col(_SIZE).alias("group_size"),
        F.col("_xd_id").eqNullSafe(F.col(_KEEP)).alias("kept"),
        F.lower(F.hex(_SHA)).alias("text_sha256"),
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: exactly one per group.

    A ranked window over (MD5, normalised text); Spark limits each group to one
    row per task before the shuffle, so a hot group stays small. Rows that tie
    in the id are ordered by their other columns' hash, and rows equal in every
    column are interchangeable. Null ids go last. Columns of any name are kept
    as they are.
    """
    if keep not in ("min", "max"):
        raise ValueError("keep must be 'min' or 'max'")
    order = F.col(id_col).asc_nulls_last() if keep == "min" else F.col(id_col).desc_nulls_last()
    text, digest, place = fresh(docs, _TEXT, _HASH, _KEEP)
    work = docs.withColumn(text, ascii_lower(F.col(text_col))).withColumn(digest, F.unhex(F.md5(text)))
    tie = F.xxhash64(*[F.col(f"`{c}`") for c, kind in docs.dtypes if not kind.startswith("map")])
    ranked = work.withColumn(place, F.row_number().over(Window.partitionBy(digest, text).orderBy(order, tie)))
    return ranked.where(F.col(place) == 1).select(*own(docs))
