"""Exact dedup by a tree merge of digest runs, in DataFrame operations only.

Every row belongs to one of ``R`` runs (a hash of its row tag). Level 0 reduces each run to one row
per text digest; every round then merges ``FAN`` neighbouring runs into one, until a single run,
still spread over the cluster by digest, is left. A merge keeps the winner among the smallest or
largest ids and the number of rows. Two digests count as the same text only when SHA-256, byte
length and an independent 64-bit hash all agree, at every level.

On the way down the root's verdict goes to the level-0 runs of groups that hold copies, at most
``R`` rows per text, and from there to the rows by (digest, run). So a text that a third of all rows
share is spread over ``R`` keys both upwards and downwards; ``R`` follows the shuffle partitions.

Defined results: a null text is the empty text; a null id is below every other id; of rows with
equal text and equal id exactly one stays; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from swellcast.llm import common

FAN_BITS = 3
DIGEST = ("_sha", "_len", "_check")
#: Ids and row tags are below 10**19, so id * 10**19 + tag orders by id, then tag.
_SHIFT = "10000000000000000000"
_NULL_ID = "-9223372036854775809"


def _rows(docs: DataFrame, id_col: str, text_col: str, largest: bool, tag: str | None) -> DataFrame:
    text = common.whole_text(text_col)
    sign = "" if largest else "-"
    rows = docs.select(
        F.col(id_col).cast("long").alias("_id"),
        F.unhex(F.sha2(text.cast("binary"), 256)).alias("_sha"),
        F.octet_length(text).alias("_len"),
        F.xxhash64(text).alias("_check"),
        (F.col(tag) if tag else F.monotonically_increasing_id()).alias("_tag"),
    )
    order = f"CAST(CAST({sign}COALESCE(CAST(_id AS DECIMAL(19,0)), {sign}({_NULL_ID}BD)) AS DECIMAL(19,0))"
    return rows.withColumn(
        "_best", F.expr(f"{order} * CAST({_SHIFT}BD AS DECIMAL(20,0)) AS DECIMAL(38,0)) + CAST(_tag AS DECIMAL(19,0))")
        .cast("decimal(38,0)"))


def _merge(level: DataFrame) -> DataFrame:
    return level.groupBy(*DIGEST, "_run").agg(F.max("_best").alias("_best"), F.sum("_n").alias("_n"))


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", largest: bool = True, tag: str | None = None) -> DataFrame:
    """Per row: _tag (the column ``tag``, if given), _id, digest, _keep_id, _group_size, _kept."""
    spark = docs.sparkSession
    levels = 1
    while 1 << (FAN_BITS * levels) < common.partitions_for(spark):
        levels += 1
    runs = 1 << (FAN_BITS * levels)
    rows = common.stored(_rows(docs, id_col, text_col, largest, tag), "digests").withColumn(
        "_run", F.pmod(F.xxhash64("_tag"), F.lit(runs)).cast("int"))
    leaf = _merge(rows.withColumn("_n", F.lit(1).cast("long")))
    root = leaf
    for _ in range(levels):
        root = _merge(root.withColumn("_run", F.shiftright("_run", FAN_BITS)))
    # Only texts with copies travel down; the other rows keep themselves.
    copies = root.where(F.col("_n") > 1).select(
        *DIGEST, F.col("_best").alias("_keep"), F.col("_n").alias("_group_size"))
    down = leaf.select(*DIGEST, "_run").join(copies, list(DIGEST)).select(*DIGEST, "_run", "_keep", "_group_size")
    joined = rows.join(down, [*DIGEST, "_run"], "left")
    keep = F.coalesce("_keep", "_best")
    tag = F.pmod(keep, F.lit(_SHIFT).cast("decimal(20,0)"))
    unsigned = ((keep - tag) / F.lit(_SHIFT).cast("decimal(20,0)")).cast("decimal(20,0)")
    value = unsigned if largest else -unsigned
    return joined.select(
        "_tag", "_id", *DIGEST,
        F.when(F.col("_keep").isNull(), F.col("_id"))
        .when(value == F.lit(_NULL_ID).cast("decimal(20,0)"), F.lit(None).cast("long"))
        .otherwise(value.cast("long")).alias("_keep_id"),
        F.coalesce("_group_size", F.lit(1).cast("long")).alias("_group_size"),
        (keep == F.col("_best")).alias("_kept"),
    )


def mark(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", largest: bool = True) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    return groups(docs, id_col, text_col, largest).select(
        F.col("_id").alias("doc_id"), F.col("_keep_id").alias("keep_id"), F.col("_group_size").alias("group_size"),
        F.col("_kept").alias("kept"), F.lower(F.hex("_sha")).alias("text_sha256"))


def _addressed(docs: DataFrame, tag: str) -> DataFrame:
    """``docs`` with a row tag that a second scan gives again: from the row's place in its file, else by storing the rows."""
    try:
        return docs.withColumn(tag, F.xxhash64("_metadata.file_path", "_metadata.row_index").bitwiseAND(F.lit(2**63 - 1)))
    except AnalysisException:
        return common.stored(docs.withColumn(tag, F.monotonically_increasing_id()), "tagged")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", largest: bool = True) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    tag, digest = common.fresh(docs.columns, "_tag"), common.fresh(docs.columns, "_sha")
    tagged = _addressed(docs, tag)
    gone = groups(tagged, id_col, text_col, largest, tag).where(~F.col("_kept")).select(
        F.col("_tag").alias(tag), F.col("_sha").alias(digest))
    sha = F.unhex(F.sha2(common.whole_text(text_col).cast("binary"), 256))
    return tagged.withColumn(digest, sha).join(gone, [tag, digest], "left_anti").select(*docs.columns)


def op5_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return mark(common.table(spark, sf_dir, "documents"))


ORACLE = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
