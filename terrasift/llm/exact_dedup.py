"""Exact deduplication by a tree-merge of sorted digest runs, in DataFrame functions only.

Every input partition is cut into a few runs of (digest, smallest identifier, number of rows). In binomial rounds,
``2 ** bits`` neighbouring runs meet: their sorted entries are merged, and each digest retains the smallest identifier
that was verified for it, by the full SHA-256, the length and an independent 64-bit hash. After log(runs) rounds one
logical run, spread over all tasks by digest, holds each group once. The same tree is then walked downwards: a run's
entry takes the result of its parent's, and at last each row that of its run's entry. A key of either walk has at most
``2 ** bits`` rows, or the rows of one run, so a group that holds a third of all rows is never in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrasift.llm.scratch import Scratch

BLANKS = r"[\x20\x09-\x0D]+"


def normalised(text: str | Column) -> Column:
    """The text with each run of ASCII white space as one space; null counts as empty."""
    text = F.col(text) if isinstance(text, str) else text
    return F.regexp_replace(F.coalesce(text, F.lit("")), BLANKS, " ")


def tree_merge(rows: DataFrame, key: list[str], run: str, order: str, scratch: Scratch, bits: int = 3) -> DataFrame:
    """``rows`` with ``best`` (least ``order`` among the rows of equal ``key``) and ``group_size``.

    ``rows`` must be re-readable without change (a written table); ``run`` numbers its runs from 0.
    """
    level = scratch.table(
        rows.groupBy(run, *key).agg(F.min(order).alias("least"), F.count(F.lit(1)).alias("members")).sortWithinPartitions(run, *key)
    )
    levels = [level]
    top = level.agg(F.max(run)).first()[0] or 0
    while top:
        level = scratch.table(
            level.groupBy(F.shiftright(run, bits).alias(run), *key)
            .agg(F.min("least").alias("least"), F.sum("members").alias("members"))
            .sortWithinPartitions(run, *key)
        )
        levels.append(level)
        top >>= bits
    result = levels.pop().select(run, *key, F.col("least").alias("best"), F.col("members").alias("group_size"))
    while levels:
        below = levels.pop().select(run, *key, F.shiftright(run, bits).alias("parent"))
        above = result.withColumnRenamed(run, "parent")
        result = scratch.table(below.join(above, ["parent", *key]).drop("parent"))
    return rows.join(result, [run, *key])


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = 3, splits: int = 8) -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256.

    Of the rows whose normalised texts are equal, the one with the smallest id stays; keep_id is its id. Null texts
    count as empty, and empty texts are equal to each other. A null id comes after all others. Rows that repeat an id
    and a text are members of one group, of which exactly one is kept. An empty table gives no rows. Other columns of
    ``docs`` are not read, whatever their names.
    """
    scratch = Scratch(docs.sparkSession)
    text = normalised(F.col(text_col))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("t")).select(
        "id",
        F.unhex(F.sha2("t", 256)).alias("digest"),
        F.octet_length("t").alias("bytes"),
        F.xxhash64("t").alias("witness"),
        F.monotonically_increasing_id().alias("row"),
        (F.spark_partition_id() * splits + F.pmod(F.xxhash64("id"), F.lit(splits)).cast("int")).alias("run"),
    )
    rows = scratch.table(rows).withColumn("order", F.struct(F.isnull("id").alias("no_id"), F.col("id"), F.col("row")))
    merged = tree_merge(rows, ["digest", "bytes", "witness"], "run", "order", scratch, bits)
    return merged.select(
        F.col("id").alias(id_col),
        F.col("best.id").alias("keep_id"),
        F.col("group_size").cast("long").alias("group_size"),
        (F.col("row") == F.col("best.row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that exact deduplication keeps, with all their columns.

    A row is matched by id and digest; rows that repeat both are reduced to one.
    """
    columns = docs.columns
    name = F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("__id")  # null and repeated ids join as they are
    kept = exact_dedup(docs, id_col, text_col).where("kept").select(name, F.col("text_sha256").alias("__sha")).distinct()
    marked = docs.select("*", name, F.sha2(normalised(F.col(text_col)), 256).alias("__sha"))
    return marked.join(kept, ["__id", "__sha"], "left_semi").dropDuplicates(["__id", "__sha"]).select(*columns)


ORACLE_SQL = r"""
with t as (
  select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as t from documents
), h as (select doc_id, sha256(t) as text_sha256 from t)
select doc_id, min(doc_id) over w as keep_id, count(*) over w as group_size, doc_id = min(doc_id) over w as kept, text_sha256
from h window w as (partition by text_sha256)
"""
