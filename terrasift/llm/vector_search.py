"""Exact top-k inner products with a vector-approximation file.

Every component is floor(scale * x), an integer. The approximation file holds, for each distinct vector, the number of
the cell that each component lies in (``bits`` bits, equal widths between the component's smallest and largest value).
Tiles of blocks of queries and blocks of cells are scanned for an upper and a lower bound of every score; a tile keeps
the k best lower bounds that it has seen of each query, and what can't reach the k-th of them is left out there. Over
all tiles the k-th best lower bound then decides what is left. That is refined: exact vectors are read in the order of
their upper bounds, a batch for each query at a time, until the k-th exact score is certain, that is until no unread
bound reaches it.

Equal vectors have equal scores, and ties go to smaller ids, so no more than k + 1 ids of each distinct vector (one may
be the query's own) can be in a result: a vector that is very common costs no more than a rare one. A vector that only
the query's own id has is no candidate, in the bounds as in the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terrasift.llm.scratch import Scratch, whole_numbers

QUERY_BLOCK = 512
CELL_BLOCK = 4096
#: Blocks of queries, and of cells, in a tile.
TILE = 8
BITS = 6
SCALE = 256


def integers(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of every component, as long integers; null for a vector that takes no part."""
    ok = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.when(ok, F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double"))))


def cell_edges(low: np.ndarray, high: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The first value of the cells of each component, and their width."""
    return low, np.maximum(1, -(-(high - low + 1) // (1 << bits)))


def bounds(queries: np.ndarray, cells: np.ndarray, low: np.ndarray, width: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Upper and lower bounds of the inner products of queries with all vectors in the given cells.

    Sums of products of integers; as doubles they are exact below 2**53, and beyond that widened by what rounding may do.
    """
    first = low + cells * width
    last = np.minimum(first + width - 1, high)
    pos, neg = np.maximum(queries, 0).astype(float), np.minimum(queries, 0).astype(float)
    first, last = first.astype(float).T, last.astype(float).T
    d = len(first)
    most = d * np.abs(queries).max(initial=0) * max(np.abs(first).max(initial=0), np.abs(last).max(initial=0))
    slack = 0.0 if most < 2**53 else most * 2.0**-52 * (2 * d + 4)
    return pos @ last + neg @ first + slack, pos @ first + neg @ last - slack


def merged_best(best: np.ndarray, lower: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` greatest lower bounds of each query among those known and some more, unordered."""
    both = np.concatenate([best, lower], axis=1)
    return -np.partition(-both, k - 1, axis=1)[:, :k]


def top_k(
    vectors: DataFrame,
    is_query: Column,
    k: int = 5,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    bits: int = BITS,
    scale: int = SCALE,
    batch: int = 16,
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query the ``k`` vectors of greatest integer inner product but itself.

    Ties go to smaller ids; a query with fewer candidates has fewer rows. Vectors that are null or hold null or
    non-finite components, and rows without an id, take no part. Ids must be whole numbers. Of vectors of different
    lengths, what one lacks counts as 0; an empty vector scores 0 with all. Rows that repeat an id and a vector are one;
    an id with several vectors is several queries and candidates: a query leaves out all vectors of its own id, and the
    rows of an id are the best over all its vectors. An empty table gives no rows. Components so large that scores may leave 64
    bits are refused with a ValueError. Other columns are read by ``is_query`` only.
    """
    whole_numbers(vectors, id_col)
    spark, scratch = vectors.sparkSession, Scratch(vectors.sparkSession)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), integers(F.col(vector_col), scale).alias("v"), is_query.alias("query"))
    rows = scratch.table(rows.where("id is not null and v is not null").withColumn("query", F.coalesce("query", F.lit(False))))
    d = rows.agg(F.max(F.size("v"))).first()[0]
    if d is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    d = max(d, 1)
    zeros = F.array_repeat(F.lit(0).cast("long"), F.lit(d) - F.size("v"))
    rows = rows.withColumn("v", F.when(F.size("v") < d, F.concat("v", zeros)).otherwise(F.col("v")))
    ends = rows.agg(*(f(F.get("v", F.lit(i))) for i in range(d) for f in (F.min, F.max))).first()
    most = max(abs(x) for x in ends)
    if d * most * most >= 2**63:
        raise ValueError(f"inner products of {d} components up to {most} may not fit into 64 bits")
    low, high = np.array(ends[0::2], np.int64), np.array(ends[1::2], np.int64)
    low, width = cell_edges(low, high, bits)

    # the vector file: distinct vectors with the ids that can matter; limited before the shuffle, so no vector is hot
    nth = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    ids = rows.select("v", "id").distinct().withColumn("nth", nth).where(F.col("nth") <= k + 1)
    file = ids.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    # several vectors may have the same first id, so each gets a number of its own
    file = scratch.table(file.select(F.xxhash64("v").alias("h"), F.monotonically_increasing_id().alias("vid"), "ids", "v"))
    total = file.count()
    queries = rows.where("query").select(F.col("id").alias("id"), F.col("v").alias("q")).distinct()
    queries = scratch.table(queries.select(F.monotonically_increasing_id().alias("qid"), "id", "q"))
    asked = queries.count()
    if not asked:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    cell_blocks, query_blocks = -(-total // CELL_BLOCK), -(-asked // QUERY_BLOCK)
    kind = np.uint8 if bits <= 8 else np.uint16

    def pack_cells(rows: pd.DataFrame) -> pd.DataFrame:
        v = np.stack(rows["v"].to_numpy()).astype(np.int64)
        cells = ((v - low) // width).astype(kind)
        packed = {c: [rows[c].to_numpy(np.int64).tobytes()] for c in ("vid", "first", "single")}
        return pd.DataFrame({"block": [int(rows["block"].iloc[0])], **packed, "cells": [cells.tobytes()]})

    def pack_queries(rows: pd.DataFrame) -> pd.DataFrame:
        q = np.stack(rows["q"].to_numpy()).astype(np.int64)
        packed = {c: [rows[c].to_numpy(np.int64).tobytes()] for c in ("qid", "id")}
        return pd.DataFrame({"qblock": [int(rows["qblock"].iloc[0])], **packed, "qs": [q.tobytes()]})

    # the id of a vector matters to the scan if no other id has the vector
    cells = file.select(F.pmod("h", F.lit(cell_blocks)).alias("block"), "v", "vid", F.element_at("ids", 1).alias("first"), (F.size("ids") == 1).cast("long").alias("single"))
    cells = scratch.table(cells.groupBy("block").applyInPandas(pack_cells, "block long, vid binary, first binary, single binary, cells binary"))
    asks = queries.withColumn("qblock", F.pmod(F.xxhash64("qid"), F.lit(query_blocks))).groupBy("qblock")
    asks = scratch.table(asks.applyInPandas(pack_queries, "qblock long, qid binary, id binary, qs binary"))
    # every block of queries meets every block of cells, tile by tile
    tiles = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(-(-n // TILE) - 1).cast("long")))
    right = cells.select(F.floor(F.col("block") / TILE).alias("ctile"), tiles(query_blocks).alias("qtile"), "block", "vid", "first", "single", "cells")
    left = asks.select(F.floor(F.col("qblock") / TILE).alias("qtile"), tiles(cell_blocks).alias("ctile"), "qblock", "qid", "id", "qs")
    met = left.join(right, ["ctile", "qtile"])

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: dict[int, np.ndarray] = {}  # of the query blocks of one tile
        tile = None
        for rows in batches:
            for r in rows.itertuples():
                if tile != r.qtile:
                    tile, best = r.qtile, {}
                vids, firsts, single, qids, ids = (np.frombuffer(x, np.int64) for x in (r.vid, r.first, r.single, r.qid, r.id))
                c = np.frombuffer(r.cells, kind).reshape(len(vids), d).astype(np.int64)
                upper, lower = bounds(np.frombuffer(r.qs, np.int64).reshape(len(qids), d), c, low, width, high)
                if len(own := np.flatnonzero(np.isin(firsts, ids) & (single > 0))):  # vectors that only a query's own id has
                    mine = np.zeros(upper.shape, bool)
                    mine[:, own] = ids[:, None] == firsts[None, own]
                    upper[mine] = lower[mine] = -np.inf
                known = best.get(r.qblock, np.full((len(qids), k), -np.inf))
                best[r.qblock] = known = merged_best(known, lower, k)
                at, which = np.nonzero((upper >= known.min(axis=1)[:, None]) & (upper > -np.inf))
                yield pd.DataFrame({"qid": qids[at], "vid": vids[which], "upper": upper[at, which], "lower": lower[at, which]})

    bounded = scratch.table(met.mapInPandas(scan, "qid long, vid long, upper double, lower double"))
    by_lower = Window.partitionBy("qid").orderBy(F.desc("lower"), "vid")
    kth = bounded.withColumn("nth", F.row_number().over(by_lower)).where(F.col("nth") <= k)
    kth = kth.groupBy("qid").agg(F.when(F.count(F.lit(1)) >= k, F.min("lower")).alias("sure"))
    left = bounded.join(kth, "qid").where("sure is null or upper >= sure").select("qid", "vid", "upper")
    left = scratch.table(left.withColumn("nth", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("upper"), "vid"))))

    exact = F.aggregate(F.zip_with("q", "v", lambda a, b: a * b), F.lit(0).cast("long"), lambda acc, x: acc + x)
    ranked = Window.partitionBy("qid").orderBy(F.desc("score"), "vec_id")
    result, read = None, 0
    while True:
        now = left.where((F.col("nth") > read) & (F.col("nth") <= read + batch))
        scored = now.join(queries, "qid").join(file, "vid").select("qid", F.col("id").alias("query_id"), F.explode("ids").alias("vec_id"), exact.alias("score"))
        scored = scored.where("query_id <> vec_id")
        result = scored if result is None else result.union(scored)
        result = result.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k).select("qid", "query_id", "vec_id", "score", "rank")
        result = scratch.table(result)
        read += batch
        certain = result.groupBy("qid").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("least"))
        left = left.join(certain, "qid", "left").where((F.col("nth") > read) & (F.col("least").isNull() | (F.col("upper") >= F.col("least"))))
        left = scratch.table(left.select("qid", "vid", "upper", "nth"))
        if left.isEmpty():
            break
        result = result.drop("rank")
        batch *= 4
    # an id with several vectors has asked with each of them
    last = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id", "qid"))
    return result.withColumn("rank", last).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE_SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as e from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select a.vec_id as query_id, b.vec_id,
    cast(list_sum(list_transform(list_zip(a.e, b.e), lambda z: z[1] * z[2])) as bigint) as score
  from v a join v b on a.vec_id <> b.vec_id where a.vec_id % 50 = 0
), r as (
  select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank from s
)
select query_id, rank, vec_id, score from r where rank <= 5
"""
