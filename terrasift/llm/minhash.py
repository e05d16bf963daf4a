"""MinHash near-duplicate detection with sequential Bayesian verification.

1. Every text becomes the set of its word shingles and a 256-bit cryptographic digest of its word sequence. Equal
   sequences (by the digest and the size of their sets) form a class, by the same tree-merge as exact deduplication; only
   its representative goes on, with the keys of its signature's bands and one byte of each minimum.
2. Band keys are grouped. In each bucket the smallest member leads, and the others are compared with the leader.
3. Comparing means: the signatures are matched in batches; after each batch the posterior of the similarity, given the
   matches so far, is looked up, and a pair whose probability of reaching the threshold is below ``miss`` is pruned.
4. Survivors are verified exactly, on the full shingle sets of both texts, and contracted into components.
5. Buckets that still hold members of several components are gone through once more: each member outside the bucket's
   first component is compared with all members that it isn't connected with. Then every pair of a bucket has been
   compared or is connected, so no bucket is capped and no link of a bucket is lost. A large bucket is cut into blocks
   of bounded size, which meet in as many tasks; its pairs are looked at and verified in place, and only links become
   rows.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrasift.llm.components import connected_components
from terrasift.llm.exact_dedup import tree_merge
from terrasift.llm.scratch import Scratch, whole_numbers

SHINGLE = 5
BANDS, ROWS = 30, 6
HASHES = BANDS * ROWS
BATCH = 36
MISS = 1e-6
WORD_CACHE = 200_000

_SEEDS = np.random.Generator(np.random.PCG64(20240229))
_MUL = _SEEDS.integers(1, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _SEEDS.integers(0, 2**63, HASHES, dtype=np.uint64)
_STEP = _SEEDS.integers(1, 2**63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def words(text: str | None) -> list[bytes]:
    """Runs of anything but ASCII white space, with A-Z in lower case."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


class WordHashes(dict):
    """64-bit hashes of words; remembers a bounded number of them."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh64_intdigest(word)
        if len(self) < WORD_CACHE:
            self[word] = value
        return value


@functools.lru_cache(maxsize=1)
def word_hashes() -> WordHashes:
    """The hashes that the tasks of a Python worker share."""
    return WordHashes()


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values in which every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def shingle_hashes(tokens: list[bytes], of: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of the shingles, and the words' own hashes."""
    n = len(tokens)
    each = np.fromiter(map(of.__getitem__, tokens), np.uint64, n)
    if not n:
        return each, each
    width = min(SHINGLE, n)
    total = np.full(n - width + 1, np.uint64(width))
    for k in range(width):
        total = (total ^ each[k : n - width + 1 + k]) * _STEP[k]
        total ^= total >> np.uint64(29)
    return np.unique(mixed(total)), each


def signature(shingles: np.ndarray, block: int = 1024) -> np.ndarray:
    """The smallest value of each hash function over the set, as unsigned 32-bit integers."""
    least = np.full(HASHES, 2**32 - 1, np.uint32)
    for i in range(0, len(shingles), block):
        values = np.multiply(_MUL[:, None], shingles[None, i : i + block])
        values += _ADD[:, None]
        least = np.minimum(least, (values.min(axis=1) >> np.uint64(32)).astype(np.uint32))
    return least


def band_keys(sig: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band, of its number and its rows."""
    total = mixed(np.arange(1, BANDS + 1, dtype=np.uint64))
    for row in sig.astype(np.uint64).reshape(BANDS, ROWS).T:
        total = mixed((total ^ row) * np.uint64(0x9E3779B97F4A7C15))
    return total.view(np.int64)


SKETCH = T.StructType(
    [
        T.StructField("n_shingles", T.LongType()),
        T.StructField("digest", T.BinaryType()),
        T.StructField("sig", T.BinaryType()),
        T.StructField("keys", T.ArrayType(T.LongType())),
    ]
)


@F.pandas_udf(SKETCH)
def sketch(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    of = word_hashes()
    for texts in batches:
        sizes, digests, sigs, keys = [], [], [], []
        for text in texts:
            tokens = words(text)
            shingles, _ = shingle_hashes(tokens, of)
            sizes.append(len(shingles))
            digests.append(hashlib.blake2b(b" ".join(tokens), digest_size=32).digest())
            sig = signature(shingles) if len(shingles) else None
            sigs.append(None if sig is None else sig.astype(np.uint8).tobytes())
            keys.append(None if sig is None else band_keys(sig))
        yield pd.DataFrame({"n_shingles": np.array(sizes, np.int64), "digest": digests, "sig": sigs, "keys": keys})


def reach(threshold: float, miss: float, batch: int = BATCH, hashes: int = HASHES, grid: int = 2001) -> list[int]:
    """For each number of bytes compared, the fewest matches with P(similarity >= threshold | matches) >= miss.

    The prior of the similarity s is uniform on [0, 1]; a byte of two minima matches with probability s + (1 - s) / 256.
    """
    s = (np.arange(grid) + 0.5) / grid
    match, over, least = s + (1 - s) / 256, s >= threshold, []
    for n in range(batch, hashes + 1, batch):
        m = 0
        while m <= n:
            log = m * np.log(match) + (n - m) * np.log1p(-match)
            mass = np.exp(log - log.max())
            if mass[over].sum() / mass.sum() >= miss:
                break
            m += 1
        least.append(m)
    return least


def survivors(one: np.ndarray, others: np.ndarray, least: list[int]) -> np.ndarray:
    """The positions in ``others`` that no batch prunes against ``one``."""
    alive, matches = np.arange(len(others)), np.zeros(len(others), np.int64)
    for k, fewest in enumerate(least):
        part = slice(k * BATCH, (k + 1) * BATCH)
        matches = matches + (others[alive, part] == one[part]).sum(axis=1)
        ok = matches >= fewest
        alive, matches = alive[ok], matches[ok]
        if not len(alive):
            break
    return alive


#: Rows, and bytes of text, of a block at most, on average.
BLOCK, BLOCK_BYTES = 2048, 16 << 20


def blocks(rows: DataFrame, *more: str) -> DataFrame:
    """The rows of each key in blocks of bounded size, such that each block of leading rows meets each block of all.

    ``rows``: key, id, sig, n, leads, label, ``size`` and ``leaders`` (the numbers of rows and of leading rows of the
    key), ``bytes`` (of the key's texts, if these come along) and ``more``. (key, i, j) numbers a meeting; ``first`` tells
    a leading row's copy from its plain one.
    """
    number = lambda of: F.greatest(F.ceil(F.col(of) / BLOCK), F.ceil(F.col("bytes") * F.col(of) / F.col("size") / BLOCK_BYTES))
    place = lambda of: F.pmod(F.xxhash64("id"), number(of))
    every = lambda of: F.explode(F.sequence(F.lit(0).cast("long"), number(of) - 1))
    rows = rows if "bytes" in rows.columns else rows.withColumn("bytes", F.lit(0).cast("long"))
    named = ["key", "i", "j", "id", "sig", "n", "label", *more]
    right = rows.select("*", place("size").alias("j"), every("leaders").alias("i")).select(*named, F.lit(False).alias("first"))
    left = rows.where("leads").select("*", place("leaders").alias("i"), every("size").alias("j"))
    both = right.union(left.select(*named, F.lit(True).alias("first")))
    return both.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")


def meetings(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, list[int]]]:
    """Whole meetings of sorted blocks: some rows, and where in them each meeting begins, and the end."""
    rest = None
    for batch in batches:
        rest = batch if rest is None or not len(rest) else pd.concat([rest, batch], ignore_index=True)
        if len(rest):
            spot = rest[["key", "i", "j"]].to_numpy()
            cuts = np.flatnonzero((spot[1:] != spot[:-1]).any(axis=1)) + 1
            if len(cuts):  # the last one may go on in the next batch
                yield rest.iloc[: cuts[-1]], [0, *cuts]
                rest = rest.iloc[cuts[-1] :].reset_index(drop=True)
    if rest is not None and len(rest):
        yield rest, [0, len(rest)]


class Comparison:
    """What every leading row of some meetings may be linked with: the rows of other labels that aren't pruned."""

    def __init__(self, part: pd.DataFrame, percent: int, least: list[int]):
        self.sigs = np.frombuffer(b"".join(part["sig"]), np.uint8).reshape(len(part), HASHES)
        self.ids, self.labels, self.sizes, self.first = (part[c].to_numpy(copy=True) for c in ("id", "label", "n", "first"))
        self.percent, self.least = percent, least

    def hits(self, k: int, others: np.ndarray) -> np.ndarray:
        apart = others[self.labels[others] != self.labels[k]]
        # sets of very different sizes can't be similar
        few, many = np.minimum(self.sizes[apart], self.sizes[k]), np.maximum(self.sizes[apart], self.sizes[k])
        apart = apart[100 * few >= self.percent * many]
        return apart[survivors(self.sigs[k], self.sigs[apart], self.least)] if len(apart) else apart

    def meeting(self, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        return lo + np.flatnonzero(self.first[lo:hi]), lo + np.flatnonzero(~self.first[lo:hi])

    def pair(self, k: int, x: int) -> tuple[int, int]:
        return min(self.ids[k], self.ids[x]), max(self.ids[k], self.ids[x])


def star_pairs(rows: DataFrame, percent: int, miss: float) -> DataFrame:
    """Distinct pairs (a, b) of a bucket's one leader and a member that isn't pruned."""
    least = reach(percent / 100, miss)

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, cuts in meetings(batches):
            own, out = Comparison(part, percent, least), set()
            for lo, hi in zip(cuts, cuts[1:]):
                lead, others = own.meeting(lo, hi)
                out |= {own.pair(k, x) for k in lead for x in own.hits(k, others)}
            yield pd.DataFrame(sorted(out), columns=["a", "b"], dtype="int64")

    return blocks(rows).mapInPandas(compare, "a long, b long").distinct()


def touched(rows: DataFrame, percent: int, miss: float) -> DataFrame:
    """The rows (key, id) for which some pair with a leading row isn't pruned: no more than there are rows."""
    least = reach(percent / 100, miss)

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, cuts in meetings(batches):
            own, seen = Comparison(part, percent, least), np.zeros(len(part), bool)
            for lo, hi in zip(cuts, cuts[1:]):
                lead, others = own.meeting(lo, hi)
                for k in lead:
                    hits = own.hits(k, others)
                    seen[hits] = True
                    seen[k] |= len(hits) > 0
            yield pd.DataFrame({"key": part["key"].to_numpy()[seen], "id": own.ids[seen]})

    return blocks(rows).mapInPandas(compare, "key long, id long").distinct()


def block_links(rows: DataFrame, percent: int, miss: float) -> DataFrame:
    """Distinct pairs (a, b) that are similar enough by the hashes of their full sets; rows also hold ``text``.

    Pairs are verified in place, and what a link connects within a meeting isn't compared again there.
    """
    least = reach(percent / 100, miss)

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of = word_hashes()
        for part, cuts in meetings(batches):
            own, texts, out = Comparison(part, percent, least), part["text"].to_numpy(), set()
            for lo, hi in zip(cuts, cuts[1:]):
                sets: dict[int, np.ndarray] = {}
                lead, others = own.meeting(lo, hi)
                for k in lead:
                    for x in own.hits(k, others):
                        if own.labels[x] == own.labels[k]:
                            continue
                        for y in (k, x):
                            if own.ids[y] not in sets:
                                sets[own.ids[y]] = shingle_hashes(words(texts[y]), of)[0]
                        a, b = sets[own.ids[k]], sets[own.ids[x]]
                        both = len(np.intersect1d(a, b, assume_unique=True))
                        if both and 100 * both >= percent * (len(a) + len(b) - both):
                            out.add(own.pair(k, x))
                            part_of = own.labels[lo:hi]
                            part_of[part_of == own.labels[x]] = own.labels[k]
            yield pd.DataFrame(sorted(out), columns=["a", "b"], dtype="int64")

    return blocks(rows, "text").mapInPandas(compare, "a long, b long").distinct()


def shingle_set(text: str | None) -> set:
    tokens = words(text)
    if len(tokens) < SHINGLE:
        return {tuple(tokens)} if tokens else set()
    return set(zip(*(tokens[k:] for k in range(SHINGLE))))


def exact_links(percent: int):
    """A function of two text columns: true where 100 * intersection >= percent * union of the full shingle sets."""

    @F.pandas_udf("boolean")
    def linked(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for left, right in batches:
            out, last, mine = [], None, set()
            for a, b in zip(left, right):
                if a != last:
                    last, mine = a, shingle_set(a)
                other = shingle_set(b)
                both = len(mine & other)
                out.append(both > 0 and 100 * both >= percent * (len(mine) + len(other) - both))
            yield pd.Series(out, dtype=bool)

    return linked


def verified(pairs: DataFrame, texts: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough.

    ``a`` may lead very many pairs; the joins are plain sort-merge joins, whose large partitions Spark splits.
    """
    right = texts.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
    left = texts.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
    both = pairs.hint("merge").join(right, "b").hint("merge").join(left, "a")
    return scratch.table(both.where(exact_links(percent)("text_a", "text_b")).select("a", "b"))


def counted(rows: DataFrame) -> DataFrame:
    """``rows`` with the numbers of rows and of leading rows of their key, and the sum of ``bytes``; keys without a leading row go."""
    more = [F.sum("bytes").alias("bytes")] if "bytes" in rows.columns else []
    counts = rows.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.count_if("leads").alias("leaders"), *more)
    return rows.drop("bytes").join(counts.where("leaders > 0"), "key")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85, miss: float = MISS) -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, component_id, kept.

    A text's set holds its distinct shingles of five words, or its whole word sequence if that is shorter. Texts are
    linked when 100 * intersection >= ``percent`` * union; component_id is the smallest id that can be reached, itself
    included. Ids must be whole numbers. Null texts, and texts without words, have an empty set and are linked with
    nothing. Rows that repeat an id are one document: its component is the smallest that any of its texts reaches. Rows whose id is null are never
    linked: component_id is null and they are kept. An empty table gives no rows. Other columns are not read, whatever
    their names. ``percent`` must be 80 or more; the bands miss a pair of similarity 0.85 with probability 7e-7, one of
    0.80 with 1e-4.
    """
    if percent < 80:
        raise ValueError("the bands are made for 80 percent or more")
    whole_numbers(docs, id_col)
    scratch = Scratch(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    base = rows.select("id", sketch("text").alias("s"), F.spark_partition_id().alias("part"))
    base = scratch.table(base.select("id", "s.*", (F.col("part") * 8 + F.pmod(F.xxhash64("id"), F.lit(8)).cast("int")).alias("run")))
    full = base.where("n_shingles > 0 and id is not null").select("id", F.col("n_shingles").alias("n"), "digest", "sig", "keys", "run")
    classes = scratch.table(tree_merge(full, ["digest", "n"], "run", "id", scratch).select("id", F.col("best").alias("rep"), "n", "sig", "keys"))
    reps = classes.where("id = rep")

    buckets = reps.select("id", F.explode("keys").alias("key"))
    sizes = buckets.groupBy("key").agg(F.min("id").alias("lead"), F.count(F.lit(1)).alias("size")).where("size > 1")
    members = scratch.table(buckets.join(sizes.hint("merge"), "key"))
    ids = scratch.table(members.select("id").distinct())
    texts = rows.join(ids.hint("merge"), "id", "left_semi")
    texts = scratch.table(texts.withColumn("bytes", F.octet_length("text").cast("long")))
    sigs = reps.select("id", "sig", "n").join(ids.hint("merge"), "id", "left_semi")
    members = scratch.table(members.join(sigs.hint("merge"), "id"))

    star = members.select("key", "id", "sig", "n", (F.col("id") == F.col("lead")).alias("leads"), F.col("id").alias("label"), "size", F.lit(1).alias("leaders"))
    links = verified(scratch.table(star_pairs(star, percent, miss)), texts, percent, scratch)
    labels = connected_components(links, scratch).withColumnRenamed("node", "id")

    # of each bucket, all that lies in one component is done; what lies outside of it meets whatever it isn't linked with
    left = members.where("size > 2").join(labels, "id", "left").withColumn("label", F.coalesce("component", "id"))
    left = scratch.table(left.select("key", "id", "sig", "n", "label", "size"))
    low = left.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high")
    left = scratch.table(left.join(low, "key").withColumn("leads", F.col("label") != F.col("low")))
    left = scratch.table(counted(left.select("key", "id", "sig", "n", "label", "leads")))
    left = left.join(touched(left, percent, miss).hint("merge"), ["key", "id"])
    sizes = texts.groupBy("id").agg(F.max("bytes").alias("bytes"))
    left = left.select("key", "id", "sig", "n", "label", "leads").join(sizes.hint("merge"), "id")
    left = counted(left).join(texts.select("id", "text").hint("merge"), "id")
    more = scratch.table(block_links(left, percent, miss))
    more = verified(more, texts, percent, scratch)
    if not more.isEmpty():
        labels = connected_components(links.union(more), scratch).withColumnRenamed("node", "id")
    classes = classes.select("id", "rep").join(labels.withColumnRenamed("id", "rep"), "rep", "left")
    classes = classes.groupBy("id").agg(F.min(F.coalesce("component", "rep")).alias("component"))
    component = F.coalesce("component", "id")
    return base.select("id", "n_shingles").join(classes, "id", "left").select(
        F.col("id").cast(docs.schema[id_col].dataType).alias(id_col),
        "n_shingles",
        component.alias("component_id"),
        (F.col("id").isNull() | (F.col("id") == component)).alias("kept"),
    )


def keep_leaders(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85) -> DataFrame:
    """The rows of ``docs`` that lead their component, with all their columns; rows without an id stay."""
    result = near_duplicates(docs, id_col, text_col, percent)
    dropped = result.where("not kept").select(F.col(id_col).alias("__id")).distinct()
    return docs.join(dropped, docs[id_col] == dropped["__id"], "left_anti")


ORACLE_SQL = r"""
with recursive w as (
  select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'),
    lambda x: x <> '') as l from documents
), d as (
  select distinct doc_id, unnest(case when len(l) = 0 then [] when len(l) < 5 then [array_to_string(l, ' ')]
    else list_transform(range(1, len(l) - 3), lambda i: array_to_string(l[i:i + 4], ' ')) end) as sh from w
), n as (
  select doc_id, count(*) as n from d group by doc_id
), p as (
  select a.doc_id as a, b.doc_id as b, count(*) as c from d a join d b on a.sh = b.sh and a.doc_id < b.doc_id group by a.doc_id, b.doc_id
), e as (
  select a, b from p join n na on na.doc_id = a join n nb on nb.doc_id = b where 100 * c >= 85 * (na.n + nb.n - c)
), s as (
  select a, b from e union all select b, a from e
), r as (
  select doc_id, doc_id as other from documents union select r.doc_id, s.b from r join s on r.other = s.a
), k as (
  select doc_id, min(other) as component_id from r group by doc_id
)
select k.doc_id, coalesce(n.n, 0) as n_shingles, component_id, k.doc_id = component_id as kept from k left join n on n.doc_id = k.doc_id
"""
