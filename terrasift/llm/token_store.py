"""Token-id files with a minimal perfect hash index.

A store is a folder of three kinds of files, none of which holds a key:

``shard-NNNNNN.ids``
    raw token ids, little-endian unsigned integers (16 bits wide if the vocabulary allows, else 32), document after
    document in ascending key order, shard after shard.
``index-NNNNNN.mph``
    for the keys whose hash falls to this part: a minimal perfect hash function (hash and displace) from a key to a slot,
    and for each slot a 32-bit fingerprint of its key, the shard, the offset in ids and the number of ids. A lookup
    computes two hashes, reads one displacement and one slot, however many documents there are; the fingerprint
    tells keys that were never stored.
``manifest.json``
    the width of an id, the number of index parts, and how many ids each shard holds.

Tasks write below a temporary name and rename, and a repeated task writes the same bytes, so lost executors do no harm.
"""

from __future__ import annotations

import functools
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from terrasift.llm.scratch import Scratch, shared_folder, whole_numbers

KEYS_IN_PART = 65_536
BUCKET = 4
CACHE = 600_000
MAGIC = b"TSMPH002"
#: Bytes of text in a shard: more make more shards; small tables are dealt to all cores, but not into crumbs.
SHARD_BYTES, LEAST_BYTES = 256 << 20, 8 << 20
_CUT = re.compile(r"(?<=\S) (?=\S)")
_ODD = re.compile(r"\s\s")


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary.

    Bytes that are visible in Latin-1 stand for themselves, the others in order for the letters from 256.
    """
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in seen]
    return {b: chr(b) for b in seen} | {b: chr(256 + k) for k, b in enumerate(rest)}


class _Known(dict):
    """Ids of the pieces of texts; remembers a bounded number of them.

    A piece stands for itself after a space, or, if it starts with a line break, for itself.
    """

    def __init__(self, tokenizer: Tokenizer, dtype: np.dtype):
        self.plain, self.word, self.dtype = tokenizer.encode, tokenizer.model.tokenize, dtype
        self.letters = byte_letters()
        self.ends = {c: self.ids(c) for c in ".,"}

    def ids(self, text: str) -> bytes:
        return np.array(self.plain(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def __missing__(self, piece: str) -> bytes:
        if piece[-1:] in self.ends and piece[-2:-1].isalpha():  # a mark after a letter is a token by itself
            got = self[piece[:-1]] + self.ends[piece[-1]]
        elif piece.isalpha():  # one token before merges, so only the merges are left to do
            word = (" " + piece).encode().decode("latin-1").translate(self.letters)
            got = np.array([t.id for t in self.word(word)], self.dtype).tobytes()
        else:
            got = self.ids(piece if piece[:1] == "\n" else " " + piece)
        if len(self) < CACHE:
            self[piece] = got
        return got


class Encoder:
    """Ids of whole texts with a byte-level BPE of the tokenizers library, as little-endian bytes of a fixed width.

    Its pre-tokenizer always starts a token at a single space or line break between two other characters, and merges
    never cross that boundary; so the pieces between them are encoded by themselves, and many of them are remembered.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 65536 else "<u4")
        self.known = _Known(self.tokenizer, self.dtype)

    def pieces(self, text: str) -> list[str]:
        if _ODD.search(text) or text[:1].isspace() or text[-1:].isspace():
            return _CUT.split(text)
        return text.replace("\n", " \n").split(" ")

    def encode(self, text: str) -> bytes:
        parts = self.pieces(text)
        return self.known.ids(parts[0]) + b"".join(map(self.known.__getitem__, parts[1:]))


@functools.lru_cache(maxsize=1)
def encoder_of(path: str) -> Encoder:
    """The encoder that the tasks of a Python worker share, with the pieces that it remembers."""
    return Encoder(path)


def key_hashes(keys: np.ndarray, copies: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit hash of each (key, copy)."""
    raw = np.ascontiguousarray(np.stack([keys.astype("<i8"), copies.astype("<i8")], axis=1)).tobytes()
    return np.fromiter((xxhash.xxh3_64_intdigest(raw[i : i + 16], seed) for i in range(0, len(raw), 16)), np.uint64, len(keys))


def _slots(h: np.ndarray, d: np.ndarray | int, n: int) -> np.ndarray:
    x = (h ^ (np.asarray(d, np.uint64) * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xD6E8FEB86659FD93)
    return ((x ^ (x >> np.uint64(32))) % np.uint64(n)).astype(np.int64)


def build_mph(h: np.ndarray) -> np.ndarray:
    """Displacements of a minimal perfect hash over distinct 64-bit values: one for each bucket of about four values.

    Buckets are placed from the largest; a bucket of one value is sent straight to a free slot, as -1 - slot.
    """
    n = len(h)
    buckets = max(1, -(-n // BUCKET))
    which = (h % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(which, kind="stable")
    sizes = np.bincount(which, minlength=buckets)
    ends = np.cumsum(sizes)
    out, free = np.zeros(buckets, np.int64), np.ones(n, bool)
    tries = np.arange(1, 65, dtype=np.uint64)
    for b in np.argsort(-sizes, kind="stable"):
        size = sizes[b]
        if size < 2:
            break
        own, first = h[order[ends[b] - size : ends[b]]], 0
        while True:
            at = _slots(own[None, :], (tries + np.uint64(first))[:, None], n)
            fits = free[at].all(axis=1)
            for k in np.flatnonzero(fits):
                if len(set(at[k].tolist())) == size:
                    break
            else:
                first += len(tries)
                continue
            out[b] = int(tries[k]) + first
            free[at[k]] = False
            break
    singles = np.flatnonzero(sizes == 1)
    out[singles] = -1 - np.flatnonzero(free)[: len(singles)]
    return out


def find_slots(h: np.ndarray, displacements: np.ndarray, n: int) -> np.ndarray:
    d = displacements[(h % np.uint64(len(displacements))).astype(np.int64)]
    return np.where(d < 0, -1 - d, _slots(h, np.maximum(d, 0), max(n, 1)))


@dataclass
class IndexPart:
    """One part of the index: displacements, and by slot the fingerprint, shard, offset and number of ids.

    ``seed`` is the first under which its keys have distinct hashes.
    """

    seed: int
    displacements: np.ndarray
    fingerprints: np.ndarray
    shards: np.ndarray
    offsets: np.ndarray
    counts: np.ndarray

    @classmethod
    def build(cls, keys, copies, shards, offsets, counts) -> IndexPart:
        seed = 1
        while len(np.unique(h := key_hashes(keys, copies, seed))) != len(keys):
            seed += 2
        d = build_mph(h)
        at = find_slots(h, d, len(h))
        place = lambda v, t: _scattered(np.asarray(v).astype(t), at)
        prints = key_hashes(keys, copies, seed + 1) >> np.uint64(32)
        return cls(seed, d, place(prints, "<u4"), place(shards, "<u4"), place(offsets, "<u8"), place(counts, "<u4"))

    def find(self, keys: np.ndarray, copies: np.ndarray) -> np.ndarray:
        """Slots of keys; -1 where the fingerprint tells that a key isn't stored."""
        if not len(self.fingerprints) or not len(keys):
            return np.full(len(keys), -1, np.int64)
        at = find_slots(key_hashes(keys, copies, self.seed), self.displacements, len(self.fingerprints))
        same = self.fingerprints[at] == (key_hashes(keys, copies, self.seed + 1) >> np.uint64(32)).astype(np.uint32)
        return np.where(same, at, -1)

    def to_bytes(self) -> bytes:
        head = MAGIC + struct.pack("<qqq", self.seed, len(self.displacements), len(self.fingerprints))
        return head + b"".join(x.tobytes() for x in (self.displacements.astype("<i8"), self.fingerprints, self.shards, self.offsets, self.counts))

    @classmethod
    def from_bytes(cls, raw: bytes) -> IndexPart:
        if raw[:8] != MAGIC:
            raise ValueError("not an index part")
        (seed, buckets, n), at, out = struct.unpack("<qqq", raw[8:32]), 32, []
        for kind, count in (("<i8", buckets), ("<u4", n), ("<u4", n), ("<u8", n), ("<u4", n)):
            out.append(np.frombuffer(raw, kind, count, at))
            at += out[-1].nbytes
        return cls(seed, *out)


def _scattered(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    out = np.empty_like(values)
    out[at] = values
    return out


def _put(folder: str, name: str, data: list[bytes]) -> None:
    """Write a file below a temporary name, then give it its own."""
    fs, root = pafs.FileSystem.from_uri(folder)
    fs.create_dir(root, recursive=True)
    own = f"{root}/.{name}.{uuid.uuid4().hex}"
    with fs.open_output_stream(own) as out:
        for x in data:
            out.write(x)
    fs.move(own, f"{root}/{name}")


def part_of(parts: int):
    """The number of the index part that a key (a long column) belongs to."""
    return F.pmod(F.xxhash64("key", "copy"), F.lit(parts)).cast("int")


class TokenStore:
    """Reads a store; what it needs to know of all shards is in the manifest."""

    def __init__(self, folder: str):
        self.folder = folder
        self.fs, self.root = pafs.FileSystem.from_uri(folder)
        with self.fs.open_input_stream(f"{self.root}/manifest.json") as f:
            self.manifest = json.loads(f.read())
        self.dtype = np.dtype(self.manifest["dtype"])

    def part(self, number: int) -> IndexPart:
        with self.fs.open_input_stream(f"{self.root}/index-{number:06d}.mph") as f:
            return IndexPart.from_bytes(f.read())

    def ids(self, shard: int, ranges: Iterator[tuple[int, int]]) -> Iterator[np.ndarray]:
        """The ids of each (offset, count) in one shard."""
        with self.fs.open_input_file(f"{self.root}/shard-{shard:06d}.ids") as f:
            for offset, count in ranges:
                yield np.frombuffer(f.read_at(int(count) * self.dtype.itemsize, int(offset) * self.dtype.itemsize), self.dtype)


def hashed_as(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The keys and copy numbers that are hashed: a null key is 0 with the copy -1 - copy, which no other key has."""
    keys, copies = table.column("key").combine_chunks(), table.column("copy").to_numpy()
    null = keys.is_null().to_numpy(zero_copy_only=False)
    return keys.fill_null(0).to_numpy(zero_copy_only=False), np.where(null, -1 - copies, copies)


def shard_count(docs: DataFrame, text_col: str) -> int:
    """Shards of ``docs``: as its texts' bytes ask for."""
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    spread = min(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // LEAST_BYTES))
    return max(1, -(-size // SHARD_BYTES), spread)


def copies_before(shards: list) -> list[tuple[int, int]]:
    """(shard, copies) of the shards that start with a key which earlier shards hold too, and how many copies those hold.

    ``shards`` in order, each with the first and last key and the number of rows of the last.
    """
    out, held, last = [], 0, None
    for r in shards:
        begins = held if last is not None and last[0] == r["first_key"] else 0
        if begins:
            out.append((r["shard"], begins))
        held = r["last_copies"] + (begins if r["first_key"] == r["last_key"] else 0)
        last = (r["last_key"],)
    return out


def write_store(
    docs: DataFrame, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", keys_in_part: int = KEYS_IN_PART, shards: int | None = None
) -> str:
    """Encode ``docs`` into a new store in the shared folder; returns its folder.

    Ids must be whole numbers of 64 bits at most. Null texts count as empty and hold the end id alone. Documents are in
    ascending order of id, a null id first; rows that repeat an id follow each other by a hash of their text and are
    told apart by a copy number from 0, and if they are very many, they span shards like any other rows. An empty table
    makes a store without documents. Other columns are not read. ``shards`` overrides what the texts' bytes ask for.
    """
    spark = docs.sparkSession
    whole_numbers(docs, id_col)
    scratch, folder = Scratch(spark), shared_folder(spark) + "/store"
    rows = docs.select(F.col(id_col).cast("long").alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    order = [F.col("key").asc_nulls_first(), F.xxhash64("text")]
    rows = rows.repartitionByRange(shards or shard_count(docs, text_col), *order).sortWithinPartitions(*order, "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, shard = encoder_of(tokenizer), TaskContext.get().partitionId()
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        own, end = f"{root}/.shard-{shard:06d}.{uuid.uuid4().hex}", np.array([end_id], encoder.dtype).tobytes()
        at, last, copy, width = 0, None, 0, encoder.dtype.itemsize
        with fs.open_output_stream(own) as out:
            for batch in batches:
                for i in range(0, len(batch), 500):
                    part = batch.slice(i, 500)
                    ids = [encoder.encode(x) + end for x in part.column("text").to_pylist()]
                    counts = np.array([len(x) // width for x in ids], np.int64)
                    copies = []
                    for key in part.column("key").to_pylist():
                        copy = copy + 1 if last == (key,) else 0
                        last = (key,)
                        copies.append(copy)
                    out.write(b"".join(ids))
                    offsets = at + np.cumsum(counts) - counts
                    at += int(counts.sum())
                    found = [part.column("key"), pa.array(copies, pa.int64()), pa.array([shard] * len(part), pa.int32()), pa.array(offsets), pa.array(counts)]
                    yield pa.RecordBatch.from_arrays(found, names=["key", "copy", "shard", "offset", "n"])
        fs.move(own, f"{root}/shard-{shard:06d}.ids")

    entries = scratch.table(rows.mapInArrow(write, "key long, copy long, shard int, offset long, n long"))
    ends = [F.min_by("key", "offset").alias("first_key"), F.max_by("key", "offset").alias("last_key"), (F.max_by("copy", "offset") + 1).alias("last_copies")]
    made = entries.groupBy("shard").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("docs"), *ends).orderBy("shard").collect()
    parts = max(1, -(-sum(r["docs"] for r in made) // keys_in_part), int(spark.conf.get("spark.sql.shuffle.partitions")))
    if spans := copies_before(made):
        first = {r["shard"]: r["first_key"] for r in made}
        held = spark.createDataFrame([(s, first[s], n) for s, n in spans], "shard int, key long, held long")  # a row for a shard at most
        same = (entries["shard"] == held["shard"]) & entries["key"].eqNullSafe(held["key"])
        moved = (entries["copy"] + F.coalesce(held["held"], F.lit(0))).alias("copy")
        entries = entries.join(F.broadcast(held), same, "left").select(entries["key"], moved, entries["shard"], "offset", "n")

    def index(rows: pa.Table) -> pa.Table:
        number = rows.column("part")[0].as_py()
        built = IndexPart.build(*hashed_as(rows), *(rows.column(c).to_numpy() for c in ("shard", "offset", "n")))
        _put(folder, f"index-{number:06d}.mph", [built.to_bytes()])
        return pa.table({"part": pa.array([number], pa.int32()), "keys": pa.array([len(rows)], pa.int64())})

    built = scratch.table(entries.withColumn("part", part_of(parts)).groupBy("part").applyInArrow(index, "part int, keys long"))
    start, known = 0, []
    for r in made:
        known.append({"shard": r["shard"], "start": start, "ids": r["n"], "docs": r["docs"]})
        start += r["n"]
    width = Encoder(tokenizer).dtype.str
    empty = sorted({*range(parts)} - {r["part"] for r in built.select("part").collect()})
    _put(folder, "manifest.json", [json.dumps({"dtype": width, "end_id": end_id, "parts": parts, "empty": empty, "shards": known}).encode()])
    return folder


def read_store(spark: SparkSession, folder: str, keys: DataFrame, must_exist: bool = False) -> DataFrame:
    """(key, copy, start, n_tokens, ids_crc32) of every stored document of ``keys`` (key, copy), read from the files.

    Each key is looked up in its index part, and then its ids are read from its shard at the offset found there.
    start counts the ids of all documents before it in the store. Keys that aren't stored give no row, or an error if
    they ``must_exist``.
    """
    store = TokenStore(folder)
    manifest, empty = store.manifest, set(store.manifest["empty"])
    first = {s["shard"]: s["start"] for s in manifest["shards"]}

    def find(rows: pa.Table) -> pa.Table:
        number = rows.column("part")[0].as_py()
        if number in empty:
            at, part = np.full(len(rows), -1), None
        else:
            part = TokenStore(folder).part(number)
            at = part.find(*hashed_as(rows))
        if must_exist and (at < 0).any():
            raise KeyError(f"{int((at < 0).sum())} keys of index part {number} aren't stored")
        out = rows.select(["key", "copy"]).filter(pa.array(at >= 0))
        at = at[at >= 0]
        for name in ("shards", "offsets", "counts"):
            out = out.append_column(name, pa.array((getattr(part, name)[at] if part else at).astype(np.int64)))
        return out.rename_columns(["key", "copy", "shard", "offset", "n"])

    def read(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("offset")
        shard, own = rows.column("shard")[0].as_py(), TokenStore(folder)
        offsets, counts = rows.column("offset").to_numpy(), rows.column("n").to_numpy()
        crc = [zlib.crc32(x.astype("<u4").tobytes()) for x in own.ids(shard, zip(offsets, counts))]
        found = {"start": offsets + first[shard], "n_tokens": counts, "ids_crc32": np.array(crc, np.int64)}
        return pa.table({"key": rows.column("key"), "copy": rows.column("copy"), **{k: pa.array(v) for k, v in found.items()}})

    found = keys.select("key", F.col("copy").cast("long").alias("copy")).withColumn("part", part_of(manifest["parts"]))
    found = found.groupBy("part").applyInArrow(find, "key long, copy long, shard long, offset long, n long")
    return found.groupBy("shard").applyInArrow(read, "key long, copy long, start long, n_tokens long, ids_crc32 long")


def keys_of(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(key, copy) of every row of ``docs``."""
    rows = docs.groupBy(F.col(id_col).cast("long").alias("key")).agg(F.count(F.lit(1)).alias("rows"))
    return rows.select("key", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1)).alias("copy"))
