"""SentencePiece encoding by a relational lattice, and decoding.

A text is cut into parts wherever two neighbouring characters are in no piece, so that no piece reaches across: before
the spaces that start words, around line breaks and most marks, and within words that no piece holds as they are. The
distinct parts of all texts go through the lattice once: substrings of bounded length are exploded and equi-joined to the
piece table, the edges are grouped by part, and a higher-order aggregate() folds them by Viterbi: the path of the
greatest total score, of the fewest pieces among equals. For a unigram model that is the encoding. For a BPE model the
library returns another path; there a second fold runs over the same edges by merge priority, with the part's remaining
boundaries as its state: the best edge that spans exactly two current pieces, the leftmost among equals, removes the
boundary between them. Characters that no piece covers are spelt as bytes.

Every block of input then gets the parts that occur in it, as a sorted file in the shared folder, and each text is
assembled from its block's file, so that neither the texts nor their words are shuffled, and nothing that grows with the
corpus is broadcast.
"""

from __future__ import annotations

import functools
import heapq
import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import sentencepiece
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrasift.llm.scratch import Scratch, shared_folder

SPACE = "▁"
UNKNOWN_PENALTY = 10.0
#: Most characters of a part whose boundaries fit a bit mask.
MASK = 61
#: Bytes of an input file whose texts share a file of parts; what bounds such a file.
BLOCK_BYTES = 128 << 20
#: Bytes of text that are cut at a time.
CUT_BYTES = 4 << 20
FLUSH = 300_000
PARTS_IN_TASK = 16_384
BLOCKS_IN_ROW = 4096
_UNIT = re.compile(f"(?:{SPACE}+|\n)[^{SPACE}\n]*")


class Pieces:
    """What a model file says: its pieces with ids and scores, its byte pieces, and which characters meet in a piece."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        rows, base = [], -1
        for i in range(model.get_piece_size()):
            if model.is_byte(i):
                base = i if base < 0 else base
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                rows.append((model.id_to_piece(i), i, model.get_score(i)))
        if base < 0:
            raise ValueError("the model has no byte pieces")
        self.rows, self.byte_base = rows, base
        self.longest, self.least = max(len(p) for p, _, _ in rows), min(s for _, _, s in rows)
        inside = {p[k : k + 2] for p, _, _ in rows for k in range(len(p) - 1)}
        letters = sorted({c for pair in inside for c in pair})
        number = {c: k + 1 for k, c in enumerate(letters)}
        self.number = np.zeros(0x110000, np.uint16)  # 0 is in no pair
        self.number[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.meet = np.zeros((len(letters) + 1, len(letters) + 1), bool)
        self.meet[[number[a] for a, _ in inside], [number[b] for _, b in inside]] = True
        # no piece goes on into a run of spaces, or holds a line break: so texts can be cut there at once
        self.words = all(a == SPACE for a, b in inside if b == SPACE) and "\n" not in number

    def table(self, spark: SparkSession) -> DataFrame:
        """(piece, id, score, rank, late): equal scores have equal ranks, the best has 0. ``late`` pieces are those of which
        one half may be merged after them."""
        ranks = {v: k for k, v in enumerate(sorted({v for _, _, v in self.rows}, reverse=True))}
        rank = {p: ranks[v] for p, _, v in self.rows}

        def late(p: str) -> bool:
            halves = ((p[:k], p[k:]) for k in range(1, len(p)))
            made = ([x for x in two if len(x) > 1] for two in halves if all(len(x) == 1 or x in rank for x in two))
            return any(rank[x] >= rank[p] for two in made for x in two)

        rows = [(p, i, v, rank[p], late(p)) for p, i, v in self.rows]
        return spark.createDataFrame(rows, "piece string, id int, score double, rank int, late boolean")

    def units(self, text: str) -> list[str]:
        """Whole parts of a text in larger units, such as words, with its spaces written as the model writes them."""
        if not text:
            return []
        text = SPACE + text.replace(" ", SPACE)
        return _UNIT.findall(text) if self.words else [text]

    def parts(self, unit: str) -> list[str]:
        """The parts of a unit."""
        data = unit.encode("utf-8", "surrogatepass")
        cuts = np.flatnonzero(self.cuts(data)).tolist()
        return [data[a:b].decode("utf-8", "surrogatepass") for a, b in zip([0, *cuts], [*cuts, len(data)])] if unit else []

    def cuts(self, data: bytes | memoryview) -> np.ndarray:
        """At which bytes of a text in UTF-8, as the model writes it, a part begins; but for its first byte."""
        out = np.zeros(len(data), bool)
        chars = np.frombuffer(data, np.uint8) & 0xC0 != 0x80
        a = 0
        while a < len(data):  # some MB at a time, as its characters take four bytes each, and their places eight
            b = min(a + CUT_BYTES, len(data))
            while b < len(data) and not chars[b]:
                b += 1
            stop = b + 1  # with the first character of what follows
            while stop < len(data) and not chars[stop]:
                stop += 1
            text = str(data[a : min(stop, len(data))], "utf-8", "surrogatepass")
            codes = self.number[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")]
            starts = a + np.flatnonzero(chars[a : min(stop, len(data))])
            pairs = codes[:-1].astype(np.intp) * len(self.meet) + codes[1:]
            out[starts[1:][~self.meet.ravel().take(pairs)]] = True
            a = b
        return out

    def cut(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The parts of all texts, one after another, and where those of each text begin and the last ones end."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        spaced = pc.binary_join_element_wise(pa.scalar(SPACE, pa.large_string()), pc.replace_substring(texts, " ", SPACE), pa.scalar("", pa.large_string()))
        spaced = pc.if_else(pc.equal(texts, ""), "", spaced).cast(pa.large_string())
        ends = np.frombuffer(spaced.buffers()[1], np.int64, len(spaced) + 1, 8 * spaced.offset)
        if not len(spaced) or ends[0] == ends[-1]:
            return pa.array([], pa.large_string()), np.zeros(len(spaced) + 1, np.int64)
        data = spaced.buffers()[2].slice(int(ends[0]), int(ends[-1] - ends[0]))
        ends = ends - ends[0]
        begins = np.append(self.cuts(memoryview(data)), False)
        begins[ends] = True
        at = np.flatnonzero(begins)
        parts = pa.Array.from_buffers(pa.large_string(), len(at) - 1, [None, pa.py_buffer(at.astype("<i8")), data])
        return parts, np.searchsorted(at, ends)

    def decoder(self) -> list[str]:
        """The text of every id; byte pieces as surrogate escapes."""
        out = [""] * (max(max(i for _, i, _ in self.rows), self.byte_base + 255) + 1)
        for p, i, _ in self.rows:
            out[i] = p.replace(SPACE, " ")
        for b in range(256):
            out[self.byte_base + b] = chr(b) if b < 128 else chr(0xDC00 + b)
        return out


@functools.lru_cache(maxsize=1)
def pieces_of(path: str) -> Pieces:
    """The model that the tasks of a Python worker share."""
    return Pieces(path)


def decode_ids(ids: np.ndarray, strings: list[str]) -> str:
    """The text of a sequence of ids, without the space that encoding puts before it."""
    text = "".join(map(strings.__getitem__, ids.tolist()))
    if not text.isascii():
        text = text.encode("utf-8", "surrogateescape").decode("utf-8", "replace")
    return text[1:] if text[:1] == " " else text


def viterbi(edges: Column, reach: int) -> Column:
    """The ids on the best path through edges (e, s, v, ids) that are sorted by end and then start.

    The state holds the best paths to the latest positions only, as far back as a piece can ``reach``.
    """

    def step(reach: int):
        def merge(acc: Column, x: Column) -> Column:
            last = F.element_at(acc, -1)
            before = F.element_at(acc, (x["s"] - F.element_at(acc, 1)["at"] + 1).cast("int"))
            new = F.struct(x["e"].alias("at"), (before["v"] + x["v"]).alias("v"), F.concat(before["ids"], x["ids"]).alias("ids"))
            kept = F.when(F.size(acc) > reach, F.slice(acc, 2, reach)).otherwise(acc)
            better = F.when(before["v"] + x["v"] > last["v"], F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(new))).otherwise(acc)
            return F.when(last["at"] == x["e"], better).otherwise(F.concat(kept, F.array(new)))

        return merge

    start = F.array(F.struct(F.lit(0).alias("at"), F.lit(0.0).alias("v"), F.array().cast("array<int>").alias("ids")))
    return F.aggregate(edges, start, step(reach + 1), lambda acc: F.element_at(acc, -1)["ids"])


#: Room for the pieces of a part in a weight, where scores are whole numbers: weight = score * ROOM - pieces.
ROOM_BITS = 21
ROOM = 1 << ROOM_BITS


def best_path(edges: Column, length: Column, reach: int, whole: bool) -> Column:
    """(v, n): the total score of the best path through edges (e, s, w), sorted, to the end of a part, and its pieces, the
    fewest among equals.

    w is a struct (v, less) of an edge's score and its pieces, counted below zero; where scores are ``whole`` numbers it
    is one number, score * ROOM + less, which is quicker to add and compare. A step takes the edges that end at one
    position, which follow each other. The state holds the best of the latest positions only, as far back as a piece can
    ``reach``, so a part of any length is folded in the same memory.
    """

    def add(a: Column, b: Column) -> Column:
        return a + b if whole else F.struct((a["v"] + b["v"]).alias("v"), (a["less"] + b["less"]).alias("less"))

    def step(acc: Column, end: Column) -> Column:
        done = acc["done"]
        own = F.filter(F.slice(edges, acc["next"], F.least(F.lit(reach), end)), lambda x: x["e"] == end)
        paths = F.transform(own, lambda x: add(F.element_at(done, F.size(done) + x["s"] - end + 1), x["w"]))
        kept = F.when(F.size(done) > reach, F.slice(done, 2, reach)).otherwise(done)
        return F.struct((acc["next"] + F.size(own)).alias("next"), F.concat(kept, F.array(F.array_max(paths))).alias("done"))

    def found(acc: Column) -> Column:
        last = F.element_at(acc["done"], -1)
        if whole:
            v = -F.shiftright(-last, ROOM_BITS)  # less is above -ROOM
            return F.struct(v.cast("double").alias("v"), (v * ROOM - last).alias("n"))
        return F.struct(last["v"].alias("v"), (-last["less"]).alias("n"))

    zero = F.lit(0).cast("long")
    start = F.array(zero if whole else F.struct(F.lit(0.0).alias("v"), zero.alias("less")))
    return F.aggregate(F.sequence(F.lit(1), length), F.struct(F.lit(1).alias("next"), start.alias("done")), step, found)


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with the value worked out once, however often lambdas ask for it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


#: A packed edge of a part of at most MASK characters: its end and start, and below them what it costs, which is
#: pieces - score * SHORT_ROOM. Such a part has at most 4 * MASK pieces.
COST_BITS = 50
SHORT_ROOM = 256


def short_path(edges: Column) -> Column:
    """The (v, n) of ``best_path`` for a part of at most MASK characters with whole scores, over sorted, packed edges."""
    end = lambda x: F.shiftright(x, COST_BITS + 6)
    start = lambda x: F.shiftright(x, COST_BITS).bitwiseAND(F.lit(63))

    def step(acc: Column, x: Column) -> Column:
        # the best path to the latest position stands beside those to all before it
        before = F.when(start(x) == acc["at"], acc["best"]).otherwise(F.get(acc["done"], start(x).cast("int")))
        cost = before + x.bitwiseAND(F.lit((1 << COST_BITS) - 1))
        same = acc["at"] == end(x)
        return F.struct(
            end(x).alias("at"),
            F.when(same, F.least(acc["best"], cost)).otherwise(cost).alias("best"),
            F.when(same, acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["best"]))).alias("done"),
        )

    def found(acc: Column) -> Column:
        v = -F.shiftright(acc["best"], SHORT_ROOM.bit_length() - 1)
        return F.struct(v.cast("double").alias("v"), acc["best"].bitwiseAND(F.lit(SHORT_ROOM - 1)).alias("n"))

    zero = F.lit(0).cast("long")
    return F.aggregate(edges, F.struct(zero.alias("at"), zero.alias("best"), F.array().cast("array<long>").alias("done")), step, found)


def merged(edges: Column, length: Column) -> Column:
    """The ids that BPE leaves of a part of at most MASK characters; -1 - start stands for a character without a piece.

    ``edges``, sorted, are packed into long integers: rank, start, end, whether the piece is late, and id + 1. The state has
    a bit for each boundary that is left; an edge's ends are the bits ``need``, those between them ``inner``.

    One pass in order of rank does all merges if no edge fits after its turn. It would have to join a piece that was merged
    after it, so only late pieces can; after each merge, those before it are looked at. Where one fits, the part is merged
    step by step, each time from the first edge on; a part of n characters takes n - 1 merges at most.
    """
    bit = lambda n: F.call_function("shiftleft", F.lit(1).cast("long"), n)
    start = lambda x: F.shiftright(x, 31).bitwiseAND(F.lit(63)).cast("int")
    end = lambda x: F.shiftright(x, 25).bitwiseAND(F.lit(63)).cast("int")
    is_late = lambda x: x.bitwiseAND(F.lit(1 << 24)) != 0
    without = lambda left, inner: left.bitwiseAND(F.bitwise_not(inner))

    def bits(x: Column) -> Column:
        a, b = bit(start(x)), bit(end(x))
        return F.struct(a.bitwiseOR(b).alias("need"), (b - a - a).alias("inner"), x.alias("edge"))

    def fits(left: Column, x: Column) -> Column:
        return (left.bitwiseAND(x["need"]) == x["need"]) & (F.bit_count(left.bitwiseAND(x["inner"])) == 1)

    def in_order(merges: Column, late: Column) -> Column:
        def turn(left: Column, x: Column) -> Column:
            after = without(left, x["inner"])
            missed = F.exists(late, lambda y: (y["edge"] < x["edge"]) & fits(after, y))
            return F.when(fits(left, x), F.when(missed, F.lit(0).cast("long")).otherwise(after)).otherwise(left)  # nothing fits 0

        return F.aggregate(merges, whole, turn)

    def by_steps(merges: Column) -> Column:
        def step(state: Column, _: Column) -> Column:
            gone = F.get(F.filter(state["merges"], lambda x: fits(state["left"], x)), F.lit(0))["inner"]
            left = without(state["left"], F.coalesce(gone, F.lit(0).cast("long")))
            return F.struct(state["merges"].alias("merges"), left.alias("left"))

        first = F.struct(merges.alias("merges"), whole.alias("left"))
        return F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), length - 1)), first, step, lambda state: state["left"])

    def pieces(left: Column) -> Column:
        def stays(x: Column) -> Column:
            a, b = bit(start(x)), bit(end(x))
            return left.bitwiseAND(b + b - a) == a + b  # its ends are left, and nothing between them

        own = lambda x: F.struct(start(x).alias("s"), (x.bitwiseAND(F.lit((1 << 24) - 1)).cast("int") - 1).alias("id"))
        placed = F.sort_array(F.transform(F.filter(edges, stays), own))
        return F.transform(placed, lambda x: F.when(x["id"] < 0, -1 - x["s"]).otherwise(x["id"]))

    whole = bit(length + 1) - 1
    merges = F.transform(F.filter(edges, lambda x: end(x) - start(x) > 1), bits)

    def left(m: Column) -> Column:
        late = F.filter(m, lambda x: is_late(x["edge"]))
        return let(let(late, lambda own: in_order(m, own)), lambda done: F.when(done == 0, by_steps(m)).otherwise(done))

    return let(let(merges, left), pieces)


def merge_text(text: str, rank: dict[str, tuple[int, float]], byte_base: int) -> list[int]:
    """The same merges with a priority queue, for parts that are too long for a bit mask."""
    n = len(text)
    end, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    queue: list[tuple[float, int, int, int]] = []

    def offer(a: int, b: int) -> None:
        if 0 <= a and b < n and (got := rank.get(text[a : end[b]])):
            heapq.heappush(queue, (-got[1], a, b, end[b]))

    for k in range(n - 1):
        offer(k, k + 1)
    while queue:
        _, a, b, e = heapq.heappop(queue)
        if alive[a] and b < n and alive[b] and end[a] == b and end[b] == e:
            alive[b], end[a] = False, e
            if e < n:
                before[e] = a
                offer(a, e)
            if a:
                offer(before[a], a)
    out: list[int] = []
    for k in range(n):
        if alive[k]:
            part = text[k : end[k]]
            out += [rank[part][0]] if part in rank else [byte_base + x for x in part.encode("utf-8", "surrogatepass")]
    return out


def lattice(parts: DataFrame, pieces: Pieces, unigram: bool = False) -> DataFrame:
    """(text, ids, v_score, v_pieces) for distinct ``parts`` (text): the ids, and the best path's score and length.

    ``parts`` should be dealt by text already; what is exploded from a text stays where it is.
    """
    spark = parts.sparkSession
    texts = parts.select("text").withColumn("n", F.length("text"))
    starts = texts.select("text", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("s"))
    ends = F.sequence(F.col("s") + 1, F.least("n", F.col("s") + pieces.longest))
    span = F.expr("substring(text, s + 1, e - s)")
    spans = starts.select("text", "n", "s", F.explode(ends).alias("e")).withColumn("hash", F.xxhash64(span))
    # joined by 64-bit hashes, which are probed faster than strings; the strings are compared where these agree
    table = F.broadcast(pieces.table(spark).withColumn("hash", F.xxhash64("piece")))  # as large as the model file
    edges = spans.join(table, "hash", "left").withColumn("id", F.when(F.col("piece") == span, F.col("id"))).where("id is not null or e = s + 1")
    known = F.col("id").isNotNull()
    bytes_of = lambda c: F.expr(
        f"transform(sequence(1, octet_length({c})), i -> {pieces.byte_base} + cast(conv(substring(hex(encode({c}, 'utf-8')), 2 * i - 1, 2), 16, 10) as int))"
    )
    score = F.when(known, F.col("score")).otherwise(pieces.least - UNKNOWN_PENALTY).alias("v")
    count = F.when(known, F.lit(1)).otherwise(F.octet_length(span)).cast("long").alias("n")
    whole = all(float(v).is_integer() for _, _, v in pieces.rows)
    weight = score.cast("long") * ROOM - count if whole else F.struct(score, (-count).alias("less"))
    # parts that fit a bit mask have edges of one number each, which are gathered and sorted faster
    packs = whole and max(v for _, _, v in pieces.rows) <= 0 and (UNKNOWN_PENALTY - pieces.least) * SHORT_ROOM * 2 < 1 << COST_BITS
    short = (F.length("text") <= MASK) & F.lit(packs)
    place = F.col("e").cast("long") * (1 << COST_BITS + 6) + F.col("s").cast("long") * (1 << COST_BITS)
    path = F.sort_array(F.collect_list(F.when(~short, F.struct("e", "s", weight.alias("w"))))).alias("path")
    costs = F.sort_array(F.collect_list(F.when(short, place + count - score.cast("long") * SHORT_ROOM))).alias("costs")
    general = let(F.col("path"), lambda p: best_path(p, F.length("text"), pieces.longest, whole))
    best = F.when(short, short_path(F.col("costs"))).otherwise(general)
    if unigram:
        ids = F.when(known, F.array("id")).otherwise(bytes_of("substring(text, s + 1, 1)")).alias("ids")
        edge = F.sort_array(F.collect_list(F.struct("e", "s", score, ids))).alias("edges")
        grouped = edges.groupBy("text").agg(edge, path, costs)
        found = grouped.select("text", viterbi(F.col("edges"), pieces.longest).alias("ids"), best.alias("best"))
        return found.select("text", "ids", F.col("best.v").alias("v_score"), F.col("best.n").alias("v_pieces"))
    rank = F.when(known, F.col("rank")).otherwise(0).cast("long")
    span_at = F.col("s").cast("long") * (1 << 31) + F.col("e").cast("long") * (1 << 25)
    packed = rank * (1 << 37) + span_at + F.when(F.col("late"), 1 << 24).otherwise(0) + F.coalesce(F.col("id") + 1, F.lit(0))
    grouped = edges.groupBy("text").agg(F.sort_array(F.collect_list(F.when(F.col("n") <= MASK, packed))).alias("edges"), path, costs)
    folded = grouped.select("text", F.when(F.length("text") <= MASK, merged(F.col("edges"), F.length("text"))).alias("ids"), best.alias("best"))
    spelt = F.expr(
        "flatten(transform(ids, x -> if(x >= 0, array(x), transform(sequence(1, octet_length(substring(text, -x, 1))), i -> "
        f"{pieces.byte_base} + cast(conv(substring(hex(encode(substring(text, -x, 1), 'utf-8')), 2 * i - 1, 2), 16, 10) as int)))))"
    )
    merges = F.when(F.exists("ids", lambda x: x < 0), spelt).otherwise(F.col("ids")).alias("ids")
    return folded.select("text", merges, F.col("best.v").alias("v_score"), F.col("best.n").alias("v_pieces"))


def with_long_parts(folded: DataFrame, pieces: Pieces) -> DataFrame:
    """``folded`` with the merges of parts that are too long for a bit mask, which lattice() leaves out."""
    rank, base = {p: (i, v) for p, i, v in pieces.rows}, pieces.byte_base
    long_ = F.pandas_udf(lambda x: x.map(lambda t: merge_text(t, rank, base)), "array<int>")
    rest = folded.where("ids is null").select("text", long_("text").alias("ids"), "v_score", "v_pieces")
    return folded.where("ids is not null").union(rest)


def with_blocks(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text, block) of a table that is read from files: a block is a bounded part of a file."""
    part = F.floor(F.input_file_block_start() / F.lit(BLOCK_BYTES))
    return docs.select(
        F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.xxhash64(F.input_file_name(), part).alias("block")
    )


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", from_files: bool = False, unigram: bool = False) -> DataFrame:
    """One row per row of ``docs``: id, ids, n_parts, n_pieces, ids_crc32, round_trip, v_pieces, v_score.

    ids is the encoding of the whole text; null and empty texts have none. ids_crc32 is the unsigned crc32 of the ids as
    little-endian 32-bit integers. round_trip tells whether decoding the ids gives the text again (a text that holds the
    escaped space itself, U+2581, is decoded with a space there). v_score and v_pieces are the total score of the
    lattice's best path through the whole text and its number of pieces, whatever the kind of the model. Texts and their
    parts may be of any length. Ids may be strings or whole numbers; rows with repeated or null ids are encoded row by
    row. Other columns are not read. An empty table gives no rows. ``from_files`` says that ``docs`` is a plain read of
    files, whose parts serve as blocks; any other table is written to the shared folder first. ``unigram`` says that the
    model is a unigram model, not BPE.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    if not from_files:
        docs = scratch.table(docs.select(F.col(id_col), F.col(text_col)))
    rows = with_blocks(docs, id_col, text_col)

    def parts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, seen, block = pieces_of(model), set(), None

        def found() -> Iterator[pa.RecordBatch]:
            if seen:
                names = pa.array(seen, pa.string())
                seen.clear()
                yield pa.RecordBatch.from_arrays([names, pa.array(np.full(len(names), block, np.int64))], names=["text", "block"])

        for batch in batches:
            for b, rows in runs(batch):
                if b != block or len(seen) >= FLUSH:
                    yield from found()
                    block = b
                seen.update(strings_of(pc.unique(own.cut(rows.column("text"))[0])))
        yield from found()

    # a part is a row for every few thousand blocks that it occurs in: short where blocks are few, bounded where they are many
    lists = -(-rows.select("block").distinct().count() // BLOCKS_IN_ROW) or 1
    found = rows.select("text", "block").mapInArrow(parts_of, "text string, block long")
    listed = found.groupBy("text", F.pmod(F.col("block"), F.lit(lists)).alias("list")).agg(F.collect_set("block").alias("blocks"))
    listed = scratch.table(listed.drop("list"))
    parts = listed.select("text") if lists == 1 else scratch.table(listed.select("text").distinct())
    # a part becomes a hundred rows, so its few bytes are spread over many more tasks than their size asks for
    spread = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-parts.count() // PARTS_IN_TASK))
    folded = lattice(parts.repartition(spread, "text"), pieces_of(model), unigram)
    with scratch.grouping(4 * PARTS_IN_TASK):  # a task's parts are bounded, so their edges are grouped without sorting
        encoded = scratch.table(folded)
    if not unigram:
        encoded = with_long_parts(encoded, pieces_of(model))
    again = F.shiftright(F.xxhash64(F.lit(AGAIN), "text"), 32).cast("int").alias("again")
    dealt = listed.join(encoded, "text").select(F.explode("blocks").alias("block"), F.xxhash64("text").alias("hash"), again, "ids", "v_score", F.col("v_pieces").cast("int"))
    folder = shared_folder(spark) + "/parts"

    def write(group: pa.Table) -> pa.Table:
        block = group.column("block")[0].as_py()
        group = group.combine_chunks().sort_by([("hash", "ascending"), ("again", "ascending")])
        lists = group.column("ids").combine_chunks()
        lists = lists if isinstance(lists, pa.ListArray) else lists.chunk(0)
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        own = f"{root}/.{block}.{uuid.uuid4().hex}"
        with fs.open_output_stream(own) as raw, pa.CompressedOutputStream(raw, "zstd") as out:
            out.write(np.array([len(group)], "<i8").tobytes())
            for name, kind in COLUMNS:
                out.write(group.column(name).to_numpy().astype(kind).tobytes())
            out.write(np.diff(lists.offsets.to_numpy()).astype("<i4").tobytes())
            out.write(lists.flatten().to_numpy().astype("<i4").tobytes())
        fs.move(own, f"{root}/{block}")
        return pa.table({"block": pa.array([block], pa.int64()), "parts": pa.array([len(group)], pa.int64())})

    scratch.table(dealt.groupBy("block").applyInArrow(write, "block long, parts long"))

    id_type = pa.string() if dict(rows.dtypes)["id"] == "string" else pa.int64()

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, file, block = pieces_of(model), None, None
        strings = pa.array([x.encode("utf-8", "surrogateescape") for x in own.decoder()], pa.large_binary())
        for batch in batches:
            for b, rows in runs(batch):
                if b != block:
                    block, file = b, PartFile.read(folder, b)
                for few in slices(rows):
                    yield assembled(few, own, file, strings)

    def assembled(rows: pa.RecordBatch, own: Pieces, file: PartFile, strings: pa.Array) -> pa.RecordBatch:
        parts, first = own.cut(rows.column("text"))
        coded = parts.dictionary_encode()
        which, at = coded.indices.to_numpy(), file.places(strings_of(coded.dictionary))
        ids, ends = file.ids_at(at, which)
        ends = ends[first]
        raw = memoryview(ids).cast("B")
        spans = [*zip(ends.tolist(), ends[1:].tolist())]
        crc = [zlib.crc32(raw[4 * a : 4 * z]) for a, z in spans]
        decoded = pc.take(strings, pa.array(ids))  # all ids at once; what belongs to one text lies together
        at_byte = np.frombuffer(decoded.buffers()[1], np.int64, len(ids) + 1, 8 * decoded.offset)[ends].tolist()
        spelt = memoryview(decoded.buffers()[2] or b"").cast("B")
        texts = rows.column("text").cast(pa.binary()).to_pylist()
        same = [spelt[a:z] == (b" " + text if text else b"") for a, z, text in zip(at_byte, at_byte[1:], texts)]
        best = [sums(file.columns[c][at][which], first, kind) for c, kind in (("v_pieces", np.int64), ("v_score", np.float64))]
        lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))
        names = ["id", "ids", "n_parts", "n_pieces", "ids_crc32", "round_trip", "v_pieces", "v_score"]
        plain = [pa.array(np.diff(first)), pa.array(np.diff(ends)), pa.array(crc, pa.int64()), pa.array(same, pa.bool_()), *map(pa.array, best)]
        return pa.RecordBatch.from_arrays([rows.column("id").cast(id_type), lists, *plain], names=names)

    kind = "string" if id_type == pa.string() else "long"
    schema = f"id {kind}, ids array<int>, n_parts long, n_pieces long, ids_crc32 long, round_trip boolean, v_pieces long, v_score double"
    return rows.withColumn("id", F.col("id").cast(kind)).mapInArrow(assemble, schema)


def strings_of(names: pa.Array) -> list[str]:
    """The same as to_pylist(), which makes an object for every value first."""
    return names.to_numpy(zero_copy_only=False).tolist()


def runs(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    """The blocks of a batch, with their rows, which follow each other."""
    blocks = batch.column("block").to_numpy()
    at = [0, *(np.flatnonzero(np.diff(blocks)) + 1).tolist(), len(blocks)]
    for a, b in zip(at, at[1:]):
        if a < b:
            yield int(blocks[a]), batch.slice(a, b - a)


def slices(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Rows in slices of some MB of text, or of one row."""
    size = np.cumsum(pc.binary_length(rows.column("text")).to_numpy(zero_copy_only=False))
    a = 0
    while a < len(rows):
        b = max(a + 1, int(np.searchsorted(size, (size[a - 1] if a else 0) + CUT_BYTES, "right")))
        yield rows.slice(a, b - a)
        a = b


def sums(values: np.ndarray, first: np.ndarray, kind: type) -> np.ndarray:
    """The sums of values from each place in ``first`` to the next one."""
    out, some = np.zeros(len(first) - 1, kind), np.diff(first) > 0
    if some.any():
        out[some] = np.add.reduceat(values.astype(kind), first[:-1][some])
    return out


#: Spark's xxhash64 of a part, and the upper half of one with a prefix, which tells parts of one hash apart.
AGAIN = "again"
COLUMNS = (("hash", "<i8"), ("again", "<i4"), ("v_score", "<f8"), ("v_pieces", "<i4"))


def hashes_of(parts: list[str], prefix: str | None = None) -> np.ndarray:
    """The hashes of parts as Spark's xxhash64 gives them, or the upper halves of those after a prefix column."""
    seed = 42 if prefix is None else xxhash.xxh64_intdigest(prefix.encode(), 42)
    whole = np.array([xxhash.xxh64_intdigest(p.encode("utf-8", "surrogatepass"), seed) for p in parts], np.uint64).view(np.int64)
    return whole if prefix is None else (whole >> 32).astype(np.int32)


@dataclass
class PartFile:
    """The parts of one block, sorted by both hashes: score and pieces of the best path, and the ids of each."""

    columns: dict[str, np.ndarray]
    offsets: np.ndarray
    raw: bytes | memoryview

    @classmethod
    def read(cls, folder: str, block: int) -> PartFile:
        fs, root = pafs.FileSystem.from_uri(folder)
        with fs.open_input_stream(f"{root}/{block}") as f, pa.CompressedInputStream(f, "zstd") as out:
            raw = out.read()
        n = int(np.frombuffer(raw, "<i8", 1)[0])
        columns, at = {}, 8
        for name, kind in COLUMNS:
            columns[name] = np.frombuffer(raw, kind, n, at)
            at += columns[name].nbytes
        counts = np.frombuffer(raw, "<i4", n, at)
        return cls(columns, np.concatenate([[0], np.cumsum(counts, dtype=np.int64)]), memoryview(raw)[at + 4 * n :])

    def places(self, parts: list[str]) -> np.ndarray:
        """Where parts stand."""
        own, hashes = self.columns["hash"], hashes_of(parts)
        at, end = np.searchsorted(own, hashes), np.searchsorted(own, hashes, "right")
        if (at == end).any():
            raise KeyError("a part is not in its block's file")
        for k in np.flatnonzero(end - at > 1):  # parts of one hash: the other one decides
            at[k] += np.searchsorted(self.columns["again"][at[k] : end[k]], hashes_of([parts[k]], AGAIN)[0])
        return at

    def ids_at(self, places: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the parts at ``places[which]``, one after another, and where those of each begin and the last ones end."""
        starts, counts = self.offsets[places][which], (self.offsets[places + 1] - self.offsets[places])[which]
        ends = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
        own = np.repeat(starts - ends[:-1], counts) + np.arange(ends[-1])
        return np.frombuffer(self.raw, "<i4")[own], ends

    def find(self, parts: list[str]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """The ids of parts as bytes, and the pieces and the scores of their best paths."""
        at = self.places(parts)
        ids = [bytes(self.raw[a:b]) for a, b in zip((4 * self.offsets[at]).tolist(), (4 * self.offsets[at + 1]).tolist())]
        return ids, self.columns["v_pieces"][at], self.columns["v_score"][at]


def decode(encoded: DataFrame, model: str, ids_col: str = "ids") -> DataFrame:
    """``encoded`` with a column ``decoded``: the text of its ids. Null ids give null."""
    strings = pieces_of(model).decoder()

    @F.pandas_udf("string")
    def text_of(ids: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else decode_ids(np.asarray(x, np.int64), strings) for x in ids], dtype=object)

    return encoded.withColumn("decoded", text_of(F.col(ids_col)))
