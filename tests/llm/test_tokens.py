"""Token files, SentencePiece, vector search, formatting and the pipeline against libraries and brute force."""

import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from terrasift.llm import pieces, preference, queries, token_store, toxicity, vector_search
from tests.llm.test_dedup import brute_components
from tests.oracle import connect, rows

SF = "/root/testdata/sf0.01"
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")
ODD_TEXTS = ["", " ", "  a", "a  b", "\x01x y", "▁a ▁▁b", "x\n\ny", "\n a", "日本語 テスト。", "é" * 70, "http://a.b/c?d=e&f" * 9, "tab\tx", "🙂x🙂", "a,b.c, d. e.", "3.14, x", ",a ,b", "it's  we'll", "<|endoftext|>"]
alphabet = st.text(alphabet="ab .,\né1▁'\x01the\t", max_size=25)


@pytest.fixture(scope="module")
def encoder():
    return token_store.Encoder(BYTE_BPE)


def library_ids(encoder, text):
    return encoder.tokenizer.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(alphabet)
def test_pieces_between_spaces_are_encoded_like_whole_texts(text):
    e = token_store.encoder_of(BYTE_BPE)
    assert np.frombuffer(e.encode(text), e.dtype).tolist() == library_ids(e, text)


@pytest.mark.parametrize("n", [0, 1, 2, 3, 50, 5000])
def test_perfect_hash(n):
    keys = np.random.default_rng(n).choice(10**9, n, replace=False)
    part = token_store.IndexPart.build(keys, np.zeros(n, np.int64), np.arange(n), np.arange(n) * 3, np.arange(n) % 7)
    back = token_store.IndexPart.from_bytes(part.to_bytes())
    at = back.find(keys, np.zeros(n, np.int64))
    assert sorted(at.tolist()) == list(range(n))  # minimal and perfect
    assert (back.offsets[at] == np.arange(n) * 3).all() and (back.counts[at] == np.arange(n) % 7).all()
    strangers = np.arange(2 * 10**9, 2 * 10**9 + 200)
    assert (back.find(strangers, np.zeros(200, np.int64)) >= 0).sum() <= 1


def test_store_gives_back_every_document(spark, encoder):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: r for r in queries.op6_token_store(spark, SF).collect()}
    start = 0
    for r in docs.orderBy("doc_id").collect():
        ids = [*library_ids(encoder, r.text), 2]
        own = got.pop(r.doc_id)
        assert (own.start, own.n_tokens, own.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert not got


def test_store_of_odd_rows(spark, encoder):
    data = [(3, None), (3, "b"), (3, "b"), (None, "x"), (1, ""), (9, "y " * 40_000)]
    docs = spark.createDataFrame(data, "doc_id long, text string").withColumn("key", F.lit(1))
    folder = token_store.write_store(docs, BYTE_BPE)
    got = token_store.read_store(spark, folder, token_store.keys_of(docs), must_exist=True).orderBy("start").collect()
    assert [(r.key, r.copy) for r in got] == [(None, 0), (1, 0), (3, 0), (3, 1), (3, 2), (9, 0)]
    assert [r.n_tokens for r in got][:2] == [2, 1] and sorted(r.n_tokens for r in got[2:5]) == [1, 2, 2]
    missing = spark.createDataFrame([(77, 0), (3, 9)], "key long, copy long")
    assert token_store.read_store(spark, folder, missing).count() == 0
    with pytest.raises(Exception, match="aren't stored"):
        token_store.read_store(spark, folder, missing, must_exist=True).count()
    with pytest.raises(TypeError):
        token_store.write_store(docs.withColumn("doc_id", F.lit("a")), BYTE_BPE)
    empty = token_store.write_store(docs.limit(0), BYTE_BPE)
    assert token_store.read_store(spark, empty, token_store.keys_of(docs)).count() == 0


def stored(spark, docs, **how):
    folder = token_store.write_store(docs, BYTE_BPE, **how)
    return token_store.read_store(spark, folder, token_store.keys_of(docs), must_exist=True).orderBy("start").collect()


def test_store_keeps_large_ids_beside_a_null_one(spark):
    ids = [None, 2**60 + 1, 2**60 + 2, 2**63 - 1, -(2**63), -(2**63) + 1, 0, None]
    docs = spark.createDataFrame([(i, f"t{k}") for k, i in enumerate(ids)], "doc_id long, text string").coalesce(1)
    got = stored(spark, docs)
    assert Counter(r.key for r in got) == Counter(ids)
    assert [r.key for r in got] == [None, None, *sorted(i for i in ids if i is not None)]


def test_rows_of_one_id_span_shards(spark, encoder):
    texts = [" ".join(["ab"] * k) for k in range(1, 60)]
    docs = spark.createDataFrame([(7, t) for t in texts] + [(3, "x"), (9, "y"), (None, "z"), (None, "w")], "doc_id long, text string")
    got = stored(spark, docs, shards=6)
    assert [(r.key, r.copy) for r in got] == [(None, 0), (None, 1), (3, 0), *((7, k) for k in range(59)), (9, 0)]
    ids = lambda t: zlib.crc32(np.array([*library_ids(encoder, t), 2], "<u4").tobytes())
    assert Counter(r.ids_crc32 for r in got if r.key == 7) == Counter(map(ids, texts))


def test_copies_before_a_shard():
    row = lambda shard, a, b, n: {"shard": shard, "first_key": a, "last_key": b, "last_copies": n}
    assert token_store.copies_before([row(0, 1, 5, 2), row(1, 5, 5, 4), row(3, 5, 6, 1), row(4, 7, 7, 3)]) == [(1, 2), (3, 6)]
    assert token_store.copies_before([row(0, None, None, 2), row(1, None, 1, 1)]) == [(1, 2)]


def test_keys_of_one_hash_take_another_seed(monkeypatch):
    plain = token_store.key_hashes
    monkeypatch.setattr(token_store, "key_hashes", lambda k, c, seed: np.zeros(len(k), np.uint64) if seed == 1 else plain(k, c, seed))
    keys, none = np.arange(9), np.zeros(9, np.int64)
    part = token_store.IndexPart.from_bytes(token_store.IndexPart.build(keys, none, keys, keys, keys).to_bytes())
    assert part.seed == 3 and sorted(part.find(keys, none).tolist()) == list(range(9))


@pytest.fixture(scope="module")
def model():
    return pieces.pieces_of(PIECE_BPE), sentencepiece.SentencePieceProcessor(model_file=PIECE_BPE)


@settings(max_examples=500, deadline=None)
@given(alphabet)
def test_parts_are_encoded_like_whole_texts(text):
    own, library = pieces.pieces_of(PIECE_BPE), sentencepiece.SentencePieceProcessor(model_file=PIECE_BPE)
    rank = {p: (i, v) for p, i, v in own.rows}
    got = [i for unit in own.units(text) for part in own.parts(unit) for i in pieces.merge_text(part, rank, own.byte_base)]
    assert got == library.encode(text)


def test_lattice_gives_the_library_s_ids(spark, model):
    data = [(i, t) for i, t in enumerate(ODD_TEXTS)] + [(99, None), (99, "again"), (None, "no id")]
    table = spark.createDataFrame(data, "doc_id long, text string").withColumn("ids", F.lit(0))
    got = pieces.encode(table, PIECE_BPE).collect()
    want = Counter((i, tuple(model[1].encode(t or ""))) for i, t in data)
    assert Counter((r.id, tuple(r.ids)) for r in got) == want
    lossy = {i for i, t in data if t and "▁" in t}
    assert all(r.round_trip == (r.id not in lossy) for r in got)
    texts = pieces.decode(pieces.encode(table, PIECE_BPE), PIECE_BPE).where("id = 8").first().decoded
    assert texts == ODD_TEXTS[8]
    assert pieces.encode(table.limit(0), PIECE_BPE).count() == 0


def test_whole_documents_are_encoded_like_the_library_does(spark, model):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: r for r in queries.op9_sentencepiece(spark, SF).collect()}
    for r in docs.collect():
        ids = model[1].encode(r.text or "")
        assert (got[r.doc_id].n_pieces, got[r.doc_id].ids_crc32) == (len(ids), zlib.crc32(np.array(ids, "<i4").tobytes()))
        assert got[r.doc_id].round_trip


def test_viterbi_finds_the_best_path(spark, model):
    """For unigram models: the total score of the lattice's path is the greatest there is."""
    own = model[0]
    by_id = {i: p for p, i, _ in own.rows}
    words = ["▁the", "▁thonning", "▁worthless", "ination", "aab", "▁eouérable", "w" * 90, "▁日" + "é" * 70]
    got = pieces.lattice(spark.createDataFrame([(w,) for w in words], "text string"), own, unigram=True).collect()
    score = {p: v for p, _, v in own.rows}
    for r in got:
        assert (r.v_score, r.v_pieces) == brute_path(own, r.text)
        if "日" not in r.text:
            assert "".join(by_id[i] for i in r.ids) == r.text and sum(score[by_id[i]] for i in r.ids) == r.v_score


def brute_path(own, text, remembered={}):
    """The greatest score of a path through a whole text, as the model writes it, and its fewest pieces."""
    score = remembered.setdefault(id(own), {p: v for p, _, v in own.rows})
    best = [(0.0, 0)] + [(-np.inf, 0)] * len(text)
    for e in range(1, len(text) + 1):
        for s in range(max(0, e - own.longest), e):
            part = text[s:e]
            if part in score or e - s == 1:
                v = score.get(part, own.least - pieces.UNKNOWN_PENALTY)
                n = 1 if part in score else len(part.encode())
                best[e] = max(best[e], (best[s][0] + v, best[s][1] - n))
    return best[-1][0], -best[-1][1]


def test_best_paths_of_whole_documents(spark, model):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: r for r in queries.op9_sentencepiece(spark, "/root/testdata/sf0.001").collect()}
    for r in docs.collect():
        text = pieces.SPACE + r.text.replace(" ", pieces.SPACE) if r.text else ""
        v, n = brute_path(model[0], text)
        assert got[r.doc_id].v_pieces == n and abs(got[r.doc_id].v_score - v) <= 1e-9 * abs(v)


def test_long_parts_are_encoded_too(spark, model):
    data = [(0, "w" * 3000), (1, "a " + "é" * 500 + " b"), (2, "x" * 62), (3, "y" * 61)]
    got = {r.id: r for r in pieces.encode(spark.createDataFrame(data, "doc_id long, text string"), PIECE_BPE).collect()}
    for i, text in data:
        assert list(got[i].ids) == model[1].encode(text) and got[i].round_trip
        assert (got[i].v_score, got[i].v_pieces) == brute_path(model[0], pieces.SPACE + text.replace(" ", pieces.SPACE))


def test_parts_of_one_hash_are_told_apart(monkeypatch):
    plain = pieces.hashes_of
    monkeypatch.setattr(pieces, "hashes_of", lambda parts, prefix=None: plain(parts, prefix) if prefix else np.zeros(len(parts), np.int64))
    names = ["a", "b", "c"]
    order = np.argsort(plain(names, pieces.AGAIN))
    columns = {"hash": np.zeros(3, np.int64), "again": plain(names, pieces.AGAIN)[order], "v_score": np.array([0.0, 1.0, 2.0])[order], "v_pieces": np.arange(3)[order]}
    file = pieces.PartFile(columns, np.arange(4), order.astype("<i4").tobytes())
    raw, n, v = file.find(names)
    assert [int(np.frombuffer(x, "<i4")[0]) for x in raw] == n.tolist() == v.tolist() == [0, 1, 2]


def test_hashes_are_those_of_spark(spark):
    texts = ["", "a", "▁the", "é" * 40]
    second = F.shiftright(F.xxhash64(F.lit(pieces.AGAIN), "t"), 32).cast("int").alias("b")
    rows_ = spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.xxhash64("t").alias("a"), second).collect()
    assert [r.a for r in rows_] == pieces.hashes_of(texts).tolist()
    assert [r.b for r in rows_] == pieces.hashes_of(texts, pieces.AGAIN).tolist()


def brute_top(ids, vectors, wanted, k=5):
    ints = np.floor(256 * vectors.astype(float)).astype(np.int64)
    out = []
    for q in wanted:
        score = ints @ ints[ids.index(q)]
        best = sorted((i for i in range(len(ids)) if ids[i] != q), key=lambda i: (-score[i], ids[i]))[:k]
        out += [(q, n + 1, ids[i], int(score[i])) for n, i in enumerate(best)]
    return sorted(out)


def test_vector_search_is_what_sql_says(spark):
    got = queries.op7_vector_top_k(spark, SF).toPandas()
    assert rows(got) == rows(connect(SF).execute(vector_search.ORACLE_SQL).df())


def test_vector_search_with_ties_and_odd_rows(spark):
    rng = np.random.default_rng(3)
    vectors = np.round(rng.normal(size=(120, 5)), 1).astype(np.float32)
    vectors[20:70] = vectors[0]  # a very common vector
    good = [(int(i), v.tolist()) for i, v in enumerate(vectors)]
    bad = [(200, None), (250, [1.0, None, 1.0, 1.0, 1.0]), (300, [float("nan")] * 5), (350, [float("inf")] * 5), (None, [1.0] * 5)]
    table = spark.createDataFrame(good + bad + [good[3]], "vec_id long, embedding array<float>").withColumn("score", F.lit("clash"))
    for bits in (2, 6):
        got = vector_search.top_k(table, F.col("vec_id") % 10 == 0, bits=bits, batch=2).collect()
        assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == brute_top(list(range(120)), vectors, range(0, 120, 10))
    assert vector_search.top_k(table.limit(0), F.lit(True)).count() == 0
    few = spark.createDataFrame(good[:3], "vec_id long, embedding array<float>")
    assert vector_search.top_k(few, F.lit(True)).count() == 6


def brute_rows(data, wanted, k=5):
    """As the SQL has it: every pair of a query's row and a row of another id; what a vector lacks counts as 0."""
    out = []
    for q in sorted({i for i, _ in data if wanted(i)}):
        pairs = sorted((-sum(a * b for a, b in zip(x, y)), j) for i, x in data if i == q for j, y in data if j != q)
        out += [(q, n + 1, j, -score) for n, (score, j) in enumerate(pairs[:k])]
    return sorted(out)


@pytest.mark.parametrize("bits", [2, 6])
def test_vector_search_of_ids_with_several_vectors(spark, bits):
    rng = np.random.default_rng(5)
    ints = lambda n: [[int(x) for x in v] for v in rng.integers(-40, 40, (n, 4))]
    data = [(0, v) for v in ints(6)] + [(i, v) for i, v in enumerate(ints(39), 1)] + [(10, v) for v in ints(3)] + [(20, []), (21, [5]), (40, [1, 2]), (0, [-7, 1, 2, 3])]
    data += [(30, data[0][1]), (31, data[0][1])]
    table = spark.createDataFrame([(i, [x / 256 for x in v]) for i, v in data], "vec_id long, embedding array<double>")
    got = vector_search.top_k(table, F.col("vec_id") % 10 == 0, bits=bits).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == brute_rows(data, lambda i: i % 10 == 0)


def test_vectors_of_great_magnitude(spark):
    rng = np.random.default_rng(6)
    data = [(i, [int(x) for x in v]) for i, v in enumerate(rng.integers(-(2**30), 2**30, (60, 3)))]  # scores beyond 2**53
    table = spark.createDataFrame([(i, [x / 256 for x in v]) for i, v in data], "vec_id long, embedding array<double>")
    got = vector_search.top_k(table, F.col("vec_id") % 10 == 0).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == brute_rows(data, lambda i: i % 10 == 0)
    for x in (1e12, 1e18, 1e300):
        huge = spark.createDataFrame([(0, [x, 1.0]), (1, [1.0, x])], "vec_id long, embedding array<double>")
        with pytest.raises(ValueError, match="64 bits"):
            vector_search.top_k(huge, F.lit(True))


def test_bounds_hold():
    rng = np.random.default_rng(0)
    v, q = rng.integers(-90, 90, (300, 8)), rng.integers(-90, 90, (20, 8))
    low, width = vector_search.cell_edges(v.min(axis=0), v.max(axis=0), 3)
    upper, lower = vector_search.bounds(q, (v - low) // width, low, width, v.max(axis=0))
    exact = q @ v.T
    assert (lower <= exact).all() and (exact <= upper).all()


def test_preferences_are_what_sql_says(spark):
    got = queries.op2_preference_format(spark, SF).toPandas()
    assert rows(got) == rows(connect(SF).execute(preference.ORACLE_SQL).df())


def test_preferences_of_odd_pairs(spark):
    turn = "array<struct<role: string, text: string>>"
    a, b, c = ("user", "q"), ("assistant", "yes"), ("assistant", "no")
    data = [(1, [a, b], [a, c]), (2, [a, b], [a, b]), (3, [b], [c]), (4, None, [a]), (5, [a, b, a], [a, b]), (6, [], []), (1, [a, b], [a, c])]
    got = {r.key: r for r in preference.format_preferences(spark.createDataFrame(data, f"key long, chosen {turn}, rejected {turn}")).collect()}
    assert got[1].prompt == "<|user|>\nq<|end|>\n" and got[1].prompt_turns == 1
    span = got[1].chosen_mask[0]
    assert got[1].chosen[span["from"] : span["to"]] == "yes<|end|>\n" and got[1].rejected == "<|assistant|>\nno<|end|>\n"
    assert (got[2].chosen, got[2].rejected, got[2].prompt_turns) == ("", "", 2)
    assert got[3].prompt == "" and got[4].prompt == "" and got[4].chosen == ""
    assert got[5].rejected == "" and got[5].chosen_mask == [] and got[6].prompt_turns == 0
    null = spark.createDataFrame([(1, [("user", None), ("assistant", "a")], [(None, "q"), None]), (2, [(None, None)], [("unknown", "")])], f"key long, chosen {turn}, rejected {turn}")
    got = {r.key: r for r in preference.format_preferences(null.withColumn("prompt", F.lit("clash")).withColumn("n", F.lit(9))).collect()}
    assert got[1].chosen == "<|user|>\n<|end|>\n<|assistant|>\na<|end|>\n" and got[1].rejected == "<|unknown|>\nq<|end|>\n<|unknown|>\n<|end|>\n"
    assert [(x["from"], x["to"]) for x in got[1].chosen_mask] == [(31, 40)] and got[2].prompt_turns == 1 and got[2].chosen == ""


def brute_pairs(turns):
    """(id, status, chosen, rejected) by the docstring's words; ``turns`` are rows (conv_id, turn, role, text)."""
    convs = {}
    for i, n, role, text in turns:
        if i is not None:
            convs.setdefault(i, []).append((-1 if n is None else n, role or "unknown", text or ""))
    convs = {i: [t[1:] for t in sorted(v)] for i, v in convs.items()}
    said = [i for i in sorted(convs) if any(r == "assistant" for r, _ in convs[i])]
    off = {}
    for k, i in enumerate(said):
        at = [n for n, (r, _) in enumerate(convs[i]) if r == "assistant"]
        off[i] = at[k % len(at)]
    out = {i: ("no reply", convs[i], convs[i]) for i in convs if i not in off}
    for k, i in enumerate(said):
        j = said[(k + 1) % len(said)]
        out[i] = ("pair", convs[i], convs[i][: off[i]] + convs[j][off[j] :]) if len(said) > 1 else ("alone", convs[i], convs[i])
    return out


@pytest.mark.parametrize("rows_", [
    [(0, 1, "assistant", "a"), (0, 0, None, None), (1, 0, "assistant", "b"), (None, 0, "user", "x"), (2, 0, "user", "y"), (1, 1, "user", "t" * 90_000), (1, 2, "assistant", "c"), (5, 0, "assistant", None), (5, None, "user", "q")],
    [(0, 0, "user", "a"), (0, 1, "assistant", "b"), (3, 0, "user", "c")],
    [(4, 0, "user", "a")],
    [],
])
def test_pairs_lose_no_conversation(spark, rows_):
    table = spark.createDataFrame(rows_, "conv_id long, turn long, role string, text string").withColumn("key", F.lit(0)).withColumn("k", F.lit(0))
    plain = lambda c: [(t.role, t.text) for t in c]
    got = {r.key: (r.status, plain(r.chosen), plain(r.rejected)) for r in preference.pairs_of(table).collect()}
    assert got == brute_pairs(rows_)
    assert preference.format_preferences(preference.pairs_of(table)).count() == len(got)


def test_pairs_turn_off_at_any_reply(spark):
    turns = spark.read.parquet(f"{SF}/conversations.parquet")
    got = preference.format_preferences(preference.pairs_of(turns)).collect()
    assert len(got) == turns.select("conv_id").distinct().count()
    pairs = [r for r in got if r.status == "pair"]
    assert len({r.prompt_turns for r in pairs}) > 2 and any(r.chosen.count("<|assistant|>") > 1 for r in pairs)


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 400").cache()
    calm = corpus_pipeline.drop_toxic(spark, docs, SF).cache()
    words = {"idiot", "moron", "scum", "worthless", "clown", "loser", "pathetic", "trash", "stupid", "disgusting"}
    dropped = docs.join(calm.select("doc_id"), "doc_id", "left_anti").collect()
    assert dropped and calm.columns == docs.columns and docs.count() == calm.count() + len(dropped)
    assert np.mean([any(w in words for w in toxicity._WORD.findall(r.text.lower())) for r in dropped if r.lang == "en"]) > 0.9
    one = corpus_pipeline.drop_copies(spark, calm, SF).cache()
    first = {}
    for r in calm.orderBy("doc_id").collect():
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r.text), r.doc_id)
    assert {r.doc_id for r in one.collect()} == set(first.values())
    near = corpus_pipeline.drop_near_copies(spark, one, SF)
    want, _ = brute_components({r.doc_id: r.text for r in one.collect()})
    assert {r.doc_id for r in near.collect()} == {i for i, k in want.items() if i == k}
    assert corpus_pipeline.mix_sources(spark, one, SF).columns == docs.columns


def test_pipeline_runs(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "mix_sources", "sentencepiece"]
    got = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert got.count() > 0 and got.where("not round_trip").count() == 0


def test_random_draws_depend_on_nothing_else():
    random.seed(1)
    from terrasift.llm import mixing

    assert mixing.draw(1, 2, 3) == mixing.draw(1, 2, 3) != mixing.draw(2, 2, 3)


def test_stages_of_odd_rows(spark, tmp_path):
    """Nulls in any column, empty and repeated rows, clashing names, and no rows at all."""
    data = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, "a b c", "en", "a", 5), (3, "a b c", "en", "a", 5), (4, "x " * 20_000, None, "b", 1), (None, "q r", "de", None, 2)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, size string, kept int, row int, block long, score double"
    docs = spark.createDataFrame([(*r, "s", 1, 2, 3, 0.5) for r in data], schema)
    spark.createDataFrame([(3, 1, 0), (4, 0, None), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for table in (docs, docs.limit(0)):
        now = table
        for name, stage in corpus_pipeline.STAGES[:-1]:
            now = stage(spark, now, f"file://{tmp_path}")
            assert now.columns == docs.columns, name
            now = now.checkpoint() if spark.sparkContext.getCheckpointDir() else now.cache()
        last = corpus_pipeline.encode_pieces(spark, now, f"file://{tmp_path}").collect()
        assert {r.doc_id for r in last} <= {1, 2, 3, 4, None} and all(r.round_trip for r in last)
        if table is docs:
            assert sum(r.doc_id == 3 for r in last) <= 2 and any(r.doc_id == 4 for r in last)
        else:
            assert not last


def test_texts_are_cut_in_slices_and_batches(model, monkeypatch):
    """The parts of a text don't depend on how many bytes are cut at a time, or on the texts beside it."""
    own = model[0]
    texts = [*ODD_TEXTS, None, "", " a  b", "end ", " start", "é" * 30 + "日本 \n x"]
    want = [[p for unit in own.units(t or "") for p in own.parts(unit)] for t in texts]
    for size in (1, 7, 4 << 20):
        monkeypatch.setattr(pieces, "CUT_BYTES", size)
        parts, first = own.cut(pa.array(texts, pa.string()).slice(1))
        assert [parts.to_pylist()[a:b] for a, b in zip(first, first[1:])] == want[1:]


def test_merges_after_late_pieces(spark):
    """Half of a late piece may be merged after it: then the piece's turn comes again, as with a priority queue."""
    rows = [("ab", 10, -5.0), ("bc", 11, -1.0), ("cd", 12, -2.0), ("abc", 13, -6.0), ("abcd", 14, -3.0), ("de", 15, 0.0), ("bcd", 16, -4.0)]
    rows += [(c, k, -90.0) for k, c in enumerate("abcde")]
    own = object.__new__(pieces.Pieces)
    own.rows, own.byte_base, own.longest, own.least = rows, 100, 4, -90.0
    assert {r.piece for r in own.table(spark).where("late").collect()} == {"abcd"}
    rank = {p: (i, v) for p, i, v in rows}
    texts = ["".join(t) for n in range(1, 6) for t in itertools.product("abcde", repeat=n)]
    got = pieces.lattice(spark.createDataFrame([(t,) for t in texts], "text string").repartition(8, "text"), own).collect()
    assert len(got) == len(texts) and all(list(r.ids) == pieces.merge_text(r.text, rank, 100) for r in got)
    assert all((r.v_score, r.v_pieces) == brute_path(own, r.text) for r in got)
