"""Deduplication, components and mixing against brute force, and on odd tables."""

import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from terrasift.llm import components, exact_dedup, minhash, mixing
from terrasift.llm.scratch import Scratch
from tests.oracle import connect, rows

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, pairs):
    return spark.createDataFrame([(i, t, "en", "s", 0) for i, t in pairs], DOCS)


def brute_components(texts, percent=85):
    """Components by comparing every two texts that share a shingle."""
    sets = {i: minhash.shingle_set(t) for i, t in texts.items()}
    by = {}
    for i, s in sets.items():
        for x in s:
            by.setdefault(x, []).append(i)
    up = {i: i for i in sets}

    def root(a):
        while up[a] != a:
            a = up[a]
        return a

    for i, s in sets.items():
        for j, n in Counter(j for x in s for j in by[x] if j > i).items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                a, b = sorted((root(i), root(j)))
                up[b] = a
    return {i: root(i) for i in sets}, {i: len(s) for i, s in sets.items()}


def test_exact_dedup_is_what_sql_says(spark):
    got = exact_dedup.exact_dedup(spark.read.parquet(f"{SF}/documents.parquet")).toPandas()
    assert rows(got) == rows(connect(SF).execute(exact_dedup.ORACLE_SQL).df())


def test_exact_dedup_of_odd_rows(spark):
    table = docs(spark, [(5, None), (4, ""), (3, " a\n b"), (2, "\ta b"), (2, " a b"), (None, " a b"), (9, "é" * 50_000), (8, "x ")])
    got = [r.asDict() for r in exact_dedup.exact_dedup(table.withColumn("id", F.lit(1)).withColumn("run", F.lit(1))).collect()]
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"]) for r in got) == Counter(
        [(5, 4, 2), (4, 4, 2), (3, 2, 4), (2, 2, 4), (2, 2, 4), (None, 2, 4), (9, 9, 1), (8, 8, 1)]
    )
    assert sum(r["kept"] for r in got) == 4
    assert {r["text_sha256"] for r in got if r["doc_id"] == 4} == {hashlib.sha256(b"").hexdigest()}
    assert sorted(r.doc_id for r in exact_dedup.keep_first(table).collect()) == [2, 4, 8, 9]
    assert exact_dedup.exact_dedup(table.limit(0)).count() == 0


def test_near_duplicates_are_those_of_brute_force(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: r for r in minhash.near_duplicates(table).collect()}
    want, sizes = brute_components({r.doc_id: r.text for r in table.select("doc_id", "text").collect()})
    assert {i: r.component_id for i, r in got.items()} == want
    assert {i: r.n_shingles for i, r in got.items()} == sizes
    assert all(r.kept == (r.component_id == i) for i, r in got.items())


@pytest.fixture(scope="module")
def crowd():
    """Copies of one text with a few changed words each: many are near each other, many only nearly so."""
    rnd, base, out = random.Random(4), [f"w{i}" for i in range(120)], {}
    for i in range(160):
        words = list(base)
        for _ in range(rnd.randrange(0, 6)):
            words[rnd.randrange(len(words))] = f"x{rnd.randrange(9999)}"
        out[i * 7 + 3] = " ".join(words)
    return out


@pytest.mark.parametrize("rows_,size", [(16, 1 << 24), (2048, 5000)])
def test_a_crowded_bucket_loses_no_link(spark, crowd, monkeypatch, rows_, size):
    monkeypatch.setattr(minhash, "BLOCK", rows_)  # so that buckets are cut into blocks, by rows or by bytes
    monkeypatch.setattr(minhash, "BLOCK_BYTES", size)
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs(spark, crowd.items())).collect()}
    assert got == brute_components(crowd)[0]


def test_near_duplicates_of_odd_rows(spark):
    long_ = " ".join(f"t{i}" for i in range(30_000))
    table = docs(spark, [(1, None), (2, " \n"), (7, "a b"), (3, "A  b"), (None, "a b"), (5, long_), (4, long_ + " end"), (6, "a b c"), (6, "a b c")])
    got = minhash.near_duplicates(table.withColumn("key", F.lit(0)).withColumn("label", F.lit(0))).collect()
    assert Counter((r.doc_id, r.component_id, r.kept) for r in got) == Counter(
        [(1, 1, True), (2, 2, True), (7, 3, False), (3, 3, True), (None, None, True), (5, 4, False), (4, 4, True), (6, 6, True), (6, 6, True)]
    )
    assert {r.doc_id: r.n_shingles for r in got}[5] == 29_996
    assert minhash.near_duplicates(table.limit(0)).count() == 0
    with pytest.raises(ValueError):
        minhash.near_duplicates(table, percent=50)


def test_pruning_keeps_similar_pairs():
    least = minhash.reach(0.85, 1e-6)
    assert least == sorted(least) and least[-1] < 0.85 * minhash.HASHES
    tokens = [b"%d" % i for i in range(400)]
    of = minhash.WordHashes()
    a = minhash.signature(minhash.shingle_hashes(tokens, of)[0]).astype("u1")
    b = minhash.signature(minhash.shingle_hashes(tokens[:396], of)[0]).astype("u1")
    c = minhash.signature(minhash.shingle_hashes([b"z" + t for t in tokens], of)[0]).astype("u1")
    import numpy as np

    assert minhash.survivors(a, np.stack([b, c]), least).tolist() == [0]


def test_components_of_paths_and_stars(spark):
    path = [(i, i + 1) for i in range(0, 40)]
    star = [(100, 100 + i) for i in range(1, 30)]
    rnd = random.Random(1)
    edges = path + star + [(7, 7)]
    rnd.shuffle(edges)
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark)).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}}


def brute_targets(sizes):
    """Shares by weight with the excess shared again, as the contract words it."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    left, target = 1.5 * sum(sizes.values()), {}
    while True:
        open_ = [s for s in order if s not in target]
        unit = left / sum(weight[s] for s in open_) if open_ else 0
        over = [s for s in open_ if weight[s] * unit > 2 * sizes[s]]
        if not over:
            return target | {s: weight[s] * unit for s in open_}
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]


def test_mix_meets_its_targets(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    got = mixing.mix(table).join(table.select("doc_id", "source", "text"), "doc_id").collect()
    size = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in got}
    assert all(r.size == size[r.doc_id] and r.taken == r.copies * r.size and r.copies in (0, 1, 2) for r in got)
    sums = Counter()
    for r in got:
        sums[r.source] += r.size
    want = brute_targets(sums)
    for s in sums:
        own = [r for r in got if r.source == s]
        assert all(abs(r.target - want[s]) < 1e-6 * want[s] and r.source_size == sums[s] for r in own)
        assert abs(sum(r.taken for r in own) - want[s]) <= max(r.size for r in own) / 2 + 1
    again = {r.doc_id: r.copies for r in mixing.mix(table.repartition(5)).collect()}
    assert again == {r.doc_id: r.copies for r in got}
    assert mixing.apply_mix(table).count() == sum(r.copies for r in got)


def test_mix_of_odd_rows(spark):
    data = [(1, None, "a"), (2, "", "a"), (3, "x " * 100, "b"), (4, "y z", None), (4, "y z", None), (None, "q", "c")]
    table = spark.createDataFrame(data, "doc_id long, text string, source string").withColumn("size", F.lit("clash")).withColumn("p", F.lit(0))
    got = mixing.mix(table).collect()
    assert len(got) == 6 and all(r.taken <= 2 * r.size for r in got)
    assert {r.doc_id: r.taken for r in got}[1] == 0
    assert mixing.mix(table.limit(0)).count() == 0
    assert set(mixing.apply_mix(table).columns) == set(table.columns)


def test_mix_of_any_ids(spark):
    """Ids that a double can't hold stay apart beside a null one, and ids may be strings."""
    data = [(None if i % 9 == 0 else 2**60 + i, "w " * (1 + i % 13), f"s{i % 2}") for i in range(200)]
    table = spark.createDataFrame(data, "doc_id long, text string, source string").coalesce(1)
    one = mixing.mix(table).collect()
    assert Counter(r.doc_id for r in one) == Counter(i for i, _, _ in data)
    again = mixing.mix(table.repartition(7)).collect()
    key = lambda r: (str(r.doc_id), r.size, r.copies)
    assert sorted(map(key, one)) == sorted(map(key, again))
    named = mixing.mix(table.withColumn("doc_id", F.concat(F.lit("id-"), F.col("doc_id").cast("string")))).collect()
    assert Counter(r.doc_id for r in named if r.doc_id)["id-1152921504606846977"] == 1 and len(named) == 200
    for s, target in {(f"s{i}", r.target) for i in (0, 1) for r in one if r.source_size}:
        assert target > 0


def test_every_copy_of_the_mix_is_applied(spark):
    """Rows of one id, some of them alike in every column, are copied exactly as often as the mix says."""
    rnd = random.Random(8)
    data = [(i, "w " * rnd.randrange(1, 30), "ab"[i % 2], i) for i in range(60)]
    data += [(7, "w " * n, "a", n) for n in range(1, 8)] + [(8, "same words", "b", 0)] * 9 + [(None, "x y", "b", 1), (None, "x y", "b", 2), (None, "", None, 3)]
    table = spark.createDataFrame(data, "doc_id long, text string, source string, n_chars long")
    words_of = lambda rows_: Counter((r.doc_id, len(r.text.split())) for r in rows_)
    want = Counter()
    for r in mixing.mix(table).collect():
        want[(r.doc_id, r.size)] += r.copies
    got = words_of(mixing.apply_mix(table).collect())
    assert got.total() == want.total()
    assert {k: n for k, n in got.items() if k[0] not in (7, None)} == {k: n for k, n in want.items() if n and k[0] not in (7, None)}
    assert {i: sum(n for (j, _), n in got.items() if i == j) for i in (7, 8)} == {i: sum(n for (j, _), n in want.items() if i == j) for i in (7, 8)}


def test_rounding_keeps_the_expected_words():
    rnd = random.Random(2)
    sizes = [rnd.randrange(1, 900) for _ in range(300)]
    p = [rnd.random() for _ in sizes]
    out = mixing.pivotal(list(range(300)), sizes, p, 1, 0)
    assert sum(0 < x < 1 for x in out) <= 1
    assert abs(sum(s * x for s, x in zip(sizes, out)) - sum(s * x for s, x in zip(sizes, p))) < 1e-6 * sum(sizes)
    mean = [sum(mixing.pivotal(list(range(6)), [5, 4, 3, 2, 2, 1], [0.3, 0.8, 0.5, 0.5, 0.2, 0.7], seed, 0)[k] for seed in range(4000)) / 4000 for k in range(6)]
    assert all(abs(a - b) < 0.03 for a, b in zip(mean, [0.3, 0.8, 0.5, 0.5, 0.2, 0.7]))
