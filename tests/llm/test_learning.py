"""Classifiers: gradients, held-out accuracy, the counterfactual penalty, and odd tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrasift.llm import language, learning, quality, toxicity

SF = "/root/testdata/sf0.1"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [(1, None, "en", "s", 0), (2, "", None, "s", 0), (None, "the and of", "en", None, 0), (3, "1 2 3 !!!", "en", "s", 0), (4, "w" * 100_000, "fr", "s", 0), (4, "the the", "en", "s", 0)]


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


def accuracy(scored, labels, label, held):
    rows = scored.join(labels, "doc_id").where(held).select("predicted", label).collect()
    return np.mean([r.predicted == r[label] for r in rows]), rows


def test_toxicity_on_held_out_texts(tables):
    docs, labels = tables
    rest = learning.remainder("doc_id", 5)
    model = toxicity.train(docs, labels, rest != 0)
    right, rows = accuracy(toxicity.score_toxicity(docs, model), labels, "toxic", rest == 0)
    caught = [r.predicted for r in rows if r.toxic]
    assert right > 0.97 and np.mean(caught) > 0.85 and not any(r.predicted for r in rows if not r.toxic)


def test_swapping_identity_terms_moves_no_score():
    """Toxic texts name one group more often; with the penalty the group's name says nothing."""
    names = ["idiot", "women", "men", "word"]
    index = {f"={n}": i for i, n in enumerate(names)}
    blank = toxicity.Model(index, np.zeros(4), 0.0)

    def row(label, *words):
        return (1.0, label, sorted(blank.active(set(words))), [sorted(blank.active(t)) for t in toxicity.counterfactuals(set(words))])

    rows = [row(1, "idiot", "women")] * 30 + [row(1, "women")] * 10 + [row(0, "men", "word")] * 30 + [row(0, "word")] * 30 + [row(0, "women", "word")] * 3
    free, _ = toxicity.fit(rows, 4, pairing=0.0)
    held, _ = toxicity.fit(rows, 4, pairing=20.0)
    assert abs(free[1] - free[2]) > 0.5 and abs(held[1] - held[2]) < 0.1 * abs(free[1] - free[2]) and held[0] > 0.3
    assert toxicity.counterfactuals({"the", "women."}) == [{"the", "men."}, {"the", "_."}] and toxicity.counterfactuals({"the"}) == []
    assert toxicity.features_of("_.") == []


def test_identity_terms_have_one_kind_and_all_partners():
    terms = [t for kind in toxicity.IDENTITY for t in kind]
    assert len(terms) == len(set(terms))
    for kind in toxicity.IDENTITY:
        for t in kind:
            assert {next(iter(toxicity.counterfactuals({t}, turn)[0])) for turn in range(20)} == set(kind) - {t}


def group_texts(seed, toxic_names, clean_names, n=400):
    """Texts of common words; half of the toxic ones hold an insult, and many name a group that clean ones seldom name."""
    rng = np.random.default_rng(seed)
    common, insults = [f"word{i}" for i in range(60)], [f"insult{i}" for i in range(25)]
    for k in range(n):
        words = [*rng.choice(common, 12)]
        if k % 4 == 0:
            words += [*rng.choice(insults, 1)]
        if rng.random() < (toxic_names if k % 2 == 0 else clean_names):
            words += [str(rng.choice(["muslims", "refugees"]))]
        yield " ".join(map(str, words)), int(k % 2 == 0)


def test_pairing_lowers_scores_of_neutral_mentions(spark, monkeypatch):
    """With the pairing that the query uses, naming a group raises a clean text's score less than without it."""
    rows = [(k, t, y) for k, (t, y) in enumerate(group_texts(1, 0.8, 0.04))]
    docs = spark.createDataFrame([(k, t) for k, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(k, y) for k, _, y in rows], "doc_id long, toxic int")
    neutral = [f"word{i} word{i + 1} the {g} of word{i + 2}" for i in range(50) for g in ("muslims", "refugees")]
    insulting = [f"word{i} insult{i % 25} word{i + 2}" for i in range(50)]
    plain, found = toxicity.fit, {}
    for pairing in (0.0, 1.0):
        monkeypatch.setattr(toxicity, "fit", lambda r, n, pairing=pairing: plain(r, n, pairing=pairing))
        model = toxicity.train(docs, labels, F.lit(True))
        z = lambda texts: np.array([model.logit(t) for t in texts])
        found[pairing] = (z(neutral), (z(neutral) > 0).mean(), (z(insulting) > 0).mean())
    assert found[1.0][0].mean() < found[0.0][0].mean() - 0.5
    assert found[1.0][1] < 0.5 * found[0.0][1] and found[1.0][2] > 0.9


def test_fit_is_where_no_step_helps():
    """At the least loss, the gradient is that of the lasso where a weight is set, and within it where none is."""
    rng = np.random.default_rng(3)
    rows = []
    for _ in range(120):
        own = sorted({int(x) for x in rng.integers(0, 12, 4)})
        twin = [sorted({(i + 1) % 12 if i > 8 else i for i in own}), [i for i in own if i < 9]] if rng.random() < 0.4 else []
        rows.append((float(rng.uniform(0.5, 2)), int(rng.random() < (0.8 if 3 in own else 0.3)), own, twin))
    lasso, ridge, pairing = 2e-2, 1e-3, 0.7
    w, b = toxicity.fit(rows, 12, pairing=pairing, lasso=lasso, ridge=ridge, rounds=6000)
    share = np.array([r[0] for r in rows]) / sum(r[0] for r in rows)

    def smooth(w, b):
        total = 0.5 * ridge * (w**2).sum()
        for s, (_, y, own, twin) in zip(share, rows):
            z = b + w[own].sum()
            total += s * (np.logaddexp(0, z) - y * z)
            total += sum(pairing * s * (w[own].sum() - w[t].sum()) ** 2 for t in twin)
        return total

    slope = lambda k: (smooth(w + 1e-5 * np.eye(12)[k], b) - smooth(w - 1e-5 * np.eye(12)[k], b)) / 2e-5
    assert abs(smooth(w, b + 1e-5) - smooth(w, b - 1e-5)) / 2e-5 < 1e-6
    for k in range(12):
        assert abs(slope(k) + lasso * np.sign(w[k])) < 1e-6 if w[k] else abs(slope(k)) <= lasso + 1e-6
    assert (w == 0).any() and (w != 0).any()


def test_toxicity_of_odd_rows(spark, odd):
    labels = spark.createDataFrame([(1, 1, 0), (4, 0, 1), (4, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.train(odd, labels, F.lit(True))
    got = toxicity.score_toxicity(odd.withColumn("score", F.lit("clash")), model).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    nothing = toxicity.train(odd, labels.limit(0), F.lit(True))
    assert {r.predicted for r in toxicity.score_toxicity(odd, nothing).collect()} == {0}
    assert toxicity.score_toxicity(odd.limit(0), model).count() == 0


def test_quality_on_held_out_texts(tables):
    docs, labels = tables
    rest = learning.remainder("doc_id", 3)
    model = quality.train(docs, labels, rest != 1)
    right, _ = accuracy(quality.score_quality(docs, model), labels, "quality", rest == 1)
    assert right > 0.97


def test_quality_gradients():
    rng = np.random.default_rng(0)
    features, first = quality.describe(["abc " * 300, "", "XX!! " * 100, "a" * 256])
    features = features + rng.normal(size=features.shape)
    net, y, weight = quality.Model.fresh(features), np.array([1.0, 0, 1, 0]), np.array([1.0, 2, 1, 1])
    _, grads = net.gradients(features, first, y, weight)
    for w, g in zip(net.w, grads):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        old, step = w[at], 1e-5
        w[at] = old + step
        up = net.gradients(features, first, y, weight)[0]
        w[at] = old - step
        down = net.gradients(features, first, y, weight)[0]
        w[at] = old
        assert abs((up - down) / (2 * step) - g[at]) < 1e-5


def test_quality_of_odd_rows(spark, odd):
    labels = spark.createDataFrame([(3, 0, 0), (4, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.train(odd, labels, F.lit(True))
    got = quality.score_quality(odd, model).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    assert {r.score for r in quality.score_quality(odd, quality.train(odd, labels.limit(0), F.lit(True))).collect()} == {0.5}
    assert quality.score_quality(odd.limit(0), model).count() == 0


def test_quality_scores_are_those_of_a_loop(spark):
    """One text at a time, one passage after another, with plain loops."""
    texts = ["abc def. " * 90, "", "XX!! 12 " * 200, "a", "é" * 300]
    features, first = quality.describe(texts)
    rng = np.random.default_rng(0)
    model = quality.Model.fresh(features)
    model.w = [w + rng.normal(size=w.shape) * 0.3 for w in model.w]
    big_w, b, v, u, gate, c, d = model.w
    want = []
    for own in np.split(features, first[1:]):
        states, weights = [], []
        for x in own:
            h = np.tanh((x - model.mean) / model.scale @ big_w + b)
            states.append(h)
            weights.append(np.exp((np.tanh(h @ v) / (1 + np.exp(-(h @ u)))) @ gate))
        z = sum(a * h for a, h in zip(weights, states)) / sum(weights)
        want.append(1 / (1 + np.exp(-(z @ c + d[0]))))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    got = {r.doc_id: r.score for r in quality.score_quality(docs, model).collect()}
    assert np.allclose([got[i] for i in range(len(texts))], want, atol=1e-12)


def test_quality_learns_from_whole_texts(spark, monkeypatch):
    """What tells two classes apart may come late in a text."""
    seen = {}
    monkeypatch.setattr(quality, "fit", lambda features, first, y, weight: seen.update(n=len(features)) or 0.5)
    docs = spark.createDataFrame([(1, "a" * 100_000), (2, "b" * 300)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    quality.train(docs, labels, F.lit(True))
    assert seen["n"] == -(-100_000 // quality.PASSAGE) + 2


def test_every_byte_is_in_one_passage():
    features, first = quality.describe(["x" * 1000, "", "y"])
    assert first.tolist() == [0, 4, 5] and len(features) == 6


def test_language_gradients():
    rng, net = np.random.default_rng(0), language.Network.fresh(["a", "b", "c"], hidden=4)
    for k in ("inputs", "states", "out", "bias"):
        setattr(net, k, getattr(net, k).astype(np.float64))
    flat, mask, labels = rng.integers(0, 256, (5, 7)).astype(np.uint8), np.ones((5, 7)), rng.integers(0, 3, 5)
    mask[2, 4:] = 0
    _, grads = net.gradients(flat, mask, labels)
    for w, g in zip(net.weights(), grads):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        old, step = w[at], 1e-5
        w[at] = old + step
        up = net.gradients(flat, mask, labels)[0]
        w[at] = old - step
        down = net.gradients(flat, mask, labels)[0]
        w[at] = old
        assert abs((up - down) / (2 * step) - g[at]) < 1e-6


def test_reading_gives_what_training_sees():
    """Both forms of the forward pass agree, padding included."""
    rng, net = np.random.default_rng(1), language.Network.fresh(["a", "b"])
    flat = rng.integers(0, 256, (4, language.WINDOW)).astype(np.uint8)
    mask = np.ones(flat.shape, np.float32)
    mask[1, 9:] = 0
    fast = net.position_probabilities(flat, mask)
    loss, _ = net.gradients(flat, mask, np.zeros(4, int))
    assert np.allclose(fast.sum(axis=1), mask.sum(axis=1), atol=1e-3) and loss > 0


def test_language_scores_are_those_of_a_loop():
    """One byte at a time, in plain loops over windows, both ways."""
    net = language.Network.fresh(["a", "b", "c"], seed=2)
    texts = ["hello World " * 12, "é", "x" * language.WINDOW, "y" * (language.WINDOW + 1)]
    got = net.document_probabilities(texts)
    size = net.states.shape[1]
    for text, p in zip(texts, got):
        raw, total = text.lower().encode(), np.zeros(3)
        for start in range(0, len(raw), language.WINDOW):
            part, logits = raw[start : start + language.WINDOW], None
            sums = [net.bias.astype(float).copy() for _ in part]
            for way in (0, 1):
                h = np.zeros(size)
                for t in range(len(part)) if way == 0 else range(len(part) - 1, -1, -1):
                    x, a = net.inputs[way][part[t]], h @ net.states[way]
                    g = 1 / (1 + np.exp(-(x[: 2 * size] + a[: 2 * size])))
                    new = np.tanh(x[2 * size :] + g[size:] * a[2 * size :])
                    h = (1 - g[:size]) * new + g[:size] * h
                    sums[t] += h @ net.out[way]
            for logits in sums:
                e = np.exp(logits - logits.max())
                total += e / e.sum()
        assert np.allclose(p, total / len(raw), atol=1e-4)


def test_letters():
    assert not any(map(language.has_letter, [None, "", "12", "½²①", "\n !?", "٣", "_"]))
    assert all(map(language.has_letter, ["a", "½ é", "日", "ª", "1x"]))


def test_language_learns_from_whole_texts(spark, monkeypatch):
    seen = {}
    monkeypatch.setattr(language, "fit", lambda flat, mask, labels, languages: seen.update(mask=mask.sum(), n=len(flat), languages=languages))
    docs = spark.createDataFrame([("x", "a" * 10_000, "en"), ("y", "b" * 10_000, "fr"), ("z", "1 2", "de")], "doc_id string, text string, lang string")
    language.train(docs, F.lit(True))
    assert seen == {"mask": 20_000, "n": 2 * -(-10_000 // language.WINDOW), "languages": ["en", "fr"]}


def test_language_on_held_out_texts_and_odd_rows(spark, odd):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rest = learning.remainder("doc_id", 5)
    net = language.train(docs, rest != 0, per_language=80)
    got = language.predict_language(docs, net).join(docs.select("doc_id", "lang"), "doc_id").where(rest == 0).collect()
    known = [r for r in got if r.lang is not None and r.lang_pred != "und"]
    assert np.mean([r.lang == r.lang_pred for r in known]) > 0.95
    found = language.predict_language(odd, net).collect()
    assert sorted(r.lang_pred for r in found).count("und") == 3 and all(0 <= r.score <= 1 for r in found)
    assert {r.lang_pred for r in language.predict_language(odd, language.train(odd.limit(0), F.lit(True))).collect()} == {"und"}
    assert language.predict_language(odd.limit(0), net).count() == 0


def test_samples_are_bounded_and_weighted(spark):
    rows = spark.range(5000).select("id", F.when(F.col("id") % 10 == 0, 1).otherwise(0).alias("label"))
    got = learning.sample_ids(rows.union(spark.createDataFrame([(None, 1), (7, None)], "id long, label int")), 200).collect()
    sizes = {k: [r.weight for r in got if r.label == k] for k in (0, 1)}
    assert all(150 <= len(v) <= 200 for v in sizes.values())
    assert sizes[0][0] == 4500 / 200 and sizes[1][0] == 500 / 200
