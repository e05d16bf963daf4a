"""Toxicity by a counterfactually regularised classifier.

A logistic regression over which words, and which word beginnings, a text holds. It is trained on labelled texts and on
their counterfactuals, in which identity terms are swapped: once for others of the same kind, once for a term that names
no group. Besides the label loss, the squared change of the score between a text and its counterfactuals is penalised
(logit pairing). The first kind makes groups score alike; but that alone would let all of them score high, so the second
makes naming any group move a score little, however often groups are named in toxic examples.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrasift.llm import learning
from terrasift.llm.scratch import prepare

#: Interchangeable identity terms: the members of a tuple are swapped for each other.
IDENTITY = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("muslim", "jewish", "christian", "hindu", "buddhist", "atheist"),
    ("muslims", "jews", "christians", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "arab", "african", "european"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("immigrants", "refugees", "natives", "citizens", "foreigners"),
    ("disabled", "deaf", "blind", "elderly", "young"),
    ("frauen", "männer", "mädchen", "jungen"),
    ("muslime", "juden", "christen", "buddhisten", "atheisten"),
    ("flüchtlinge", "einwanderer", "ausländer", "bürger"),
    ("femmes", "hommes", "filles", "garçons"),
    ("musulmans", "juifs", "chrétiens", "hindous", "bouddhistes"),
    ("immigrés", "réfugiés", "étrangers", "citoyens"),
    ("mujeres", "hombres", "niñas", "niños"),
    ("musulmanes", "judíos", "cristianos", "hindúes", "budistas"),
    ("inmigrantes", "refugiados", "extranjeros", "ciudadanos"),
)
#: What stands for an identity term where no group is named: no feature is learned of it.
NEUTRAL = "_"
_KIND = {term: kind for kind in IDENTITY for term in kind}
BEGINNINGS = (3, 4, 5, 6)
PER_CLASS = 8000
FEATURES = 4096
LEAST_TEXTS = 3
WORD_CACHE = 150_000
COUNTED = 100_000
_WORD = re.compile(r"[^\W\d_]+")


def tokens(text: str) -> set[str]:
    """The distinct runs of non-space characters, in lower case."""
    return set(text.lower().split())


def features_of(token: str) -> list[str]:
    """What a token tells: each of its words, and the beginnings of that word."""
    out = []
    for word in _WORD.findall(token):
        out.append(f"={word}")
        out += (word[:n] for n in BEGINNINGS if len(word) >= n)
    return out


def counterfactuals(words: set[str], turn: int = 0) -> list[set[str]]:
    """The tokens with every identity term swapped for another of its kind, and for NEUTRAL; none without such a term.

    ``turn`` tells how many terms lie between the two of a kind, so that over many texts all are paired with each other.
    """
    found = {w: _KIND[w] for t in words for w in _WORD.findall(t) if w in _KIND}
    if not found:
        return []
    other = {w: kind[(kind.index(w) + 1 + turn % (len(kind) - 1)) % len(kind)] for w, kind in found.items()}
    return [{_WORD.sub(lambda m: swapped.get(m[0], m[0]), t) for t in words} for swapped in (other, dict.fromkeys(found, NEUTRAL))]


@dataclass
class Model:
    """Weights of features; ``known`` remembers the features of a bounded number of tokens."""

    index: dict[str, int]
    weights: np.ndarray
    bias: float
    known: dict[str, tuple[int, ...]] = field(default_factory=dict)

    def active(self, words: set[str]) -> set[int]:
        """The indices of the features that a text's tokens have."""
        out: set[int] = set()
        for token in words:
            got = self.known.get(token)
            if got is None:
                got = tuple({self.index[f] for f in features_of(token) if f in self.index})
                if len(self.known) < WORD_CACHE:
                    self.known[token] = got
            if got:
                out.update(got)
        return out

    def logit(self, text: str) -> float:
        return self.bias + sum(self.weights[i] for i in self.active(tokens(text)))


def _counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(feature, toxic texts, other texts) of this task's texts, some at a time."""
    both: tuple[Counter, Counter] = (Counter(), Counter())

    def counted() -> Iterator[pd.DataFrame]:
        names = list({*both[0], *both[1]})
        for i in range(0, len(names), 20_000):
            part = names[i : i + 20_000]
            yield pd.DataFrame({"feature": part, "pos": [both[0][x] for x in part], "neg": [both[1][x] for x in part]})
        for c in both:
            c.clear()

    for rows in batches:
        for text, label in zip(rows["text"], rows["label"]):
            both[0 if label else 1].update({f for t in tokens(text) for f in features_of(t)})
            if len(both[0]) + len(both[1]) > COUNTED:
                yield from counted()
    yield from counted()


def fit(
    rows: list[tuple[float, int, list[int], list[list[int]]]], size: int, pairing: float = 1.0, lasso: float = 1e-4, ridge: float = 1e-4, rounds: int = 800
) -> tuple[np.ndarray, float]:
    """Weights and bias by accelerated proximal gradient steps.

    ``rows``: weight, label, active features, and those of each counterfactual. The loss is the weighted mean of the log
    loss, plus ``pairing`` times the weighted mean over all texts of the squared differences of the logits of a text and
    its counterfactuals, plus lasso and ridge terms.
    """
    share = np.array([r[0] for r in rows], float)
    share /= share.sum()
    y = np.array([r[1] for r in rows], float)

    def flat(lists):
        return np.repeat(np.arange(len(lists)), [len(x) for x in lists]), np.fromiter((i for x in lists for i in x), np.int64)

    text, feat = flat([r[2] for r in rows])
    twins = [(k, set(r[2]), set(t)) for k, r in enumerate(rows) for t in r[3]]
    diff = [(n, i, sign) for n, (_, own, twin) in enumerate(twins) for i, sign in [(i, 1.0) for i in own - twin] + [(i, -1.0) for i in twin - own]]
    d_twin, d_feat, d_sign = (np.array([x[k] for x in diff], t) for k, t in ((0, np.int64), (1, np.int64), (2, float)))
    d_share = share[[k for k, _, _ in twins]] if twins else np.zeros(0)
    rate = float(np.clip((share * y).sum(), 1e-4, 1 - 1e-4))
    w, b = np.zeros(size), float(np.log(rate / (1 - rate)))
    # a bound of the curvature: each text's features and the bias, and what its counterfactuals differ in
    most = np.bincount(text, minlength=len(rows)).astype(float)
    apart = np.bincount(d_twin, minlength=len(twins)).astype(float) if len(diff) else np.zeros(len(twins))
    step = 1 / max((0.25 * share * (most + 1)).sum() + 2 * pairing * (d_share * apart).sum() + ridge, 1e-6)
    vw, vb, t = w.copy(), b, 1.0
    for _ in range(rounds):
        z = vb + np.bincount(text, vw[feat], len(rows))
        g = share * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        gw = np.bincount(feat, g[text], size) + ridge * vw
        if len(diff):
            change = 2 * pairing * d_share * np.bincount(d_twin, d_sign * vw[d_feat], len(twins))
            gw += np.bincount(d_feat, d_sign * change[d_twin], size)
        nw = vw - step * gw
        nw = np.sign(nw) * np.maximum(np.abs(nw) - step * lasso, 0)
        nb = vb - step * g.sum()
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        vw, vb = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = nw, nb, nt
    return w, b


def train(
    docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: int = PER_CLASS
) -> Model:
    """A model of ``label_col``, learned from at most ``per_class`` texts of each class among the rows where ``learn`` holds.

    Ids may be of any type that both tables have in common. An id with several labels takes the greatest; each of its
    texts is learned from. Null texts count as empty, and texts of any length are learned from whole. Without a labelled
    text, or with one class only, every text gets the same score.
    """
    prepare(docs.sparkSession)
    labelled = labels.where(learn).select(F.col(id_col).alias("id"), (F.col(label_col) > 0).cast("int").alias("label"))
    # collected: its size is bounded by per_class, and it is used twice
    ids = learning.sample_ids(labelled, per_class)
    spark = docs.sparkSession
    ids = spark.createDataFrame(ids.toPandas(), ids.schema)
    sample = learning.with_texts(ids, docs, id_col, text_col)
    counts = sample.select("text", "label").mapInPandas(_counts, "feature string, pos long, neg long")
    counts = counts.groupBy("feature").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    sizes = {r["label"]: r["n"] for r in ids.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    p, n = max(sizes.get(1, 0), 1), max(sizes.get(0, 0), 1)
    # the signed root of the likelihood gain is what ranks: how surely a feature is commoner in one class
    rate = (F.col("pos") + F.col("neg")) / F.lit(p + n)
    gap = F.abs(F.col("pos") / p - F.col("neg") / n) / F.sqrt(rate * (1 - rate) * F.lit(1 / p + 1 / n) + 1e-12)
    best = counts.where(F.col("pos") + F.col("neg") >= LEAST_TEXTS).orderBy(gap.desc(), "feature").limit(FEATURES)
    names = [r["feature"] for r in best.select("feature").collect()]
    names += sorted({f for kind in IDENTITY for term in kind for f in features_of(term)} - {*names})
    blank = Model({f: i for i, f in enumerate(names)}, np.zeros(len(names)), 0.0)

    def active(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            words = [tokens(t) for t in rows["text"]]
            twins = [counterfactuals(w, zlib.crc32(t.encode("utf-8", "surrogatepass"))) for w, t in zip(words, rows["text"])]
            yield pd.DataFrame(
                {
                    "id": rows["id"],
                    "weight": rows["weight"],
                    "label": rows["label"],
                    "own": [sorted(blank.active(w)) for w in words],
                    "twins": [[sorted(blank.active(w)) for w in ws] for ws in twins],
                }
            )

    found = sample.mapInPandas(active, "id string, weight double, label int, own array<int>, twins array<array<int>>").toPandas()
    found = found.assign(order=found["own"].map(tuple)).sort_values(["id", "order"])
    rows = [(r.weight, r.label, list(r.own), [list(t) for t in r.twins]) for r in found.itertuples()]
    if len({r[1] for r in rows}) < 2:
        return Model({}, np.zeros(0), 4.0 if rows and rows[0][1] else -4.0)
    weights, bias = fit(rows, len(names))
    kept = np.flatnonzero(weights)
    return Model({names[i]: k for k, i in enumerate(kept)}, weights[kept], bias)


def scorer(model: Model):
    """A function of a text column: the probability that the text is toxic. Null texts count as empty."""
    index, weights, bias = model.index, model.weights, model.bias

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = Model(index, weights, bias)
        for texts in batches:
            z = np.array([own.logit(t or "") for t in texts], float)
            yield pd.Series(1 / (1 + np.exp(-z)))

    return score


def score_toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, score, predicted. Empty and null texts get the score of no feature at all.

    Repeated rows get equal scores, whatever their ids; other columns are not read; an empty table gives no rows.
    """
    out = docs.select(F.col(id_col), scorer(model)(F.col(text_col)).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
