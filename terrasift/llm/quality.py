"""Document quality by attention-based multiple-instance learning.

A text is a bag of passages of ``PASSAGE`` bytes, the last one shorter; every byte of the whole text is in one. A passage
is described by the shares of its byte classes, by how often bytes repeat at each short distance (repeated words), and
by the lengths of its words and lines. An encoder maps each description to a state; gated attention gives every passage
a weight; the weighted sum of the states gives the score. Only documents have labels: the attention is learned from them
through the score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrasift.llm import learning
from terrasift.llm.scratch import prepare

PASSAGE = 256
LAGS = tuple(range(2, 33))
PER_CLASS = 3000
STATE, GATE = 24, 12
EPOCHS = 40
#: Byte classes: each string's characters are one class; then digits, upper case, lower case, and bytes beyond ASCII.
MARKS = (" ", "\n", ".", ",", "!", "?", "|", "*", "%", "$", "&", "#", "@", "-", "_", "/", ":;", "'\"", "()[]{}", "<>", "=+~^`\\", "\t\r\x0b\x0c")
CLASSES = len(MARKS) + 5
_CLASS = np.full(256, CLASSES - 1, np.uint8)
for _k, _m in enumerate(MARKS):
    _CLASS[[ord(c) for c in _m]] = _k
_CLASS[ord("0") : ord("9") + 1] = len(MARKS)
_CLASS[ord("A") : ord("Z") + 1] = len(MARKS) + 1
_CLASS[ord("a") : ord("z") + 1] = len(MARKS) + 2
_CLASS[128:] = len(MARKS) + 3
FEATURES = CLASSES + 5


def describe(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The features of all passages, and the first passage of each text. An empty text has one empty passage."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    counts = np.maximum(1, [-(-len(r) // PASSAGE) for r in raw])
    flat = np.frombuffer(b"".join(r.ljust(n * PASSAGE, b"\0") for r, n in zip(raw, counts)), np.uint8).reshape(-1, PASSAGE)
    first = np.cumsum(counts) - counts
    sizes = np.full(len(flat), PASSAGE, float)
    sizes[first + counts - 1] = [len(r) - (n - 1) * PASSAGE for r, n in zip(raw, counts)]
    out = np.empty((len(flat), FEATURES))
    for i in range(0, len(flat), 4096):
        out[i : i + 4096] = _features(flat[i : i + 4096], sizes[i : i + 4096])
    return out, first


def _features(flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    n, real = len(flat), np.arange(PASSAGE)[None, :] < sizes[:, None]
    kind = np.where(real, _CLASS[flat], CLASSES).astype(np.int64)
    counts = np.bincount((kind + np.arange(n)[:, None] * (CLASSES + 1)).ravel(), minlength=n * (CLASSES + 1)).reshape(n, CLASSES + 1)[:, :CLASSES]
    per = np.maximum(sizes, 1)
    same = np.stack([((flat[:, lag:] == flat[:, :-lag]) & real[:, lag:]).sum(axis=1) / np.maximum(sizes - lag, 16) for lag in LAGS], axis=1)
    words = counts[:, 0] + counts[:, 1] + 1
    letters = counts[:, -2] + counts[:, -3] + counts[:, -4]
    return np.concatenate(
        [
            np.sqrt(counts / per[:, None]),
            np.sort(same, axis=1)[:, [-1, -2]],
            (same.mean(axis=1))[:, None],
            (letters / words / 10)[:, None],
            np.log1p(sizes)[:, None] / 6,
        ],
        axis=1,
    )


@dataclass
class Model:
    """h = tanh(x W + b); attention = softmax over a text of w . (tanh(h V) * sigmoid(h U)); score = sigmoid(z . c + d)."""

    mean: np.ndarray
    scale: np.ndarray
    w: list[np.ndarray]

    @classmethod
    def fresh(cls, features: np.ndarray, seed: int = 5) -> Model:
        rng = np.random.default_rng(seed)
        shapes = ((FEATURES, STATE), (STATE,), (STATE, GATE), (STATE, GATE), (GATE,), (STATE,), (1,))
        w = [rng.normal(size=s) / np.sqrt(s[0]) if len(s) > 1 else np.zeros(s) for s in shapes]
        w[4], w[5] = rng.normal(size=GATE) * 0.1, rng.normal(size=STATE) * 0.1
        return cls(features.mean(axis=0), features.std(axis=0) + 1e-3, w)

    def forward(self, features: np.ndarray, first: np.ndarray):
        big_w, b, v, u, gate, c, d = self.w
        x = (features - self.mean) / self.scale
        h = np.tanh(x @ big_w + b)
        left, right = np.tanh(h @ v), 1 / (1 + np.exp(-(h @ u)))
        e = (left * right) @ gate
        counts = np.diff([*first, len(x)])
        a = np.exp(e - np.repeat(np.maximum.reduceat(e, first), counts))
        a /= np.repeat(np.add.reduceat(a, first), counts)
        z = np.add.reduceat(a[:, None] * h, first, axis=0)
        p = 1 / (1 + np.exp(-np.clip(z @ c + d[0], -30, 30)))
        return x, h, left, right, a, z, p, counts

    def gradients(self, features: np.ndarray, first: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """The weighted mean log loss over the texts, and its gradients."""
        big_w, b, v, u, gate, c, d = self.w
        x, h, left, right, a, z, p, counts = self.forward(features, first)
        share = weight / weight.sum()
        loss = -(share * (y * np.log(p + 1e-9) + (1 - y) * np.log(1 - p + 1e-9))).sum()
        g = share * (p - y)
        g_z = np.repeat(g[:, None] * c[None, :], counts, axis=0)
        g_a = (g_z * h).sum(axis=1)
        g_e = a * (g_a - np.repeat(np.add.reduceat(a * g_a, first), counts))
        g_gate = g_e[:, None] * gate[None, :]
        g_left, g_right = g_gate * right * (1 - left**2), g_gate * left * right * (1 - right)
        g_h = (a[:, None] * g_z + g_left @ v.T + g_right @ u.T) * (1 - h**2)
        return loss, [x.T @ g_h, g_h.sum(axis=0), h.T @ g_left, h.T @ g_right, (left * right).T @ g_e, z.T @ g, np.array([g.sum()])]


def fit(features: np.ndarray, first: np.ndarray, y: np.ndarray, weight: np.ndarray, epochs: int = EPOCHS, rate: float = 0.01, batch: int = 64, decay: float = 1e-4) -> Model:
    model, rng, step = Model.fresh(features), np.random.default_rng(5), 0
    ends = np.array([*first[1:], len(features)])
    m, v = [np.zeros_like(w) for w in model.w], [np.zeros_like(w) for w in model.w]
    total = epochs * -(-len(y) // batch)
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for i in range(0, len(order), batch):
            at, step = order[i : i + batch], step + 1
            sizes = ends[at] - first[at]
            rows = np.concatenate([np.arange(a, b) for a, b in zip(first[at], ends[at])])
            _, grads = model.gradients(features[rows], np.cumsum(sizes) - sizes, y[at], weight[at])
            for k, g in enumerate(grads):
                g = g + decay * model.w[k]
                m[k] += 0.1 * (g - m[k])
                v[k] += 0.01 * (g * g - v[k])
                model.w[k] -= rate * (1 - 0.95 * step / total) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
    return model


def train(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", per_class: int = PER_CLASS) -> Model | float:
    """A model learned from at most ``per_class`` texts of each class among the rows where ``learn`` holds.

    Every passage of such a text is in its bag, as in scoring. Ids may be of any type that both tables have in common; an
    id with several labels takes the greatest, and each of its texts is learned from. Null texts count as empty. With one
    class only, or no label at all, that class (or 0.5) is every text's score.
    """
    prepare(docs.sparkSession)
    labelled = labels.where(learn).select(F.col(id_col).alias("id"), (F.col(label_col) > 0).cast("int").alias("label"))
    ids = learning.sample_ids(labelled, per_class)
    ids = docs.sparkSession.createDataFrame(ids.toPandas(), ids.schema)  # bounded by per_class

    def bags(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            if not len(rows):
                continue
            features, first = describe(rows["text"].tolist())
            packed = [x.astype("<f4").tobytes() for x in np.split(features, first[1:])]
            yield pd.DataFrame({"id": rows["id"], "label": rows["label"], "weight": rows["weight"], "bag": packed})

    sample = learning.with_texts(ids, docs, id_col, text_col)
    found = sample.mapInPandas(bags, "id string, label int, weight double, bag binary").toPandas().sort_values(["id", "bag"])
    if found["label"].nunique() < 2:
        return float(found["label"].iloc[0]) if len(found) else 0.5
    bags_ = [np.frombuffer(x, "<f4").reshape(-1, FEATURES) for x in found["bag"]]
    sizes = np.array([len(x) for x in bags_])
    # half way between the classes' true shares and equal ones
    return fit(np.concatenate(bags_).astype(float), np.cumsum(sizes) - sizes, found["label"].to_numpy(float), np.sqrt(found["weight"].to_numpy(float)))


def score_quality(docs: DataFrame, model: Model | float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, score, predicted. Null texts count as empty, and an empty text is scored too.

    Repeated rows get equal scores, whatever their ids; other columns are not read; an empty table gives no rows.
    """

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            out = np.full(len(texts), model if isinstance(model, float) else 0.0)
            part, size = [], 0
            for i, t in [] if isinstance(model, float) else [*enumerate(texts), (-1, None)]:
                if part and (i < 0 or size > 2_000_000):  # some MB of text at a time
                    features, first = describe([texts.iloc[k] or "" for k in part])
                    out[part] = model.forward(features, first)[6]
                    part, size = [], 0
                if i >= 0:
                    part.append(i)
                    size += len(t or "")
            yield pd.Series(out)

    out = docs.select(F.col(id_col), score(F.col(text_col)).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
