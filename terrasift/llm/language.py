"""Language identification by a bidirectional gated recurrent network over bytes.

A text's UTF-8 bytes, in lower case, are cut into windows of ``WINDOW`` positions; every byte of the whole text is in one
window. A forward and a backward GRU read each window, and a softmax over both states labels every position. A
document's probabilities are the means over all its positions. The network is trained in numpy by backpropagation
through time, on windows of a bounded sample of documents for each language.
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

WINDOW = 64
HIDDEN = 8
PER_LANGUAGE = 300
EPOCHS = 5
BATCH = 512
READ = 8192


def has_letter(text: str | None) -> bool:
    """Whether a text holds a letter of any script; digits, fractions, superscripts and circled numbers are none."""
    return bool(text) and any(map(str.isalpha, text))


def windows(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all windows (0 pads a text's last one), the mask of real positions, the first window of each text.

    Every text must hold a byte.
    """
    raw = [t.lower().encode("utf-8", "surrogatepass") for t in texts]
    counts = np.array([-(-len(r) // WINDOW) for r in raw], np.int64)
    flat = np.frombuffer(b"".join(r.ljust(n * WINDOW, b"\0") for r, n in zip(raw, counts)), np.uint8).reshape(-1, WINDOW)
    mask = np.ones(flat.shape, np.float32)
    ends = np.cumsum(counts)
    for r, e, n in zip(raw, ends, counts):
        mask[e - 1, len(r) - (n - 1) * WINDOW :] = 0
    return flat, mask, ends - counts


@dataclass
class Network:
    """Weights. ``inputs`` (2, 256, 3H) are the gates' inputs of a byte, update, reset and candidate, for each direction."""

    languages: list[str]
    inputs: np.ndarray
    states: np.ndarray
    out: np.ndarray
    bias: np.ndarray

    @classmethod
    def fresh(cls, languages: list[str], hidden: int = HIDDEN, seed: int = 7) -> Network:
        rng = np.random.default_rng(seed)
        normal = lambda *s, by=1.0: (rng.normal(size=s) * by).astype(np.float32)
        n = len(languages)
        return cls(
            languages, normal(2, 256, 3 * hidden, by=0.3), normal(2, hidden, 3 * hidden, by=hidden**-0.5), normal(2, hidden, n, by=0.3), np.zeros(n, np.float32)
        )

    def weights(self) -> list[np.ndarray]:
        return [self.inputs, self.states, self.out, self.bias]

    def position_probabilities(self, flat: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """The sum over each window's positions of the probabilities of the languages."""
        n, steps = flat.shape
        h_size, langs = self.states.shape[1], len(self.languages)
        logits = np.empty((steps, n, langs), np.float32)
        columns = np.ascontiguousarray(flat.T)
        scale = np.concatenate([np.full(2 * h_size, 0.5), np.ones(h_size)]).astype(np.float32)
        for way in (0, 1):
            table, u = self.inputs[way] * scale, np.ascontiguousarray(self.states[way] * scale)
            h, x, a = np.zeros((n, h_size), np.float32), np.empty((n, 3 * h_size), np.float32), np.empty((n, 3 * h_size), np.float32)
            for t in range(steps) if way == 0 else range(steps - 1, -1, -1):
                np.take(table, columns[t], axis=0, out=x, mode="clip")
                np.matmul(h, u, out=a)
                gates = a[:, : 2 * h_size]
                gates += x[:, : 2 * h_size]
                gates = np.tanh(gates)  # a sigmoid is half a tangent of half its argument, and a half
                gates += 1
                gates *= 0.5
                new = gates[:, h_size:] * a[:, 2 * h_size :]
                new += x[:, 2 * h_size :]
                np.tanh(new, out=new)
                h -= new
                h *= gates[:, :h_size]
                h += new
                if way == 0:
                    np.matmul(h, self.out[0], out=logits[t])
                else:
                    h *= mask[:, t, None]  # padding is read first from this side
                    logits[t] += h @ self.out[1]
        logits += self.bias
        logits -= logits.max(axis=2, keepdims=True)
        np.exp(logits, out=logits)
        logits *= (mask.T / logits.sum(axis=2))[:, :, None]
        return logits.sum(axis=0)

    def document_probabilities(self, texts: list[str]) -> np.ndarray:
        """The mean over all positions of each text's label probabilities."""
        flat, mask, first = windows(texts)
        sums = np.concatenate([self.position_probabilities(flat[i : i + READ], mask[i : i + READ]) for i in range(0, len(flat), READ)])
        total = np.add.reduceat(sums.astype(float), first, axis=0)
        return total / np.add.reduceat(mask.sum(axis=1, dtype=float), first)[:, None]

    def gradients(self, flat: np.ndarray, mask: np.ndarray, labels: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """The mean log loss over all positions, and its gradients by backpropagation through time."""
        n, steps = flat.shape
        size = self.states.shape[1]
        kept, logits = [], np.zeros((steps, n, len(self.languages)), np.float32) + self.bias
        for way in (0, 1):
            h, trace = np.zeros((n, size), np.float32), {}
            for t in range(steps) if way == 0 else range(steps - 1, -1, -1):
                x, a, m = self.inputs[way][flat[:, t]], h @ self.states[way], mask[:, t, None]
                g = 1 / (1 + np.exp(-(x[:, : 2 * size] + a[:, : 2 * size])))
                z, r, c = g[:, :size], g[:, size:], a[:, 2 * size :]
                new = np.tanh(x[:, 2 * size :] + r * c)
                after = m * ((1 - z) * new + z * h)
                logits[t] += after @ self.out[way]
                trace[t] = (h, z, r, c, new, after)
                h = after
            kept.append(trace)
        logits -= logits.max(axis=2, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(axis=2, keepdims=True)
        places = mask.T
        total = places.sum()
        loss = -(np.log(p[:, np.arange(n), labels] + 1e-9) * places).sum() / total
        p[:, np.arange(n), labels] -= 1
        p *= (places / total)[:, :, None]
        grads = [np.zeros_like(w) for w in self.weights()]
        grads[3] += p.sum(axis=(0, 1))
        for way in (0, 1):
            back = np.zeros((n, size), np.float32)
            rows = []
            for t in range(steps - 1, -1, -1) if way == 0 else range(steps):
                h, z, r, c, new, after = kept[way][t]
                grads[2][way] += after.T @ p[t]
                d = (back + p[t] @ self.out[way].T) * mask[:, t, None]
                d_new = d * (1 - z) * (1 - new**2)
                d_z, d_r, d_c = d * (h - new) * z * (1 - z), d_new * c * r * (1 - r), d_new * r
                d_a = np.concatenate([d_z, d_r, d_c], axis=1)
                grads[1][way] += h.T @ d_a
                back = d * z + d_a @ self.states[way].T
                rows.append((t, np.concatenate([d_z, d_r, d_new], axis=1)))
            order = np.concatenate([flat[:, t] for t, _ in rows])
            values = np.concatenate([v for _, v in rows])
            for k in range(values.shape[1]):
                grads[0][way][:, k] = np.bincount(order, values[:, k], 256)
        return float(loss), grads


def fit(flat: np.ndarray, mask: np.ndarray, labels: np.ndarray, languages: list[str], epochs: int = EPOCHS, rate: float = 0.02, seed: int = 7) -> Network:
    """A network trained with Adam on shuffled batches of windows."""
    net, rng = Network.fresh(languages, seed=seed), np.random.default_rng(seed)
    m = [np.zeros_like(w) for w in net.weights()]
    v = [np.zeros_like(w) for w in net.weights()]
    total, step = epochs * -(-len(flat) // BATCH), 0
    for _ in range(epochs):
        order = rng.permutation(len(flat))
        for i in range(0, len(order), BATCH):
            at, step = order[i : i + BATCH], step + 1
            _, grads = net.gradients(flat[at], mask[at], labels[at])
            norm = np.sqrt(sum(float((g**2).sum()) for g in grads))
            now = rate * (1 - 0.9 * step / total)
            for w, g, a, b in zip(net.weights(), grads, m, v):
                g = g / max(1.0, norm)
                a += 0.1 * (g - a)
                b += 0.01 * (g * g - b)
                w -= now * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-6)
    return net


def train(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> Network | None:
    """A network learned from at most ``per_language`` texts of each language among the rows where ``learn`` holds.

    Every window of such a text is learned from. Ids may be of any type; each text of a repeated id is learned from, with
    the id's greatest language. Rows without id, language or letter teach nothing. None if there is no other.
    """
    prepare(docs.sparkSession)
    labelled = docs.where(learn).select(F.col(id_col).alias("id"), F.col(lang_col).alias("label"))
    ids = learning.sample_ids(labelled, per_language)
    ids = docs.sparkSession.createDataFrame(ids.toPandas(), ids.schema)  # bounded by per_language
    sample = learning.with_texts(ids, docs, id_col, text_col)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            rows = rows[[has_letter(t) for t in rows["text"]]]
            if not len(rows):
                continue
            flat, mask, first = windows(rows["text"].tolist())
            parts = [x.tobytes() for x in np.split(flat, first[1:])]
            sizes = np.add.reduceat(mask.sum(axis=1, dtype=np.int64), first)
            yield pd.DataFrame({"id": rows["id"].to_numpy(), "label": rows["label"].to_numpy(), "windows": parts, "n": sizes})

    found = sample.select("id", "label", "text").mapInPandas(cut, "id string, label string, windows binary, n long").toPandas()
    if not len(found):
        return None
    found = found.sort_values(["id", "n", "windows"])
    languages = sorted(found["label"].unique())
    flat = np.frombuffer(b"".join(found["windows"]), np.uint8).reshape(-1, WINDOW)
    # all windows of a text are full but for its last one
    counts, mask = (-(-found["n"].to_numpy() // WINDOW)), np.ones(flat.shape, np.float32)
    for end, n in zip(np.cumsum(counts), found["n"]):
        mask[end - 1, (n - 1) % WINDOW + 1 :] = 0
    # a language's windows count alike, however rare it is in the sample
    labels = np.repeat(found["label"].map({x: k for k, x in enumerate(languages)}).to_numpy(), counts)
    most = np.bincount(labels).max()
    rng = np.random.default_rng(3)
    at = np.concatenate([np.resize(rng.permutation(np.flatnonzero(labels == k)), most) for k in range(len(languages))])
    return fit(flat[at], mask[at], labels[at], languages)


def predict_language(docs: DataFrame, net: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, lang_pred, score.

    score is the probability of the language predicted. A text that is null or has no letter is ``und`` with score 1;
    so is every text, with score 0, if there was nothing to learn from. Repeated rows get equal rows; other columns are
    not read; an empty table gives no rows.
    """

    @F.pandas_udf("struct<lang_pred: string, score: double>")
    def label(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            lang, score = np.array(["und"] * len(texts), dtype=object), np.ones(len(texts))
            known = np.flatnonzero([has_letter(t) for t in texts])
            if net is None:
                score[known] = 0.0
            elif len(known):
                part, size = [], 0
                for i in [*known, None]:  # some MB of text at a time
                    if i is None or size > 4_000_000:
                        p = net.document_probabilities([texts.iloc[k] for k in part])
                        best = p.argmax(axis=1)
                        lang[part], score[part] = np.array(net.languages, dtype=object)[best], p[np.arange(len(p)), best]
                        part, size = [], 0
                    if i is not None:
                        part.append(i)
                        size += len(texts.iloc[i])
            yield pd.DataFrame({"lang_pred": lang, "score": np.clip(score, 0, 1)})

    return docs.select(F.col(id_col), label(F.col(text_col)).alias("r")).select(id_col, "r.*")
