"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Lower-cased code points give n-grams of 1 to 3, hashed into 2^16 buckets. A text's value in a bucket is its share of the
text's n-grams times the bucket's inverse document frequency, which is counted over every training row. The weights
are learned on a bounded sample with follow-the-regularised-leader and an elastic net (L1 makes them sparse); a
temperature fitted on a fifth of that sample calibrates the probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepool.llm.base import bounded_sample, mapped, split_of

BUCKETS = 1 << 16
UNKNOWN = "und"
#: Shares of n-grams are small; the optimiser sees them times this.
SCALE = 20.0
_MULTIPLIERS = (np.uint32(2654435761), np.uint32(2246822519), np.uint32(3266489917))


def gram_pieces(text: str, size: int = 1 << 16) -> Iterator[np.ndarray]:
    """Buckets of all n-grams of one text, repeats included: at a time those that start at `size` places. Each comes once."""
    points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    for at in range(0, len(points), size):
        part, found = points[at : at + size + len(_MULTIPLIERS) - 1], []
        mix = np.zeros(len(part), np.uint32)
        for n, multiplier in enumerate(_MULTIPLIERS):
            mix = (mix[: len(part) - n] ^ part[n:]) * multiplier
            mix ^= mix >> np.uint32(15)
            found.append(mix[:size] >> np.uint32(16))
        yield np.concatenate(found)


def grams(text: str) -> np.ndarray:
    """Buckets of all n-grams of one text, repeats included."""
    return np.concatenate(list(gram_pieces(text)))


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


@dataclass
class Model:
    """labels in order; weights (buckets x labels) with the inverse document frequency multiplied in; bias; temperature."""

    labels: list[str] = field(default_factory=list)
    weights: np.ndarray = field(default_factory=lambda: np.zeros((BUCKETS, 0), np.float32))
    bias: np.ndarray = field(default_factory=lambda: np.zeros(0))
    temperature: float = 1.0

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.labels or not has_letter(text):
            return UNKNOWN, 0.0
        total, n = np.zeros(len(self.labels)), 0
        for some in gram_pieces(text):
            total += self.weights[some].sum(axis=0, dtype=np.float64)
            n += len(some)
        p = _softmax((total / n + self.bias) / self.temperature)
        best = int(p.argmax())
        return self.labels[best], float(p[best])


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def ftrl(
    rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, classes: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 1e-3, l2: float = 1e-4, steps: int = 8000, seed: int = 7
) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias by FTRL-proximal. rows: (distinct buckets, values). Only the buckets of a row are touched by it.
    Each step draws a class, then one of its rows, so that rare languages weigh as much as frequent ones."""
    z, n = np.zeros((BUCKETS + 1, classes)), np.zeros((BUCKETS + 1, classes))

    def weights(zi: np.ndarray, ni: np.ndarray) -> np.ndarray:
        w = -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2)
        return np.where(np.abs(zi) <= l1, 0.0, w)

    draw = np.random.default_rng(seed)
    members = [m for c in range(classes) if len(m := np.nonzero(y == c)[0])]
    for i in range(steps if rows else 0):
        own = members[i % len(members)]
        k = own[draw.integers(len(own))]
        at = np.append(rows[k][0], BUCKETS)  # the last one is the bias
        x = np.append(rows[k][1] * SCALE, 1.0)[:, None]
        w = weights(z[at], n[at])
        p = _softmax((x * w).sum(axis=0))
        p[y[k]] -= 1.0
        g = x * p[None, :]
        step = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
        z[at] += g - step * w
        n[at] += g * g
    w = weights(z, n)
    return w[:BUCKETS] * SCALE, w[BUCKETS]


def _temperature(scores: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least negative log likelihood, on a grid of powers."""
    if not len(y):
        return 1.0
    grid = np.geomspace(0.02, 20, 121)
    loss = [-np.log(np.maximum(_softmax(scores / t)[np.arange(len(y)), y], 1e-12)).mean() for t in grid]
    return float(grid[int(np.argmin(loss))])


def train(rows: DataFrame, text_col: str, label_col: str, id_col: str, per_label: int = 400) -> Model:
    """rows: the training rows alone. Document frequencies count them all; weights come from about per_label rows of each label."""
    good = rows.where(F.col(text_col).isNotNull() & F.col(label_col).isNotNull()).select(
        F.col(text_col).cast("string").alias("text"), F.col(label_col).cast("string").alias("label"), F.col(id_col).cast("string").alias("id")
    )

    def frequencies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df, n = np.zeros(BUCKETS, np.int64), 0
        for batch in batches:
            for text in batch["text"]:
                seen = np.zeros(BUCKETS, bool)
                seen[grams(text)] = True
                df += seen
                n += 1
        if n:
            yield pd.DataFrame({"df": [df.tobytes()], "n": [n]})

    def summed(batches: pd.DataFrame) -> pd.DataFrame:
        total = sum((np.frombuffer(x, np.int64) for x in batches["df"]), np.zeros(BUCKETS, np.int64))
        return pd.DataFrame({"df": [total.tobytes()], "n": [int(batches["n"].sum())]})

    # one array of fixed size for each partition; they are added in groups first, so the driver gets at most 16
    parts = good.select("text").mapInPandas(frequencies, "df binary, n long").groupBy((F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) + F.spark_partition_id()) % 16)
    sums = parts.applyInPandas(summed, "df binary, n long").collect()
    n = sum(r["n"] for r in sums)
    if not n:
        return Model()
    df = sum((np.frombuffer(r["df"], np.int64) for r in sums), np.zeros(BUCKETS, np.int64))
    idf = np.log((1 + n) / (1 + df)) + 1

    def sparse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for text in batch["text"]:
                at, count = np.unique(grams(text), return_counts=True)
                out.append((at.astype(np.int32).tobytes(), (count / count.sum()).astype(np.float32).tobytes()))
            yield pd.DataFrame({"id": batch["id"], "label": batch["label"], "at": [a for a, _ in out], "tf": [b for _, b in out]})

    sample = bounded_sample(good, F.col("id"), "label", per_label, "id").mapInPandas(sparse, "id string, label string, at binary, tf binary")
    sample = sorted(sample.collect(), key=lambda r: (r["id"] or "", r["label"], r["at"]))
    labels = sorted({r["label"] for r in sample})
    x, y = [], np.array([labels.index(r["label"]) for r in sample])
    for r in sample:
        at = np.frombuffer(r["at"], np.int32).astype(np.int64)
        v = np.frombuffer(r["tf"], np.float32) * idf[at]
        x.append((at, v))
    held = np.arange(len(x)) % 5 == 4
    w, bias = ftrl([r for r, h in zip(x, held) if not h], y[~held], len(labels))
    scores = np.array([(v[:, None] * w[at]).sum(axis=0) + bias for (at, v), h in zip(x, held) if h]).reshape(-1, len(labels))
    return Model(labels, (w * idf[:, None]).astype(np.float32), bias, _temperature(scores, y[held]))


def identify(docs: DataFrame, model: Model, id_col: Column, text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a fixed 2^16 weights for each label

    def predict(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([shared.value.predict(t) for t in texts], columns=["lang_pred", "score"])

    said = mapped(predict, "struct<lang_pred string, score double>", F.col(text_col).cast("string"))
    return docs.select(id_col.alias("doc_id"), said.alias("said")).select("doc_id", "said.lang_pred", "said.score")


def language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", per_label: int = 400) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row of docs.

    Rows with crc32(doc_id as text) mod 3 = 1 are held out; the others with text and language are learned from. A null
    doc_id is not held out. lang_pred is a learned value, or `und` (score 0) for null texts, texts without a letter and
    where nothing could be learned. Equal texts get equal answers. Repeated rows are returned as often as they occur; an
    empty table gives no rows; extra columns are ignored.
    """
    held = split_of(F.col(id_col), 3) == 1
    model = train(docs.where(~held), text_col, label_col, id_col, per_label)
    out = identify(docs, model, F.col(id_col), text_col)
    return out.select("doc_id", (split_of(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score")
