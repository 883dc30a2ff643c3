"""Quality scores by Bradley-Terry ranking: a weight for each text feature, learned from preference pairs.

A pair is a text labelled good and one labelled bad; the logistic loss on the difference of their features is minimised
by gradient descent with an L2 penalty. The cut is a quantile of the learned scores: the one that mislabels least of the
training sample, in the middle of the gap there. Scores are mapped to 0..1 so that the cut lies at 0.7.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepool.llm.base import bounded_sample, mapped, saved, split_of

CUT = 0.7
_SYMBOL, _UPPER, _DIGIT, _LETTER, _SPACE = range(5)


def _kinds() -> np.ndarray:
    """The kind of every code point below 2^16; above, all count as symbols."""
    kind = np.full(1 << 16, _SYMBOL, np.uint8)
    for c in range(1 << 16):
        x = chr(c)
        kind[c] = _SPACE if x.isspace() else _UPPER if x.isupper() else _LETTER if x.isalpha() else _DIGIT if x.isnumeric() else _SYMBOL
    return kind


_KIND = _kinds()
_PLAIN = np.isin(np.arange(1 << 16), [ord(c) for c in ".,;:'\"-()?"])


def _shares(text: str) -> list[float]:
    n = len(text)
    count, odd, runs, shouts, last = np.zeros(5), 0, 0, 0, -1
    for at in range(0, n, 1 << 16):
        points = np.frombuffer(text[at : at + (1 << 16)].encode("utf-32-le", "surrogatepass"), np.uint32)
        points = np.minimum(points, 0xFFFF)
        kind = _KIND[points]
        count += np.bincount(kind, minlength=5)[:5]
        strange = (kind == _SYMBOL) & ~_PLAIN[points]
        odd += int(strange.sum())
        runs += int((strange[1:] & (points[1:] == points[:-1])).sum()) + int(strange[0] and points[0] == last)
        last = int(points[-1])
        shouts += int((points == 33).sum())
    letters = count[_UPPER] + count[_LETTER]
    return [count[_SYMBOL] / n, odd / n, runs / n, shouts / n, count[_DIGIT] / n, count[_SPACE] / n, count[_UPPER] / letters if letters else 0.0]


def features(text: str | None) -> list[float]:
    """Shares of kinds of characters, repetition of words and lines, lengths. Null and empty texts give zeros."""
    words = (text or "").split()
    if not words:
        return [0.0] * N_FEATURES
    n = len(words)
    share = _shares(text)
    same = sum(map(str.__eq__, words, words[1:])) / n
    often = Counter(words)
    top = sum(c for _, c in often.most_common(3)) / (n + 20)  # a few words tell little
    varied = len(often) / n ** 0.8
    ends = sum(w[-1] in ".!?" for w in words) / n
    lone = sum(len(w) == 1 and not w.isalnum() for w in words) / n
    lines = [x for x in text.split("\n") if x]
    kept = len(set(lines)) / len(lines) if lines else 1.0
    chars = sum(map(len, words)) / n
    return [*share, *(math.sqrt(x) for x in share[1:5]), same, math.sqrt(same), top, min(varied, 2.0), ends, lone, math.sqrt(lone), 1 - kept, math.log1p(n) / 10, min(chars, 40.0) / 10, max(0.0, chars - 8) / 10]


N_FEATURES = 22


@dataclass
class Ranker:
    mean: np.ndarray = field(default_factory=lambda: np.zeros(N_FEATURES))
    scale: np.ndarray = field(default_factory=lambda: np.ones(N_FEATURES))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(N_FEATURES))
    cut: float = 0.0
    spread: float = 1.0

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        at = (self.raw(x) - self.cut) / self.spread + math.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(at, -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, pairs: int = 40_000, rounds: int = 400, l2: float = 1e-3, seed: int = 11) -> Ranker:
    """x: features; y: 1 good, 0 bad. With one class only, everything scores alike: above the cut if good, else below."""
    model = Ranker()
    good, bad = np.nonzero(y == 1)[0], np.nonzero(y != 1)[0]
    if not len(good) or not len(bad):
        model.cut = -1.0 if len(good) or not len(bad) else 1.0
        return model
    model.mean, model.scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    draw = np.random.default_rng(seed)
    z = np.clip((x - model.mean) / model.scale, -8, 8)
    d = z[good[draw.integers(len(good), size=pairs)]] - z[bad[draw.integers(len(bad), size=pairs)]]
    w, speed = np.zeros(x.shape[1]), np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(np.clip(d @ w, -40, 40)))
        speed = 0.9 * speed + (d * p[:, None]).mean(axis=0) - l2 * w
        w = w + 0.1 * speed
    model.weights = w
    raw = z @ w
    order = np.argsort(raw, kind="stable")
    s, good_below = raw[order], np.concatenate([[0], np.cumsum(y[order] == 1)])
    bad_above = len(bad) - np.concatenate([[0], np.cumsum(y[order] != 1)])
    wrong = good_below / len(good) + bad_above / len(bad)  # at the quantile k / n, for each k
    k = int(np.argmin(wrong))
    model.cut = float(s[0] - 1 if k == 0 else s[-1] + 1 if k == len(s) else (s[k - 1] + s[k]) / 2)
    model.spread = float(max(raw.std() / 2, 1e-6))
    return model


def _measure(texts: pd.Series) -> pd.Series:
    return pd.Series([features(t) for t in texts], dtype=object)


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", per_label: int = 4000) -> Ranker:
    """The ranking from at most about per_label labelled rows of each label whose crc32(id as text) mod 4 is not 2."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y is not null").distinct()
    known = saved(bounded_sample(known.where(split_of(F.col("id"), 4) != 2), F.col("id"), "y", per_label, "id"))
    sample = rows.join(F.broadcast(known), "id").select("id", "y", mapped(_measure, "array<double>", F.col("text")).alias("x"))  # some 2 x per_label ids
    sample = sorted(sample.collect(), key=lambda r: (r["id"], r["y"], r["x"]))
    x = np.array([r["x"] for r in sample], np.float64).reshape(-1, N_FEATURES)
    return fit(x, np.array([r["y"] for r in sample], np.int64))


def score_of(text: Column, model: Ranker) -> Column:
    """The score of a text column, from 0 to 1."""

    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.array([features(t) for t in texts], np.float64).reshape(-1, N_FEATURES)))

    return mapped(score, "double", text.cast("string"))


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", per_label: int = 4000) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs.

    Rows with crc32(doc_id as text) mod 4 = 2 are held out (a null id is not). Labels are joined by id; null ones are
    ignored. Null and empty texts are scored like any other, from features that are all zero. Equal texts get equal
    scores; repeated rows are returned as often as they occur; an empty table gives no rows; extra columns are ignored.
    Without both labels to learn from, all rows score alike.
    """
    model = learn(docs, labels, id_col, text_col, label_col, per_label)
    scored = docs.select(F.col(id_col).alias("doc_id"), score_of(F.col(text_col), model).alias("score"))
    return scored.select("doc_id", (split_of(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", per_label: int = 4000) -> DataFrame:
    """The rows of docs that score at least 0.7, with the columns of docs. Rows that share an id are judged each by its own text."""
    return docs.where(score_of(F.col(text_col), learn(docs, labels, id_col, text_col, label_col, per_label)) >= CUT)
