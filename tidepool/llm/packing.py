"""Packing documents into training sequences by column generation for the cutting-stock problem.

A document of n tokens is cut into pieces of the whole sequence length and one remainder. How many pieces have each
length is a histogram of bounded size. Over it, a linear program chooses patterns (multisets of lengths that fit a
sequence) at least padded size; a knapsack dynamic program on the dual prices finds the columns. Patterns are rounded
down; what is left over is filled largest first, each time with the longest piece that still fits. Pieces, ranked
within their length, are then dealt to the patterns by arithmetic on their ranks, without meeting in one place.
"""

from __future__ import annotations

import base64
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepool.llm.base import mapped, saved

SIZE = 1024
END = 0
#: Characters on which every Unicode version agrees about letters, digits and spaces: printable ASCII, line feed, Latin letters.
_COMMON = regex.compile(r"[ -~\nÀ-ɏ]*")
#: The public pattern of this vocabulary's words (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=2)
def _reference(path: str):
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.encode_special_tokens = True
    return found


@lru_cache(maxsize=2)
def _ranked(path: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("ranked", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_ids(text: str | None, tokenizer: str, ranks: str | None = None) -> np.ndarray:
    """Ids of a text, then END. ranks: the same vocabulary for the faster encoder, used where both must agree."""
    if not text:
        return np.array([END], "<u4")
    if ranks and _COMMON.fullmatch(text):
        ids = _ranked(ranks).encode_to_numpy(text, disallowed_special=())
    else:
        ids = _reference(tokenizer).encode(text, add_special_tokens=False).ids
    return np.append(np.asarray(ids, "<u4"), np.array([END], "<u4"))


def pieces(docs: DataFrame, tokenizer: str, ranks: str | None, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens): whole pieces of `size` tokens and the remainder of every row."""

    def cut(texts: pd.Series) -> pd.Series:
        """For each text, its number of tokens, then the checksum of each piece."""
        out = []
        for text in texts:
            ids = token_ids(text, tokenizer, ranks)
            out.append(np.array([len(ids), *(zlib.crc32(ids[at : at + size].data) for at in range(0, len(ids), size))], np.int64))
        return pd.Series(out, dtype=object)

    rows = docs.select(F.col(id_col).alias("doc_id"), mapped(cut, "array<long>", F.col(text_col).cast("string")).alias("own"))
    rows = rows.select("doc_id", F.col("own")[0].alias("doc_tokens"), F.posexplode(F.slice("own", 2, F.size("own"))).alias("k", "ids_crc32"))
    start = F.col("k").cast("long") * size
    return rows.select("doc_id", start.alias("start"), F.least(F.lit(size).cast("long"), F.col("doc_tokens") - start).alias("length"), "ids_crc32", "doc_tokens")


def padded(fill: int, size: int) -> int:
    """A sequence's length after padding: none at a power of two."""
    return fill if fill & (fill - 1) == 0 else size


def _knapsack(lengths: np.ndarray, prices: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """For every fill up to size, the largest sum of prices of lengths with exactly that sum, and the last length's number."""
    value, last = np.full(size + 1, -np.inf), np.zeros(size + 1, np.int64)
    value[0] = 0.0
    fits = np.searchsorted(lengths, np.arange(size + 1), "right")
    for c in range(1, size + 1):
        k = fits[c]
        if k:
            gain = value[c - lengths[:k]] + prices[:k]
            best = int(gain.argmax())
            value[c], last[c] = gain[best], best
    return value, last


def relaxed_patterns(demand: dict[int, int], size: int = SIZE, slack: float = 0.03, rounds: int = 1500) -> list[tuple[dict[int, int], float]]:
    """(pattern, how often) of the linear relaxation. demand: number of pieces by length below size.

    minimise padded size of the patterns + (1 + slack) x tokens left over, so that patterns and leftovers meet the demand.
    A leftover is filled afterwards, at about that price; as a column it bounds the dual prices, which else swing wildly.
    """
    lengths = np.array(sorted(x for x, n in demand.items() if 0 < x < size and n), np.int64)
    m = len(lengths)
    if not m:
        return []
    d = np.array([demand[int(x)] for x in lengths], np.float64)
    cost = np.array([padded(c, size) for c in range(size + 1)], np.float64)
    over = (1 + slack) * lengths - slack * size / 64  # the last term favours patterns of few pieces
    basis, price, inverse = np.eye(m), over.copy(), np.eye(m)
    x, dual = d.copy(), over.copy()

    def enter(column: np.ndarray, its_price: float) -> bool:
        nonlocal x, dual
        way = inverse @ column
        up = way > 1e-9
        if not up.any():
            return False
        ratio = np.full(m, np.inf)
        ratio[up] = np.maximum(x[up], 0) / way[up]
        out = int(ratio.argmin())
        basis[:, out], price[out] = column, its_price
        row = inverse[out] / way[out]
        np.subtract(inverse, np.outer(way, row), out=inverse)
        inverse[out] = row
        x = inverse @ d
        dual = price @ inverse
        return True

    was = np.inf
    for step in range(rounds):
        if step % 100 == 99:
            inverse[:] = np.linalg.inv(basis)
            x, dual = inverse @ d, price @ inverse
            if step % 200 == 199 and (was - (was := float(price @ x))) < 2e-4 * was:
                break
        unit = int((dual - over).argmax())  # a length priced above leaving it over
        if dual[unit] - over[unit] > 1e-6 * size:
            if not enter(np.eye(m)[unit], over[unit]):
                break
            continue
        unit = int(dual.argmin())  # a length priced below nothing: more room for it than there are pieces
        if dual[unit] < -1e-6 * size:
            if not enter(-np.eye(m)[unit], 0.0):
                break
            continue
        value, last = _knapsack(lengths, dual, size)
        gain = value - cost
        c = int(gain.argmax())
        if gain[c] <= 1e-6 * size:
            break
        column, fill = np.zeros(m), c
        while fill:
            column[last[fill]] += 1
            fill -= int(lengths[last[fill]])
        if not enter(column, cost[c]):
            break
    found = []
    for k in range(m):
        column = {int(lengths[i]): int(basis[i, k]) for i in np.nonzero(basis[:, k])[0]}
        if x[k] > 1e-9 and price[k] == cost[max(0, sum(y * n for y, n in column.items()))]:
            found.append((column, float(x[k])))
    return found


def _fill(first: int, left: Counter, size: int) -> dict[int, int]:
    """first and, again and again, the longest piece that still fits. Takes them out of left."""
    pattern, room = Counter(), size
    x = first
    while x:
        pattern[x] += 1
        left[x] -= 1
        room -= x
        x = next((y for y in range(min(room, x), 0, -1) if left[y] > 0), 0)
    return dict(pattern)


def plan(demand: dict[int, int], size: int = SIZE) -> list[tuple[dict[int, int], int]]:
    """(pattern, how often), whole numbers that use up the demand exactly."""
    found: Counter = Counter()
    left = Counter({x: n for x, n in demand.items() if n and x < size})
    fractions = []
    for pattern, often in relaxed_patterns(left, size):
        whole = min(int(often + 1e-6), *(left[x] // n for x, n in pattern.items()))
        if whole > 0:
            found[tuple(sorted(pattern.items()))] += whole
            left.subtract({x: n * whole for x, n in pattern.items()})
        fractions.append((whole - often, tuple(sorted(pattern.items()))))
    for _, pattern in sorted(fractions):  # those cut off most are taken once more where the rest allows it
        if sum(x * n for x, n in pattern) == size and all(left[x] >= n for x, n in pattern):
            found[pattern] += 1
            left.subtract(dict(pattern))
    while left := Counter({x: n for x, n in left.items() if n > 0}):
        pattern = _fill(max(left), left, size)
        found[tuple(sorted(pattern.items()))] += 1
    out = [(dict(pattern), often) for pattern, often in sorted(found.items())]
    if demand.get(size):
        out.append(({size: 1}, demand[size]))
    return out


class Deal:
    """Where the piece of a rank within its length goes. Its tables hold a row for each pattern and length in it."""

    def __init__(self, patterns: list[tuple[dict[int, int], int]]):
        rows, taken, sequence = [], Counter(), 0
        for pattern, often in patterns:
            offset = 0
            for x in sorted(pattern, reverse=True):
                rows.append((x, taken[x], pattern[x], sequence, offset))
                taken[x] += pattern[x] * often
                offset += x * pattern[x]
            sequence += often
        rows.sort()
        self.table = np.array(rows, np.int64).reshape(-1, 5)
        self.first = {int(x): i for i, x in reversed(list(enumerate(self.table[:, 0])))}

    def __call__(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        for x in np.unique(length):
            own = np.nonzero(length == x)[0]
            a = self.first[int(x)]
            b = int(np.searchsorted(self.table[:, 0], x, "right"))
            part = self.table[a:b]
            at = part[np.searchsorted(part[:, 1], rank[own], "right") - 1]
            k = rank[own] - at[:, 1]
            sequence[own] = at[:, 3] + k // at[:, 2]
            offset[own] = at[:, 4] + k % at[:, 2] * x
        return sequence, offset


def pack(docs: DataFrame, tokenizer: str, ranks: str | None = None, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text", rank_rows: int = 1000) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset): every piece of every row of docs and its place.

    A row's ids are those of its text (null: empty), then END; each lies in exactly one piece. Sequences hold at
    most `size` tokens and are filled from 0 without gaps. Rows with equal or null ids are documents of their own. An
    empty table gives no rows; extra columns are ignored. tokenizer and ranks are paths that every executor can open.
    """
    # the input's partition parts rows that repeat id, place and checksum
    cut = saved(pieces(docs, tokenizer, ranks, size, id_col, text_col).withColumn("part", F.spark_partition_id()))
    demand = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # size rows at most
    deal = docs.sparkSession.sparkContext.broadcast(Deal(plan(demand, size)))
    # ranks within a length: a frequent length is split into salts of about rank_rows, whose counts give each its first rank
    by_length = F.split(F.lit(",".join(str(demand.get(x, 0) // rank_rows + 1) for x in range(size + 1))), ",").cast("array<bigint>")
    salted = cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", "part"), F.get(by_length, F.col("length").cast("int"))))
    counts = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    own = Window.partitionBy("length", "salt").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")
    ranked = salted.withColumn("rank", F.row_number().over(own) - 1).join(counts, ["length", "salt"])
    ranked = ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("rank") + F.col("base")).alias("rank"))

    def dealt(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(dict(zip(("sequence_id", "offset"), deal.value(length.to_numpy(np.int64), rank.to_numpy(np.int64)))))

    place = mapped(dealt, "struct<sequence_id long, offset long>", F.col("length"), F.col("rank"))
    return ranked.withColumn("place", place).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "place.sequence_id", "place.offset")
