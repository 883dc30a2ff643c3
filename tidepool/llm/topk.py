"""Exact top-k inner products by block-at-a-time pruning.

Every component x becomes the integer term impact floor(256 x). Vectors in order of their nearest centre, then of id, are
cut into document-range blocks, each with the largest and smallest impact of every term and a forward index (the block's
own vectors, term by term). Centres come from a bounded sample; they only order the rows, so that a block holds like
vectors and its bounds are close. For a query, a block's bound is the sum over terms of the most that the term can add. Each query's
best block by its bound is scored first, then every block whose bound reaches the query's kth score so far, whole from its forward index.
Partitions of shards (32 blocks) meet partitions of query chunks as a product: each task reads one of either from the
shared folder, so queries are neither broadcast nor shuffled once for each shard. A task keeps the k best of each of its
queries from shard to shard and gives them once; these are ranked together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepool.llm.base import mapped, saved

_SHARD = "dim int, n array<int>, ids binary, impacts binary, high binary, low binary"
_CHUNK = "number long, qdim int, qids binary, numbers binary, q binary"
#: At most so many ranges of vectors, as the driver samples in proportion to them; so many groups of shards in the product, as
#: each gives k rows a query; and so many chunks of queries in a file.
_RANGES, _GROUPS, _CHUNKS = 1000, 32, 8
#: Components in a shard and in a chunk, at most: fewer rows where vectors are long.
_SHARD_CELLS, _CHUNK_CELLS, _SAMPLE_CELLS = 1 << 20, 1 << 18, 1 << 20


def impacts(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, v, dim): integer impacts of the rows whose id and components are all present and finite."""
    x = F.col(vector_col)
    odd = F.exists(x, lambda y: y.isNull() | F.isnan(y) | (F.abs(y) == float("inf")))
    rows = vectors.where(F.col(id_col).isNotNull() & x.isNotNull()).where(~odd)
    v = F.transform(x, lambda y: F.floor(y.cast("double") * 256).cast("long"))
    return rows.select(F.col(id_col).cast("long").alias("id"), v.alias("v"), F.size(x).alias("dim"))


def _narrow(x: np.ndarray) -> np.ndarray:
    """x in 2 or 4 bytes where they hold it; the reader tells by the length."""
    most = max(-int(x.min(initial=0)), int(x.max(initial=0)))
    return x.astype(np.int16 if most < 2**15 else np.int32 if most < 2**31 else np.int64)


def _wide(data: bytes, n: int, dim: int) -> np.ndarray:
    kind = {2 * n * dim: np.int16, 4 * n * dim: np.int32}.get(len(data), np.int64)
    return np.frombuffer(data, kind).reshape(n, dim).astype(np.int64)


def _matrix(v: pd.Series, dim: int) -> np.ndarray:
    return np.concatenate(list(v)).astype(np.int64).reshape(len(v), dim)


def _grouped(batches: Iterator[pd.DataFrame], rows: int, cells: int) -> Iterator[tuple[int, pd.DataFrame]]:
    """(dim, rows of that dim) in the order given, as many as `rows` and `cells` components allow, across Arrow batches."""
    held: dict[int, list[pd.DataFrame]] = {}
    for batch in batches:
        for dim, own in batch.groupby("dim", sort=False):
            most = max(1, min(rows, cells // max(1, dim)))
            got = pd.concat([*held.pop(dim, []), own], ignore_index=True)
            full = len(got) // most * most
            for at in range(0, full, most):
                yield dim, got.iloc[at : at + most]
            if full < len(got):
                held[dim] = [got.iloc[full:]]
    for dim, rest in held.items():
        yield dim, rest[0]


def _pack(block_rows: int, shard_rows: int):
    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last: dict[int, tuple] = {}
        for dim, own in _grouped(batches, shard_rows, _SHARD_CELLS):
            ids, v = own["id"].to_numpy(np.int64), _matrix(own["v"], dim)
            new = np.ones(len(ids), bool)
            new[1:] = (ids[1:] != ids[:-1]) | (v[1:] != v[:-1]).any(axis=1)
            if dim in last and last[dim][0] == ids[0] and np.array_equal(last[dim][1], v[0]):
                new[0] = False
            last = {dim: (ids[-1], v[-1].copy())}
            i, x = ids[new], v[new]
            if len(i):
                cuts = range(0, len(i), block_rows)
                high = np.array([x[c : c + block_rows].max(axis=0) for c in cuts], np.int64)
                low = np.array([x[c : c + block_rows].min(axis=0) for c in cuts], np.int64)
                sizes = [len(i[c : c + block_rows]) for c in cuts]
                yield pd.DataFrame([(dim, sizes, i.tobytes(), _narrow(x).tobytes(), high.tobytes(), low.tobytes())], columns=["dim", "n", "ids", "impacts", "high", "low"])

    return pack


def _chunks(chunk: int):
    def chunks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = TaskContext.get().partitionId() << 32
        for dim, x in _grouped(batches, chunk, _CHUNK_CELLS):
            v = _matrix(x["v"], dim)
            yield pd.DataFrame([(number, dim, x["id"].to_numpy(np.int64).tobytes(), x["number"].to_numpy(np.int64).tobytes(), _narrow(v).tobytes())], columns=["number", "qdim", "qids", "numbers", "q"])
            number += 1

    return chunks


def centres(rows: DataFrame, n: int, sample: int = 4096, number: int = 64, rounds: int = 5) -> dict[int, np.ndarray]:
    """For each length of vector that about `sample` of the n rows have, up to `number` centres by k-means.

    Equal rows count once, and long vectors make the sample smaller: the driver holds _SAMPLE_CELLS components, about."""
    cells = rows.agg(F.sum(F.col("dim").cast("long"))).first()[0] or 0
    share = min(1.0, sample / max(1, n), _SAMPLE_CELLS / max(1, cells))
    picked = F.pmod(F.xxhash64("id", "v", F.lit("centre")), F.lit(1_000_000)) < share * 1_000_000
    some = rows.where((F.col("dim") > 0) & picked).select("id", "dim", "v").dropDuplicates(["id", "v"]).orderBy("id", "v").collect()
    found = {}
    for dim in {r["dim"] for r in some}:
        x = np.array([r["v"] for r in some if r["dim"] == dim], np.float64)
        at = x[:: max(1, len(x) // number)][:number].copy()
        for _ in range(rounds):
            own = nearest(x, at)
            for j in np.unique(own):
                at[j] = x[own == j].mean(axis=0)
        found[dim] = at
    return found


def nearest(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The number of the nearest centre for each row."""
    return np.argmax(x @ at.T - 0.5 * (at * at).sum(axis=1), axis=1)


def _celled(rows: DataFrame, at: dict[int, np.ndarray]) -> DataFrame:
    """rows with `cell`, the number of the nearest centre."""

    def cell(v: pd.Series) -> pd.Series:
        out = np.zeros(len(v), np.int32)
        dims = v.map(len).to_numpy()
        for dim in np.unique(dims):
            if dim in at:
                own = np.flatnonzero(dims == dim)
                out[own] = nearest(_matrix(v.iloc[own], dim).astype(np.float64), at[dim])
        return pd.Series(out)

    return rows.withColumn("cell", mapped(cell, "int", F.col("v")))


def _kind(a: np.ndarray, b: np.ndarray) -> type:
    """The narrowest type in which a @ b.T of integers is exact: no partial sum passes the product of the rows' norms."""
    x, y = a.astype(np.float64), b.astype(np.float64)
    norms = [np.sqrt(np.einsum("ij,ij->i", z, z).max(initial=0.0)) for z in (x, y)]
    most = norms[0] * norms[1] * 1.001
    return np.float32 if most < 2**24 else np.float64 if most < 2**53 else np.int64


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T of integers, exact."""
    kind = _kind(a, b)
    return (a.astype(kind) @ b.astype(kind).T).astype(np.int64)


def _bounds(q: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """The most that a row of each block can score for each query; rounded up, and at most what 8 bytes hold, where products pass 2^53."""
    up, down = np.maximum(q, 0), np.minimum(q, 0)
    if np.int64 not in (_kind(up, high), _kind(down, low)):
        return _product(up, high) + _product(down, low)
    up, down, high, low = (x.astype(np.float64) for x in (up, down, high, low))
    most = up @ high.T + down @ low.T + 1e-12 * ((up - down) @ np.maximum(np.abs(high), np.abs(low)).T)
    return np.clip(most, -(2.0**63), 2.0**63 - 1024).astype(np.int64)


def best_of_shard(qids: np.ndarray, q: np.ndarray, ids: np.ndarray, v: np.ndarray, sizes: list[int], high: np.ndarray, low: np.ndarray, k: int, top: tuple | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(query's number, id, score) of the k best for each query of a shard and of top (the best before it, in that form), and how many block scorings were made."""
    bound = _bounds(q, high, low)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    least = np.minimum.reduceat(ids, starts[:-1])
    kind = _kind(q, v)
    q, v = q.astype(kind), v.astype(kind)
    w, i, s = top if top is not None else (np.zeros(0, np.int64),) * 3
    # the kth score and id of each query, or, while it has fewer, what any row passes
    nothing = np.iinfo(np.int64).min
    kth, kid = np.full(len(q), nothing), np.full(len(q), np.iinfo(np.int64).max)
    found, waiting, scored = [], 0, 0

    def ranked(most: int) -> None:
        """Ranks what was found, once it is more than `most`."""
        nonlocal w, i, s, found, waiting
        if 0 < most and waiting <= most:
            return
        if found:
            w, i, s = (np.concatenate([x, *(f[c] for f in found)]) for c, x in enumerate((w, i, s)))
            by = np.lexsort((i, -s, w))
            w, i, s = w[by], i[by], s[by]
            keep = np.arange(len(w)) - np.searchsorted(w, w, "left") < k
            w, i, s = w[keep], i[keep], s[keep]
            found, waiting = [], 0
        ends = np.cumsum(np.bincount(w, minlength=len(q)))
        have = np.diff(ends, prepend=0) >= k
        kth[have], kid[have] = s[ends[have] - 1], i[ends[have] - 1]

    def score(block: int, who: np.ndarray, needed: np.ndarray) -> None:
        nonlocal waiting, scored
        own = slice(starts[block], starts[block + 1])
        all_ = q[who] if len(who) < len(q) else q
        x = all_ @ v[own].T
        if x.shape[1] > k and (needed == nothing).any():
            # a query's first block gives its k best and their ties alone
            x[qids[who][:, None] == ids[own][None, :]] = nothing
            needed = np.maximum(needed, np.partition(x, -k, axis=1)[:, -k].astype(np.int64))
        a, b = np.divmod(np.flatnonzero(x >= needed.astype(kind)[:, None]), x.shape[1])
        other = qids[who[a]] != ids[own][b]
        a, b = a[other], b[other]
        found.append((who[a], ids[own][b], x[a, b].astype(np.int64)))
        waiting += len(a)
        scored += len(who)

    ranked(0)
    first = np.argmax(bound, axis=1)
    for only_first in (True, False):
        order = np.unique(first) if only_first else np.argsort(-bound.max(axis=0, initial=0), kind="stable")
        for block in order:
            # of rows as good as the kth, only those of smaller ids count
            needed = kth + (kid <= least[block])
            open_ = (bound[:, block] >= needed) & ((first == block) == only_first)
            who = np.flatnonzero(open_)
            if len(who):
                score(block, who, needed[who])
                if not only_first:
                    ranked(4 * k * len(q))
        ranked(0)
    return w, i, s, scored


def top_k(vectors: DataFrame, is_query: Column | None = None, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", block_rows: int = 256, shard_rows: int = 8192, chunk: int = 2048) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest integer inner products of each query with all rows but its own.

    is_query picks the queries by id_col (default: ids divisible by 50). Ties go to the smaller vec_id; there are fewer
    than k rows where there are fewer candidates. Rows with a null id, a null vector or a null or non-finite component
    take no part. Rows that repeat both id and vector count once; an id with several vectors is several queries of that
    id, whose ranks are given apart, and all its rows are its own. Vectors of different lengths do not meet. Empty
    vectors score 0 among themselves. An empty table gives no rows; extra columns are ignored.
    """
    rows = impacts(vectors, id_col, vector_col)
    n = rows.count()
    parts = max(1, min(_RANGES, -(-n // shard_rows)))
    ordered = _celled(rows, centres(rows, n)).repartitionByRange(parts, "dim", "cell", "id").sortWithinPartitions("dim", "cell", "id", "v")
    shards = saved(ordered.select("id", "v", "dim").mapInPandas(_pack(block_rows, shard_rows), _SHARD))
    asked = rows.where(is_query if is_query is not None else F.col("id") % 50 == 0).dropDuplicates(["id", "v"]).withColumn("number", F.xxhash64("v"))
    files = max(1, -(-asked.count() // (_CHUNKS * chunk)))
    asked = saved(asked.repartition(files).mapInPandas(_chunks(chunk), _CHUNK))
    # no condition of equality and a hint, so that neither side is broadcast or dealt out by a key
    pairs = shards.coalesce(_GROUPS).crossJoin(asked.hint("shuffle_replicate_nl")).where((F.col("dim") <= F.col("qdim")) & (F.col("dim") >= F.col("qdim")))

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tops: dict[int, tuple] = {}
        for batch in batches:
            for r in batch.itertuples(index=False):
                qids, ids, sizes = np.frombuffer(r.qids, np.int64), np.frombuffer(r.ids, np.int64), [int(x) for x in r.n]
                high, low = (np.frombuffer(x, np.int64).reshape(len(sizes), r.dim) for x in (r.high, r.low))
                before = tops[r.number][2] if r.number in tops else None
                *top, _ = best_of_shard(qids, _wide(r.q, len(qids), r.dim), ids, _wide(r.impacts, len(ids), r.dim), sizes, high, low, k, before)
                tops[r.number] = qids, np.frombuffer(r.numbers, np.int64), tuple(top)
        for qids, numbers, (w, i, s) in tops.values():
            yield pd.DataFrame({"query_id": qids[w], "q": numbers[w], "vec_id": i, "score": s})

    found = pairs.select("dim", "number", "qids", "numbers", "q", "n", "ids", "impacts", "high", "low").mapInPandas(best, "query_id long, q long, vec_id long, score long")
    rank = "row_number() over (partition by query_id, q order by score desc, vec_id)"
    return found.withColumn("rank", F.expr(rank)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
