"""SimHash near-duplicates: fingerprints of word shingles, linked by tiled exact comparison.

near_duplicates() has 64-bit fingerprints of 3-word shingles and links at 2 bits. deduplicated() has 256-bit ones of the
set of 5-word shingles and links at 66 bits, 20 of them in the first word at most: sets of a cosine of 0.8 make
fingerprints that differ in 52 of 256 bits on average (standard deviation 6.5), and in 13 (3.2) of 64; unrelated ones in
128 (8) and 32 (4). Links are candidates there; the similarity is then held exactly.

Distinct fingerprints fall into tiles by population counts: of the four 16-bit words of a 64-bit fingerprint; or of the
first word of a longer one, in bands of its radius, and of the set itself, whose size bounds the cosine. Two fingerprints
within `radius` bits have population counts that differ by no more than `radius` (in sum over the words), so every other
pair of tiles is skipped without loss. A tile of any size is cut into blocks of about `block_rows` fingerprints; each pair
of blocks is compared whole, with exclusive-or and bit counts in numpy, and yields at most one link per fingerprint (the
links that connect what it found), never all pairs. Components come from distributed star rounds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import accumulate, product

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepool.llm.base import mapped, may_be_in, saved
from tidepool.llm.components import connected_components

SEED = 42
WORDS = 3
#: Of the 256-bit fingerprints: words of a shingle, bits that linked ones differ in at most, and such bits of the first word.
LONG_WORDS, LONG_RADIUS, FIRST_RADIUS = 5, 66, 20
SIMILARITY = 0.8


def fingerprint_of(text: str | None) -> int:
    """The fingerprint of one text, unsigned. Null and texts without words give 0."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    line, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= WORDS:
        hashes = np.array([digest(line, SEED)], np.uint64)
    else:
        ends = list(accumulate((len(w) + 1 for w in words), initial=0))
        hashes = np.fromiter((digest(line[a : b - 1], SEED) for a, b in zip(ends, ends[WORDS:])), np.uint64, len(words) - WORDS + 1)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 4096):
        part = hashes[at : at + 4096].astype("<u8", copy=False).view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprints(texts: pd.Series) -> pd.Series:
    return pd.Series(np.array([fingerprint_of(t) for t in texts], np.uint64).view(np.int64))


def simhash(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): the fingerprint of every row as a signed long. Other columns are dropped; null texts count as empty."""
    return docs.select(F.col(id_col).alias("id"), mapped(_fingerprints, "long", F.col(text_col).cast("string")).alias("fp"))


class _Forest:
    """Groups of the numbers below n, each known by its least member."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def apart(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        return self.label[u] != self.label[v]

    def join(self, u: np.ndarray, v: np.ndarray) -> None:
        label = self.label
        while len(u):
            lu, lv = label[u], label[v]
            open_ = lu != lv
            u, v, lu, lv = u[open_], v[open_], lu[open_], lv[open_]
            low = np.minimum(lu, lv)
            np.minimum.at(label, lu, low)
            np.minimum.at(label, lv, low)
            while (label != (up := label[label])).any():
                label[:] = up

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        moved = np.nonzero(self.label != np.arange(len(self.label)))[0]
        return moved, self.label[moved]


def _true_places(flags: np.ndarray) -> np.ndarray:
    """Where flags are true; few are, so eight are looked at together first."""
    even = len(flags) // 8 * 8
    eights = np.flatnonzero(flags[:even].view(np.uint64))
    found = (eights[:, None] * 8 + np.arange(8)).reshape(-1)
    return np.concatenate([found[flags[found]], np.flatnonzero(flags[even:]) + even])


def links_of_blocks(a: np.ndarray, b: np.ndarray | None, radius: int, near: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None, cells: int = 1 << 17) -> tuple[np.ndarray, np.ndarray]:
    """Places (node, root) in a, then b, of links that connect all pairs within radius: inside a if b is None, else between a and b. At most one per node.

    near: of places u and v within radius, those that link. cells: how many pairs are compared at a time.
    """
    right, shift = (a, 0) if b is None else (b, len(a))
    forest = _Forest(len(right) + shift)
    width = max(1, min(len(right), cells))
    rows = max(1, cells // width)
    differ, count = np.empty(rows * width, np.uint64), np.empty(rows * width, np.uint8)
    for at in range(0, len(a), rows):
        mine = a[at : at + rows, None]
        for to in range(0, len(right), width):
            theirs = right[None, to : to + width]
            shape = len(mine), theirs.shape[1]
            bits = np.bitwise_xor(mine, theirs, out=differ[: shape[0] * shape[1]].reshape(shape))
            close = np.bitwise_count(bits, out=count[: shape[0] * shape[1]].reshape(shape)) <= radius
            place = _true_places(close.reshape(-1))
            if not len(place):
                continue
            u, v = place // shape[1] + at, place % shape[1] + to + shift
            open_ = forest.apart(u, v)
            u, v = u[open_], v[open_]
            if near is not None and len(u):
                close = near(u, v)
                u, v = u[close], v[close]
            forest.join(u, v)
    return forest.links()


def compare_blocks(a: np.ndarray, b: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """links_of_blocks() as values instead of places."""
    both = a if b is None else np.concatenate([a, b])
    node, root = links_of_blocks(a, b, radius)
    return both[node], both[root]


def _offsets(radius: int, words: int = 4) -> list[tuple[int, ...]]:
    """Differences of population counts to compare, one of each pair of opposite ones."""
    found = [d for d in product(range(-radius, radius + 1), repeat=words) if sum(map(abs, d)) <= radius]
    return [d for d in found if d >= (0,) * words]


def near_links(fps: DataFrame, radius: int = 2, block_rows: int = 4096) -> DataFrame:
    """(a, b): links between the distinct values of fps.fp (long) that give the same components as all pairs within radius."""
    count = [F.bit_count(F.shiftrightunsigned("fp", 16 * k).bitwiseAND(F.lit(0xFFFF))).cast("int") for k in range(4)]
    tile = sum((c * (32**k) for k, c in enumerate(count)), F.lit(0)).cast("int")
    one = saved(fps.select("fp").where("fp is not null").distinct().withColumn("tile", tile))
    # 17^4 tiles at most, whatever the input: 83,521 rows of 16 bytes
    tiles = saved(one.groupBy("tile").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("parts")))
    blocks = saved(
        one.join(F.broadcast(tiles), "tile")
        .withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
        .groupBy("tile", "part")
        .agg(F.collect_list("fp").alias("fps"))
    )
    steps = F.array(*[F.lit(sum(d * 32**k for k, d in enumerate(o))) for o in _offsets(radius)])
    # a step from one tile to another never carries: counts are 0 to 16, and a wrong number names no tile
    pairs = (
        blocks.select("tile", "part", F.explode(steps).alias("step"))
        .withColumn("other", F.col("tile") + F.col("step"))
        .join(F.broadcast(tiles.select(F.col("tile").alias("other"), "parts")), "other")
        .withColumn("mate", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .where("tile <> other or mate >= part")
    )
    left = blocks.select("tile", "part", F.col("fps").alias("left"))
    right = blocks.select(F.col("tile").alias("other"), F.col("part").alias("mate"), F.col("fps").alias("right"))
    work = pairs.join(right, ["other", "mate"]).join(left, ["tile", "part"])
    work = work.select("left", F.when(F.expr("tile <> other or part <> mate"), F.col("right")).alias("right"))

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for x, y in zip(batch["left"], batch["right"]):
                a = np.asarray(x, np.int64).view(np.uint64)
                b = None if y is None else np.asarray(y, np.int64).view(np.uint64)
                u, v = compare_blocks(a, b, radius)
                if len(u):
                    found.append((u.view(np.int64), v.view(np.int64)))
            if found:
                yield pd.DataFrame({"a": np.concatenate([u for u, _ in found]), "b": np.concatenate([v for _, v in found])})

    return work.mapInPandas(compare, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 2) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of docs.

    fingerprint: 16 lowercase hex digits. component_id: the smallest doc_id that links of at most `radius` differing
    bits reach. Null, empty and wordless texts have fingerprint zero and link like any other. Rows with a null id keep a
    row each; they link others but never name a component, whose id is null if it holds null ids only. Repeated
    rows are returned as often as they occur. An empty table gives no rows. Extra columns of docs are ignored.
    """
    prints = saved(simhash(docs, id_col, text_col))
    low = saved(prints.groupBy("fp").agg(F.min("id").alias("low")))
    roots = connected_components(near_links(low, radius))
    named = roots.withColumnRenamed("node", "fp").join(low, "fp")
    least = named.groupBy("root").agg(F.min("low").alias("least"))
    linked = named.select("fp", "root").join(least, "root").select("fp", "least")
    # written first: then both sides of the last join are exchanged for it, and Spark can split a fingerprint that many rows share
    name = saved(low.join(linked, "fp", "left").select("fp", F.coalesce("least", "low").alias("component_id")))
    return prints.join(name, "fp").select(
        F.col("id").alias("doc_id"),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


#: ASCII letters to lower case, all else of ASCII but digits to blanks; bytes beyond ASCII stay.
_WORDS = bytes(c | 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or 48 <= c <= 57 or c > 127 else 32 for c in range(256))


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def words_of(text: str | None) -> list[bytes]:
    """Runs of letters and digits, A-Z in lower case; all beyond ASCII counts as letters."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_WORDS).split()


def shingle_set(words: list[bytes], shingle: int = LONG_WORDS) -> np.ndarray:
    """The distinct hashes of the runs of `shingle` words, sorted; fewer words are one run, none are none."""
    if not words:
        return np.zeros(0, np.uint64)
    one = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    k = min(shingle, len(words))
    run = one[: len(one) - k + 1]
    for j in range(1, k):
        run = _mixed(run) + one[j : len(one) - k + 1 + j]
    return np.unique(_mixed(run))


def long_fingerprint_of(shingles: np.ndarray) -> np.ndarray:
    """Four words of a 256-bit fingerprint of a set: a bit is 1 if set in over half of the hashes. One that half of them set
    is that of the least hash, so that texts of few shingles lie as far apart as others. The empty set gives zeros."""
    if not len(shingles):
        return np.zeros(4, np.uint64)
    counts = np.zeros(256, np.int64)
    for at in range(0, len(shingles), 4096):
        part = [shingles[at : at + 4096]]
        for _ in range(3):
            part.append(_mixed(part[-1] + np.uint64(0xD1B54A32D192ED03)))
        bits = np.unpackbits(np.stack(part, axis=1).astype("<u8", copy=False).view(np.uint8), axis=1, bitorder="little")
        if not at:
            first = bits[0].astype(bool)
        counts += bits.sum(axis=0, dtype=np.uint16)
    twice = counts * 2
    return np.packbits((twice > len(shingles)) | ((twice == len(shingles)) & first), bitorder="little").view("<u8")


def _linked(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs of rows link: their sizes allow enough similarity, and all four words differ in LONG_RADIUS bits at most."""
    few, many = np.minimum(a[:, 4], b[:, 4]), np.maximum(a[:, 4], b[:, 4])
    return (few >= SIMILARITY**2 * many) & (np.bitwise_count(a[:, :4] ^ b[:, :4]).sum(axis=1) <= LONG_RADIUS)


_ROW = ("f0", "f1", "f2", "f3", "n")
_PLACES = ("node", *_ROW)


def _table(columns: list) -> np.ndarray:
    """A row of four words and a size for each place of the columns."""
    return np.stack([np.asarray(c, np.int64).view(np.uint64) for c in columns], axis=1)


def long_links(prints: DataFrame, block_rows: int = 32_768, mates: int = 8) -> DataFrame:
    """(a, b): links between nodes of prints(node, f0, f1, f2, f3, n: long) with the components of all pairs that link.

    Tiles are bands of the set's size, two to each factor that sets of enough similarity can differ by, and of the first
    word's population count. A row of work holds a block and up to `mates` blocks to compare it with.
    """
    factor = 2 / -np.log(SIMILARITY**2)
    size = F.when(F.col("n") > 0, F.floor(F.log("n") * float(factor) + 1e-9) + 1).otherwise(0).cast("int")
    pop = F.floor(F.bit_count("f0") / (FIRST_RADIUS + 1)).cast("int")
    one = saved(prints.select("node", *_ROW).withColumn("tile", size * 4 + pop))
    # four for each band of sizes: some 400 rows for texts of a billion words
    tiles = saved(one.groupBy("tile").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("parts")))
    blocks = saved(
        one.join(F.broadcast(tiles), "tile")
        .withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
        .groupBy("tile", "part")
        .agg(F.collect_list(F.struct(*_PLACES)).alias("own"))
        .select("tile", "part", *[F.col(f"own.{c}").alias(c) for c in _PLACES])
    )
    # by 0 to 2 bands of sizes, and one band of population counts either way
    steps = F.array(*[F.lit(4 * s + p) for s in range(3) for p in (-1, 0, 1) if s or p >= 0])
    near = F.expr("abs(tile % 4 - other % 4) <= 1 and (tile <> other or mate >= part)")
    pairs = (
        blocks.select("tile", "part", F.explode(steps).alias("step"))
        .withColumn("other", F.col("tile") + F.col("step"))
        .join(F.broadcast(tiles.select(F.col("tile").alias("other"), "parts")), "other")
        .withColumn("mate", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .where(near)
    )
    # the mates' numbers in a row of work: their count is that of the blocks in reach of one block
    turn = Window.partitionBy("tile", "part").orderBy("other", "mate")
    pairs = pairs.select("tile", "part", "other", "mate", F.floor((F.row_number().over(turn) - 1) / mates).alias("chunk"))
    right = blocks.select(F.col("tile").alias("other"), F.col("part").alias("mate"), *_PLACES)
    # a block meets itself as an empty mate
    itself = F.expr("tile = other and part = mate")
    own = F.struct(*[F.when(itself, F.array().cast("array<long>")).otherwise(F.col(c)).alias(c) for c in _PLACES])
    work = pairs.join(right.hint("merge"), ["other", "mate"]).select("tile", "part", "chunk", own.alias("own"))
    work = work.groupBy("tile", "part", "chunk").agg(F.collect_list("own").alias("own")).select("tile", "part", *[F.col(f"own.{c}").alias(f"{c}_r") for c in _PLACES])
    work = work.join(blocks.hint("merge"), ["tile", "part"]).drop("tile", "part")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.to_dict("records"):
                nodes, a = np.asarray(row["node"], np.int64), _table([row[c] for c in _ROW])
                for k, others in enumerate(row["node_r"]):
                    itself = not len(others)
                    b = a if itself else _table([row[f"{c}_r"][k] for c in _ROW])
                    held = a if itself else np.concatenate([a, b])
                    first = np.ascontiguousarray(held[:, 0])
                    u, v = links_of_blocks(first[: len(a)], None if itself else first[len(a) :], FIRST_RADIUS, lambda x, y, held=held: _linked(held[x], held[y]))
                    if len(u):
                        both = nodes if itself else np.concatenate([nodes, np.asarray(others, np.int64)])
                        yield pd.DataFrame({"a": both[u], "b": both[v]})

    return work.mapInPandas(compare, "a long, b long")


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether the cosine of two sets (as vectors of zeros and ones) is SIMILARITY at least. Empty sets are alike."""
    if not len(a) or not len(b):
        return len(a) == len(b)
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both * both >= SIMILARITY**2 * len(a) * len(b)


def _unlike(rows: pd.DataFrame, before: pd.DataFrame | None = None) -> list[int]:
    """The places of rows, in their order, that are similar to no row of `before`; without it, to no such row before them."""
    mine, own = _table([rows[c] for c in _ROW]), [np.asarray(x, np.int64) for x in rows["own"]]
    theirs, sets = (mine, own) if before is None else (_table([before[c] for c in _ROW]), [np.asarray(x, np.int64) for x in before["own"]])
    found: list[int] = []
    for i in range(len(mine)):
        held = np.array(found, np.int64) if before is None else np.arange(len(theirs))
        few, many = np.minimum(theirs[held, 4], mine[i, 4]), np.maximum(theirs[held, 4], mine[i, 4])
        # sets of that similarity differ in 52 of 256 bits on average, with a standard deviation of 6.5: by 7 of these the test spares a count
        may = held[(few >= SIMILARITY**2 * many) & (np.bitwise_count(theirs[held, :4] ^ mine[i, :4]).sum(axis=1) <= 1.5 * LONG_RADIUS)]
        if not any(similar(own[i], sets[j]) for j in may):
            found.append(i)
    return found


_HELD = "node long, root long, low long, low_t long, f0 long, f1 long, f2 long, f3 long, n long, salts int, salt int, large boolean, own array<long>"


def leaders(groups: DataFrame, local: int = 500, most: int = 4_000_000) -> DataFrame:
    """(node): of groups, by ascending (low, low_t) in each root, the nodes whose set is similar to that of no node before that is given.

    A group that is `large` (over `local` nodes or `most` hashes) goes in rounds: its first nodes, up to those numbers, are
    thinned in one task, and those left are held against all others of the group, in `salts` tasks.
    """

    def pick(some: pd.DataFrame) -> pd.DataFrame:
        some = some.sort_values(["low", "low_t"], ignore_index=True)
        return some.iloc[_unlike(some)]

    def thin(some: pd.DataFrame, given: pd.DataFrame) -> pd.DataFrame:
        return some.iloc[_unlike(some, given)] if len(some) else some

    out = groups.where("not large").groupBy("root").applyInPandas(pick, _HELD).select("node")
    rest = saved(groups.where("large"))
    while not rest.isEmpty():
        order = Window.partitionBy("root").orderBy("low", "low_t")
        first = rest.select("node", "root", "low", "low_t", "n").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= local)
        first = saved(first.withColumn("sum", F.sum("n").over(order)).where((F.col("sum") <= most) | (F.col("rank") == 1)).select("node"))
        given = saved(rest.join(first, "node", "left_semi").groupBy("root").applyInPandas(pick, _HELD))
        out = out.unionByName(given.select("node"))
        spread = given.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
        left = rest.join(first, "node", "left_anti").groupBy("root", "salt")
        rest = saved(left.cogroup(spread.groupBy("root", "salt")).applyInPandas(thin, _HELD))
    return out


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that are near copies of a kept row of a smaller id (or of the same id and another text).

    The similarity of two texts is what SimHash estimates, the cosine, here of their sets of 5-word shingles: at least 0.8.
    Candidates are the components of linked fingerprints; in each, by ascending id, a row goes if the cosine with a row
    kept before is, held exactly, 0.8 or more. Texts of equal words are one text, as are all texts without words. Rows are
    decided one by one, so a repeated id with another text stays; of rows equal in id and text one stays. Null ids stay,
    and are compared with nothing. Ids must be whole numbers. An empty table gives no rows; extra columns are kept.
    """

    def measure(texts: pd.Series) -> pd.DataFrame:
        node, prints, n = np.zeros(len(texts), np.uint64), np.zeros((len(texts), 4), np.uint64), np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):  # the words of one text at a time
            words = words_of(text)
            own = shingle_set(words)
            node[i], prints[i], n[i] = xxhash.xxh3_64_intdigest(b" ".join(words)), long_fingerprint_of(own), len(own)
        return pd.DataFrame({"node": node.view(np.int64), **{c: prints[:, k].view(np.int64) for k, c in enumerate(_ROW[:4])}, "n": n})

    def sets(texts: pd.Series) -> pd.Series:
        return pd.Series([shingle_set(words_of(t)).view(np.int64) for t in texts], dtype=object)

    text = F.col(text_col).cast("string")
    keyed = docs.withColumns({"__tp_id": F.col(id_col).cast("long"), "__tp_t": F.coalesce(F.xxhash64(text), F.lit(0))})
    keyed = keyed.withColumn("__tp_key", F.xxhash64("__tp_id", "__tp_t"))
    kind = f"struct<node: long, {', '.join(f'{c}: long' for c in _ROW)}>"
    found = keyed.where("__tp_id is not null").select(F.col("__tp_id").alias("id"), F.col("__tp_t").alias("t"), mapped(measure, kind, text).alias("f"))
    found = saved(found.select("id", "t", "f.*"))
    nodes = found.groupBy("node").agg(F.min(F.struct("id", "t")).alias("row"), *[F.first(c).alias(c) for c in _ROW])
    nodes = saved(nodes.select("node", F.col("row.id").alias("low"), F.col("row.t").alias("low_t"), *_ROW))
    roots = saved(connected_components(long_links(nodes)))
    sizes = roots.join(nodes.select("node", "n"), "node").groupBy("root").agg(F.count("*").alias("members"), F.sum("n").alias("hashes"))
    local, most = 500, 4_000_000
    salts = F.ceil(F.greatest(F.col("members") / local, F.col("hashes") / most)).cast("int")
    held = nodes.join(roots, "node").join(sizes.select("root", salts.alias("salts"), ((F.col("members") > local) | (F.col("hashes") > most)).alias("large")), "root")
    held = saved(held.withColumn("salt", F.pmod(F.xxhash64("node"), F.col("salts")).cast("int")))
    # texts of groups alone go through the exchange
    key = F.xxhash64(F.col("low"), F.col("low_t")).alias("key")
    texts = keyed.where(mapped(may_be_in(held.select(key)), "boolean", F.col("__tp_key"))).select(F.col("__tp_id").alias("low"), F.col("__tp_t").alias("low_t"), text.alias("text"))
    texts = texts.join(held.hint("merge"), ["low", "low_t"]).dropDuplicates(["low", "low_t"])
    columns = ["node", "root", "low", "low_t", *_ROW, "salts", "salt", "large"]
    own = saved(texts.select(*columns, mapped(sets, "array<long>", F.col("text")).alias("own")))
    gone = held.select("node").join(saved(leaders(own, local, most)), "node", "left_anti").withColumn("gone", F.lit(True))
    rows = found.groupBy("id", "t", "node").agg(F.count("*").alias("rows")).join(nodes.select("node", "low", "low_t"), "node").join(gone, "node", "left")
    rows = rows.select(F.col("id").alias("__tp_id"), F.col("t").alias("__tp_t"), F.expr("gone is null and id = low and t = low_t").alias("__tp_one"), "rows")
    # rows without a decision stay, whether the bitmap spares them the exchange or not
    decided = saved(rows.where("not __tp_one or rows > 1").drop("rows"))
    may = mapped(may_be_in(decided.select(F.xxhash64("__tp_id", "__tp_t").alias("key"))), "boolean", F.col("__tp_key"))
    met = keyed.where(may).join(decided.hint("merge"), ["__tp_id", "__tp_t"], "left")
    kept = keyed.where(~may).select(*docs.columns)
    kept = kept.unionByName(met.where("__tp_one is null").select(*docs.columns))
    return kept.unionByName(met.where("__tp_one").dropDuplicates(["__tp_id", "__tp_t"]).select(*docs.columns))
