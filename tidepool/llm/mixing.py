"""Mixing to target weights by soft membership, in DataFrame operations alone.

A multinomial logistic classifier over hashed words and levels of the text's surface (repetition, variety, length,
capitals, symbols), learned from a labelled table, gives each document a posterior for every domain; features count
whose share in a domain differs from that in the others by more than chance, present or absent. Projected gradient descent on least squares then finds nonnegative document rates whose expected tokens by
domain match the targets: rate <- max(0, rate - step x sum over domains of residual x posterior). Documents with the
same posterior (rounded to `grid` steps) have the same rate, so after one distributed sum the rounds run over a table of
such cells; their number is bounded by the grid (some 20,301 for three domains and 200 steps), whatever the input.
"""

from __future__ import annotations

import math
import warnings

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepool.llm.base import bounded_sample, saved


#: Levels of each surface feature: a halving of a share each (of variety, capitals and symbols half of one), or a doubling of the length.
LEVELS, SURFACES = 32, 5


def features(rows: DataFrame, text: Column, buckets: int) -> DataFrame:
    """rows with `n_tokens`, the number of the text's words (A-Z lower-cased; runs of letters and digits, and of all beyond
    ASCII), and `b`, their distinct buckets and those of the surface. Null texts have none of both."""
    text = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(F.lower(text), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != "")
    rows = rows.withColumn("__h", F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(buckets)).cast("int")))
    rows = rows.withColumn("__d", F.array_distinct("__h")).withColumn("n_tokens", F.size("__h").cast("long"))
    n, chars = F.greatest(F.col("n_tokens"), F.lit(1)), F.greatest(F.length(text), F.lit(1))
    again = F.size(F.filter("__h", lambda x, i: x == F.get(F.col("__h"), i + 1)))
    levels = [
        -F.log2(again / n), -2 * F.log2(F.size("__d") / n), F.log2(n),
        -2 * F.log2(F.regexp_count(text, F.lit("[A-Z]")) / chars), -2 * F.log2(F.regexp_count(text, F.lit(r"[!#-&*+/<-@\[-`{-~]")) / chars),
    ]
    # the logarithm of 0 is null: the last level
    surface = [F.lit(buckets + LEVELS * i) + F.least(F.coalesce(F.floor(x), F.lit(LEVELS - 1)), F.lit(LEVELS - 1)).cast("int") for i, x in enumerate(levels)]
    found = F.when(F.col("n_tokens") > 0, F.concat("__d", F.array(*surface))).otherwise(F.array().cast("array<int>"))
    return rows.withColumn("b", found).drop("__h", "__d")


def _numbers(values: list) -> Column:
    """A constant array; as one literal, not thousands."""
    return F.split(F.lit(",".join(f"{v:.5g}" if v else "0" for v in values)), ",").cast("array<double>")


def _summed(found: Column, start: float, weights: Column) -> Column:
    return F.aggregate(found, F.lit(float(start)), lambda acc, b: acc + F.get(weights, b))


class Domains:
    """For every domain its log odds without any feature, and what each bucket adds (a row for each bucket)."""

    def __init__(self, names: list[str], start: list[float], weights: np.ndarray):
        self.names, self.start, self.weights = names, start, weights

    def posterior(self, found: Column) -> Column:
        """Posteriors in the order of names, from an array of buckets."""
        known = F.filter(found, lambda b: F.get(_numbers(np.abs(self.weights).sum(axis=1) > 0), b) > 0)

        def scores(own: Column) -> Column:
            return F.array(*[_summed(own, start, _numbers(self.weights[:, i].tolist())) for i, start in enumerate(self.start)])

        # a lambda's variable holds each step's value, so nothing is computed twice
        s = F.transform(F.transform(F.array(known), scores), lambda s: F.transform(s, lambda x: F.exp(x - F.array_max(s))))
        return F.transform(s, lambda y: F.transform(y, lambda x: x / F.aggregate(y, F.lit(0.0), lambda a, b: a + b)))[0]


def logistic(rows: list[np.ndarray], y: np.ndarray, size: int, classes: int, l2: float = 1e-4, steps: int = 400, rate: float = 0.3) -> tuple[np.ndarray, np.ndarray]:
    """Weights and biases by gradient descent with momentum on the mean logistic loss and an L2 penalty. rows: places of ones."""
    at = np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.int64)
    row, n = np.repeat(np.arange(len(rows)), [len(r) for r in rows]), max(1, len(rows))
    w, b = np.zeros((size, classes)), np.zeros(classes)
    speed, lift = np.zeros_like(w), np.zeros_like(b)
    truth = np.eye(classes)[y]
    for _ in range(steps):
        score = np.stack([np.bincount(row, weights=w[at, c], minlength=len(rows)) for c in range(classes)], axis=1) + b
        p = np.exp(score - score.max(axis=1, keepdims=True))
        off = (p / p.sum(axis=1, keepdims=True) - truth) / n
        speed = 0.9 * speed + np.stack([np.bincount(at, weights=off[row, c], minlength=size) for c in range(classes)], axis=1) + l2 * w
        lift = 0.9 * lift + off.sum(axis=0)
        w, b = w - rate * speed, b - rate * lift
    return w, b


def learn(docs: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", domain_col: str = "domain", per_domain: int = 2000, buckets: int = 1 << 15, chance: float = 4.0, most_domains: int = 100) -> Domains:
    """The classifier from about per_domain labelled documents of each domain. Biases allow for how many more of docs are labelled.

    chance: by how many standard errors a feature's share of a domain's documents must differ from that in the others to
    count. Equal texts of a domain count once. More than most_domains domains are an error.
    """
    known = labelled.select(F.col(id_col).alias("id"), F.col(domain_col).cast("string").alias("domain")).where("id is not null and domain is not null").distinct()
    known = saved(known.join(docs.select(F.col(id_col).alias("id")), "id", "left_semi"))
    sizes = {r[0]: r[1] for r in known.groupBy("domain").count().limit(most_domains + 1).collect()}
    if len(sizes) > most_domains:
        raise ValueError(f"more than {most_domains} domains")
    names, size = sorted(sizes, key=lambda x: (-sizes[x], x)), buckets + LEVELS * SURFACES
    if not names:
        return Domains(["all"], [0.0], np.zeros((size, 1)))
    sample = bounded_sample(known, F.col("id"), "domain", per_domain, "id")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(saved(sample)), "id")
    rows = saved(features(rows.dropDuplicates(["domain", "text"]), F.col("text"), buckets).select("domain", "b"))
    counts, n = np.zeros((size, len(names))), np.zeros(len(names))
    for r in rows.select("domain", F.explode(F.concat(F.array(F.lit(-1)), "b")).alias("b")).groupBy("domain", "b").count().collect():  # buckets x domains; -1 counts documents
        if r["b"] < 0:
            n[names.index(r["domain"])] = r["count"]
        else:
            counts[r["b"], names.index(r["domain"])] = r["count"]
    if not n.sum():
        return Domains(names, [math.log(sizes[x]) for x in names], np.zeros((size, len(names))))
    here, there = np.maximum(n, 1), np.maximum(n.sum() - n, 1)
    share = counts.sum(axis=1, keepdims=True) / n.sum()
    error = np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / here + 1 / there))
    differs = (np.abs(counts / here - (counts.sum(axis=1, keepdims=True) - counts) / there) > chance * error) & (n > 0)
    chosen = np.flatnonzero(differs.any(axis=1))
    place = _numbers((np.isin(np.arange(size), chosen)).astype(int).tolist())
    found = sorted((names.index(r["domain"]), r["b"]) for r in rows.select("domain", F.sort_array(F.filter("b", lambda b: F.get(place, b) > 0)).alias("b")).collect())  # some per_domain rows a domain
    w, start = logistic([np.searchsorted(chosen, b) for _, b in found], np.array([y for y, _ in found]), len(chosen), len(names))
    weights = np.zeros((size, len(names)))
    weights[chosen] = w
    more = np.log([sizes[x] for x in names]) - np.log(np.maximum(n, 0.5))
    return Domains(names, (start + more - more.max()).tolist(), weights)


def fitted_rates(at: np.ndarray, tokens: np.ndarray, goal: np.ndarray, rounds: int, tolerance: float, most: float = math.inf) -> tuple[np.ndarray, np.ndarray]:
    """(rates of the cells, relative residuals of the domains) by accelerated projected gradient from rates of 1, held within 0 and most.

    at: a row of posteriors for each cell; tokens: of its documents. The residual of a domain is over its goal, or over its
    present tokens where that is 0. The rounds end when all are below tolerance.
    """
    size = np.maximum(np.where(goal > 0, goal, at.T @ tokens), 1.0)
    own = at / size
    step = 1.0 / max(np.linalg.eigvalsh(own.T @ (own * tokens[:, None])).max(), 1e-12)
    rate, ahead, pace = np.ones(len(at)), np.ones(len(at)), 1.0
    off = own.T @ (tokens * rate) - goal / size
    for _ in range(rounds):
        if np.abs(off).max() < tolerance:
            break
        new = np.clip(ahead - step * (own @ (own.T @ (tokens * ahead) - goal / size)), 0.0, most)
        if (ahead - new) @ (tokens * (new - rate)) > 0:  # past the valley: start to gather speed anew
            pace = 1.0
        faster = (1 + math.sqrt(1 + 4 * pace * pace)) / 2
        ahead, rate, pace = new + (pace - 1) / faster * (new - rate), new, faster
        off = own.T @ (tokens * rate) - goal / size
    return rate, off


def mixed_rates(
    docs: DataFrame, labelled: DataFrame, targets: dict[str, float], id_col: str = "doc_id", text_col: str = "text", domain_col: str = "domain",
    keep: str | None = None, total: float | None = None, most: float = 4.0, per_domain: int = 2000, buckets: int = 1 << 15, grid: int = 200, rounds: int = 20_000, tolerance: float = 2e-3, most_cells: int = 200_000, with_rows: bool = False,
) -> DataFrame:
    """(doc_id, n_tokens, posterior (map of domain to share), rate, copies) for every row of docs; with_rows: and `row`, a struct of docs' columns.

    targets: the weight of each domain (domains without one get 0; those that no document is labelled with are left out;
    weights are normalised). total: expected tokens after mixing;
    by default as many as keep the domain `keep` (the one of most weight) at its present expected tokens. copies is the
    rate's whole part, and one more for as large a share of the documents as its fraction, drawn by a hash of id and text;
    so equal rows get equal copies. Null texts have no tokens, and what is known without any feature as posterior. Null ids stay; an empty table
    gives no rows; without labelled documents all belong to one domain and keep rate 1. Other columns are dropped.
    The rounds end when every domain's expected tokens are within `tolerance` of its goal (of its present tokens, for a
    goal of 0). No rate is above `most`, as more repeats of a text teach little; a domain too small for its target then
    stays below it. Where the goals are not met, a warning gives the residuals.
    With many domains the grid is coarser, so that it has most_cells at most.
    """
    model = learn(docs, labelled, id_col, text_col, domain_col, per_domain, buckets)
    names = model.names
    text = F.col(text_col).cast("string")
    row = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if with_rows else []
    rows = docs.select(F.col(id_col).alias("doc_id"), *row, F.xxhash64(text).alias("t"), text.alias("x"))
    rows = features(rows, F.col("x"), buckets).withColumn("p", model.posterior(F.col("b"))).drop("x", "b")
    while grid > 1 and math.comb(grid + len(names) - 1, grid) > most_cells:
        grid -= 1
    rows = saved(rows.withColumn("p", F.transform("p", lambda x: F.round(x * grid) / grid)))
    cells = rows.groupBy("p").agg(F.sum("n_tokens").alias("n")).collect()  # bounded by the grid
    at, tokens = np.array([r["p"] for r in cells], float).reshape(-1, len(names)), np.array([r["n"] for r in cells], float)
    rates, now = np.ones(len(at)), at.T @ tokens
    weight = np.array([max(0.0, targets.get(x, 0.0)) for x in names])
    if weight.sum() > 0 and now.sum() > 0:
        weight /= weight.sum()
        held = names.index(keep) if keep in names else int(weight.argmax())
        rates, off = fitted_rates(at, tokens, weight * (total if total is not None else now[held] / weight[held]), rounds, tolerance, most)
        if np.abs(off).max() >= tolerance:
            warnings.warn(f"mixing: off the goals by {dict(zip(names, off.round(4).tolist()))}", stacklevel=2)
    known = docs.sparkSession.createDataFrame([(r["p"], float(x)) for r, x in zip(cells, rates)], "p array<double>, rate double")
    out = rows.join(F.broadcast(known), "p").withColumn("draw", F.pmod(F.xxhash64("doc_id", "t", F.lit("copies")), F.lit(1 << 30)) / float(1 << 30))
    copies = F.floor("rate") + (F.col("draw") < F.col("rate") - F.floor("rate")).cast("long")
    posterior = F.map_from_arrays(F.array(*[F.lit(x) for x in names]), F.col("p"))
    return out.select("doc_id", *["row"][: len(row)], "n_tokens", posterior.alias("posterior"), "rate", copies.cast("long").alias("copies"))
