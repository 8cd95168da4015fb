"""Distributed k-means with parallel oversampled seeding, all models of a table at once.

Rows are ``(model, rep, vec)``. Vectors of any length become hashed weighted features: component ``i`` of the unit
vector goes to bucket ``hash(i) mod width`` with a hashed sign, weighted by the model's inverse spread of that
component. Seeding takes a few passes that draw rows in proportion to their distance from what is drawn already, and
clusters the few hundred drawn, weighted, on the driver. Each pass ships at most ``max_k`` centroids per model and
gathers sums of the same size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.common import materialize
from rasterloom.llm.vectors import matrix, one_thread, units

FEATURES = 128


def hashed(x: np.ndarray, weight: np.ndarray, width: int = FEATURES) -> np.ndarray:
    """Hashed weighted features of unit rows ``x``: unit float32 rows of ``width`` columns."""
    i = np.arange(x.shape[1], dtype=np.uint64)
    h = (i + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    bucket, sign = ((h >> np.uint64(33)) % np.uint64(width)).astype(np.int64), np.where((h >> np.uint64(20)) & np.uint64(1), 1.0, -1.0)
    fold = np.zeros((x.shape[1], width))
    fold[np.arange(x.shape[1]), bucket] = sign * weight
    out = x.astype(np.float64) @ fold
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return (out / np.where(norm > 0, norm, 1)).astype(np.float32)


def component_weights(reps: DataFrame) -> dict[str, np.ndarray]:
    """By model, one weight per component: the inverse of its spread over all unit vectors, 1 on average, at most 4."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            for model, at in b.groupby("model").indices.items():
                x = units(matrix(b["vec"].iloc[at])).astype(np.float64)
                part = np.concatenate([[len(x)], x.sum(0), (x * x).sum(0)])
                sums[model] = sums[model] + part if model in sums else part
        if sums:
            yield pd.DataFrame({"model": list(sums), "part": list(sums.values())})

    rows = reps.select("model", "vec").mapInPandas(run, "model string, part array<double>")
    total = rows.select("model", F.posexplode("part")).groupBy("model", "pos").agg(F.sum("col").alias("s")).groupBy("model").agg(F.array_sort(F.collect_list(F.struct("pos", "s"))).alias("s"))
    out = {}
    for model, s in total.collect():  # a few numbers per component of each model
        v = np.array([x[1] for x in s])
        n, d = v[0], len(v) // 2
        spread = np.sqrt(np.maximum(v[1 + d :] / n - (v[1 : 1 + d] / n) ** 2, 1e-12))
        w = 1 / spread
        out[model] = np.minimum(w / w.mean(), 4.0)
    return out


def _striped(f: np.ndarray, c: np.ndarray, rows: int = 1024) -> Iterator[tuple[slice, np.ndarray]]:
    """Cosines of ``rows`` rows of ``f`` at a time to all of ``c``: never a matrix of both sides' size."""
    one_thread()
    for a in range(0, len(f), rows):
        e = slice(a, a + rows)
        yield e, f[e] @ c.T


def _nearest(f: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest row of ``c`` to each of ``f``, and its cosine."""
    at, best = np.zeros(len(f), np.int64), np.zeros(len(f), np.float32)
    for e, s in _striped(f, c):
        at[e] = s.argmax(1)
        best[e] = s[np.arange(len(s)), at[e]]
    return at, best


class KMeans:
    """``centroids``: by model, unit rows in feature space; ``sizes``: by model, the rows they were fitted on."""

    sizes: dict[str, int] = {}

    def __init__(self, weights: dict[str, np.ndarray], centroids: dict[str, np.ndarray]) -> None:
        self.weights, self.centroids = weights, centroids

    def features(self, model: str, vectors: pd.Series) -> np.ndarray:
        return hashed(units(matrix(vectors)), self.weights[model])

    @classmethod
    def fit(cls, reps: DataFrame, per_cluster: int = 256, max_k: int = 4096, rounds: int = 2, steps: int = 2, seed: int = 11, sample: int | None = None) -> KMeans:
        """k is one per ``per_cluster`` rows of the model, ``max_k`` at most; ``rounds`` of seeding draw some k rows
        each, ``steps`` of Lloyd follow, on about ``sample`` rows per centroid if that is given. The same table gives the
        same centroids, however it is partitioned, up to the order of float sums."""
        place = F.xxhash64("rep", F.lit(seed))
        first = reps.groupBy("model").agg(F.count("*").alias("n"), F.min_by("vec", place).alias("vec"), F.min(place).alias("least")).collect()  # a row per model
        sizes = {r["model"]: r["n"] for r in first}
        k = {m: int(min(max_k, max(1, -(-n // per_cluster)))) for m, n in sizes.items()}
        fitted = {m: min(n, sample * k[m]) if sample else n for m, n in sizes.items()}
        if fitted != sizes:
            most = (1 << 63) - 1
            draw = [(r["model"], max(r["least"], min(most, int(2.0**64 * fitted[r["model"]] / r["n"]) - most))) for r in first]
            draw = F.broadcast(reps.sparkSession.createDataFrame(draw, "model string, below bigint"))  # a row per model
            reps = materialize(reps.join(draw, "model").filter(place <= F.col("below")).select("model", "rep", "vec"), "sample")
        weights = component_weights(reps)
        me = cls(weights, {r["model"]: hashed(units(np.array([r["vec"]], np.float32)), weights[r["model"]]) for r in first})
        me.sizes = sizes
        cost = {m: float(n) for m, n in fitted.items()}
        for i in range(rounds):
            cost = me._draw(reps, k, cost, 1.5 * (i + 1), seed + i)
        for model, (c, w) in me._weigh(reps).items():
            me.centroids[model] = _recluster(c, w, k[model], seed)
        for _ in range(steps):
            for model, (c, w, s) in me._sums(reps).items():
                s = np.where(w[:, None] > 0, s, c)
                me.centroids[model] = (s / np.linalg.norm(s, axis=1, keepdims=True)).astype(np.float32)
        return me

    def _draw(self, reps: DataFrame, k: dict[str, int], cost: dict[str, float], often: float, seed: int) -> dict[str, float]:
        """One round of oversampling: a row is drawn with probability ``often`` * k * its cost / ``cost``, by a hash of
        its id. ``cost`` is the total a round ago, no less than the present one, which the same pass returns; so at
        most ``often`` * k rows of a model are expected."""
        ship = reps.sparkSession.sparkContext.broadcast((self, k, cost))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            me, k, cost = ship.value
            total: dict[str, float] = {}
            for b in batches:
                for model, at in b.groupby("model").indices.items():
                    f = me.features(model, b["vec"].iloc[at])
                    c = 1 - _nearest(f, me.centroids[model])[1]
                    total[model] = total.get(model, 0.0) + float(c.sum())
                    f = f[_uniform(b["rep"].to_numpy()[at], seed) * max(cost[model], 1e-9) < often * k[model] * c]
                    if len(f):
                        yield pd.DataFrame({"model": model, "f": list(f), "cost": 0.0})
            if total:
                yield pd.DataFrame({"model": list(total), "f": None, "cost": list(total.values())})

        got = reps.select("model", "rep", "vec").mapInPandas(run, "model string, f array<float>, cost double").collect()
        for model in self.centroids:
            mine = [r["f"] for r in got if r["model"] == model and r["f"] is not None]
            if mine:
                both = np.concatenate([self.centroids[model], np.array(sorted(mine), np.float32)])
                self.centroids[model] = both[np.sort(np.unique(both, axis=0, return_index=True)[1])]
        return {m: sum(r["cost"] for r in got if r["model"] == m) for m in self.centroids}

    def _partial(self, reps: DataFrame) -> DataFrame:
        """Per model and centroid the count and the sum of the rows nearest to it, summed in each task first."""
        ship = reps.sparkSession.sparkContext.broadcast(self)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            sums: dict[str, np.ndarray] = {}
            for b in batches:
                for model, at in b.groupby("model").indices.items():
                    f, c = ship.value.features(model, b["vec"].iloc[at]), ship.value.centroids[model]
                    near = _nearest(f, c)[0]
                    if model not in sums:
                        sums[model] = np.zeros((len(c), f.shape[1] + 1))
                    order = np.argsort(near, kind="stable")
                    first = np.flatnonzero(np.r_[True, np.diff(near[order]) > 0])
                    sums[model][near[order][first], 1:] += np.add.reduceat(f[order].astype(np.float64), first)
                    sums[model][:, 0] += np.bincount(near, minlength=len(c))
            for model, s in sums.items():
                at = np.flatnonzero(s[:, 0])
                yield pd.DataFrame({"model": model, "c": at.astype(np.int32), "part": [r.tobytes() for r in s[at]]})

        def add(b: pd.DataFrame) -> pd.DataFrame:
            total = np.sum([np.frombuffer(p) for p in b["part"]], axis=0)
            return pd.DataFrame({"model": b["model"].iloc[:1], "c": b["c"].iloc[:1], "part": [total.tobytes()]})

        # One row per task and centroid at most.
        return reps.select("model", "vec").mapInPandas(run, "model string, c int, part binary").groupBy("model", "c").applyInPandas(add, "model string, c int, part binary")

    def _sums(self, reps: DataFrame) -> dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        out = {m: (c, np.zeros(len(c)), np.zeros(c.shape)) for m, c in self.centroids.items()}
        for model, c, part in self._partial(reps).collect():  # as large as the centroids
            v = np.frombuffer(part)
            out[model][1][c], out[model][2][c] = v[0], v[1:]
        return out

    def _weigh(self, reps: DataFrame) -> dict[str, tuple[np.ndarray, np.ndarray]]:
        return {m: (c, w) for m, (c, w, _) in self._sums(reps).items()}

    def assign(self, reps: DataFrame, n: int = 1, margin: float = 0.0) -> DataFrame:
        """``reps`` with ``cells array<int>``, the nearest centroid and up to ``n`` - 1 more within ``margin`` of its
        cosine, nearest first, and ``near``, the cosine in feature space to the first."""
        ship = reps.sparkSession.sparkContext.broadcast(self)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                cells, near = np.empty(len(b), object), np.zeros(len(b))
                for model, at in b.groupby("model").indices.items():
                    f, c = ship.value.features(model, b["vec"].iloc[at]), ship.value.centroids[model]
                    for e, s in _striped(f, c, 256):
                        best = s.max(1)
                        i, top = np.divmod(np.flatnonzero(s >= (best - np.float32(margin))[:, None]), len(c))
                        order = np.lexsort((top, -s[i, top], i))
                        i, top = i[order], top[order].astype(np.int32)
                        first = np.searchsorted(i, np.arange(len(s) + 1))
                        near[at[e]] = best
                        for j, a, z in zip(at[e], first, first[1:]):
                            cells[j] = top[a : min(z, a + n)]
                yield b.assign(cells=cells, near=near)

        return reps.select("model", "rep", "vec").mapInPandas(run, "model string, rep bigint, vec array<float>, cells array<int>, near double")


def _uniform(ids: np.ndarray, seed: int) -> np.ndarray:
    z = (ids.astype(np.uint64) + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((z ^ (z >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) / (1 << 53)


def _recluster(c: np.ndarray, w: np.ndarray, k: int, seed: int) -> np.ndarray:
    """At most ``k`` of the drawn rows as centroids: weighted k-means++ and a few weighted steps."""
    if len(c) <= k:
        return c
    rng = np.random.default_rng(seed)
    w = np.maximum(w, 1e-3)
    chosen = [int(np.argmax(w))]
    cost = 1 - c @ c[chosen[0]]
    for _ in range(k - 1):
        p = np.maximum(cost, 0) * w
        if p.sum() <= 0:
            break
        chosen.append(int(rng.choice(len(c), p=p / p.sum())))
        cost = np.minimum(cost, 1 - c @ c[chosen[-1]])
    out = c[chosen].astype(np.float64)
    for _ in range(5):
        near = _nearest(c, out.astype(np.float32))[0]
        s = np.zeros_like(out)
        np.add.at(s, near, c * w[:, None])
        norm = np.linalg.norm(s, axis=1, keepdims=True)
        out = np.where(norm > 1e-12, s / np.maximum(norm, 1e-12), out)
    return out.astype(np.float32)
