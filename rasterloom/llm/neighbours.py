"""The most similar vectors for every vector: an HNSW graph per shard, shard results merged.

A model is split by pivots fitted on a bounded sample: a vector lives in the shards of its nearest pivot (split again by
hash where a pivot draws too many) and is searched for in those of its ``probes`` nearest pivots. A shard is one file of
the shared folder: ids, vectors, flat neighbour arrays, tight groups and what it answers to its own vectors. One task per
shard then reads the shards that its vectors are to be searched in, one at a time, and merges what they answer, so neither
vectors nor graphs are shuffled again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rasterloom.common import located, materialize, scratch
from rasterloom.llm.hnsw import TOP, Hnsw
from rasterloom.llm.vectors import collapse, matrix, one_thread, units, usable

SHARDS = "shard string, dim int, ids binary, firsts binary, vectors binary, links binary, labels binary, homes binary, near binary, sims binary"
NEAREST = "model string, result_id bigint, rank int, other_id bigint, sim double"
NONE = np.iinfo(np.int64).min
MAX_PIVOTS, ROWS_PER_PIVOT = 4096, 32


def fit_pivots(reps: DataFrame, shard_rows: int, seed: int = 7) -> dict[str, np.ndarray]:
    """Unit pivots by model, for models of more than ``shard_rows`` vectors: one per ``shard_rows`` vectors,
    ``MAX_PIVOTS`` at most (then a pivot's vectors are hashed into more parts, all of which are searched).

    Fitted on about ``ROWS_PER_PIVOT`` rows of each pivot, drawn for each model by itself (k-means by cosine, five
    rounds); every vector is indexed. The driver holds that sample, which the two bounds limit, and one count per model.
    """
    sizes = {r["model"]: r["n"] for r in reps.groupBy("model").agg(F.count("*").alias("n")).filter(F.col("n") > shard_rows).collect()}
    if not sizes:
        return {}
    spark = reps.sparkSession
    k = {m: min(-(-n // shard_rows), MAX_PIVOTS) for m, n in sizes.items()}
    most = 1 << 30
    draw = spark.createDataFrame([(m, min(most, 1 + int(most * ROWS_PER_PIVOT * k[m] / n))) for m, n in sizes.items()], "model string, below bigint")
    place = F.pmod(F.xxhash64("rep", F.lit(seed)), F.lit(most))
    large = reps.join(F.broadcast(draw), "model")  # a row per model
    sample = large.filter(place < F.col("below")).select("model", "vec").toPandas()
    # However few rows a model draws, it has one pivot at least.
    first = {r["model"]: r["vec"] for r in large.groupBy("model").agg(F.min_by("vec", place).alias("vec")).collect()}
    out = {}
    for model in sizes:
        drawn = sample.loc[sample.model == model, "vec"]
        x = units(matrix(drawn)) if len(drawn) else units(np.array([first[model]], np.float32))
        c = x[np.random.default_rng(seed).permutation(len(x))[: k[model]]]
        for _ in range(5):
            near = np.concatenate([(x[a : a + 1024] @ c.T).argmax(1) for a in range(0, len(x), 1024)])
            sums = np.zeros_like(c)
            np.add.at(sums, near, x)
            c = units(np.where(np.linalg.norm(sums, axis=1, keepdims=True) > 0, sums, c))
        out[model] = c
    return out


def routed(reps: DataFrame, pivots: dict[str, np.ndarray], probes: int) -> DataFrame:
    """``reps`` with ``homes array<int>``: the nearest pivots, nearest first (``[0]`` for models of one shard)."""
    if not pivots:
        return reps.withColumn("homes", F.array(F.lit(0)))
    ship = reps.sparkSession.sparkContext.broadcast(pivots)  # at most MAX_PIVOTS per model

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        one_thread()
        for b in batches:
            homes = np.empty(len(b), object)
            for model, at in b.groupby("model").indices.items():
                c = ship.value.get(model)
                for s in range(0, len(at), 1024):
                    some = at[s : s + 1024]
                    if c is None:
                        near = np.zeros((len(some), 1), np.int32)
                    else:
                        near = np.argsort(-(units(matrix(b["vec"].iloc[some])) @ c.T), axis=1)[:, :probes].astype(np.int32)
                    for i, row in zip(some, near):
                        homes[i] = row
            yield b.assign(homes=homes)

    return reps.mapInPandas(run, "model string, rep bigint, firsts array<bigint>, vec array<float>, homes array<int>")


def _mix(ids: np.ndarray) -> np.ndarray:
    z = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (z ^ (z >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)


def _answers(g: Hnsw, ids: np.ndarray, x: np.ndarray, q: np.ndarray, own: np.ndarray, k: int, ef: int, rerank: tuple[float, int] | None = None, groups: tuple[np.ndarray, int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Ids and similarities (-inf: none), ``k`` columns each: the ``k`` nearest of a shard to each query but itself, ranked in double precision, ties to the
    smaller id. ``rerank``: the queries are the shard's own nodes, in order; see :meth:`Hnsw.reranked`.
    ``groups``: the queries are others, the shard's nodes have these labels; see :meth:`Hnsw.reached`."""
    u = units(q)
    # Some more than k: single precision leaves near ties open.
    near, sims = g.near if rerank and g.links else g.search(u, k + 5, ef, own)
    if rerank:
        near, _ = g.reranked(near, sims, rerank[0], block_rows=rerank[1])
    if groups:
        near, _ = g.reached(u, near, sims, *groups)
    row, col = np.nonzero((near >= 0) & (near != own[:, None]))
    hit = near[row, col]
    length = lambda v: np.sqrt(np.einsum("ij,ij->i", v, v, dtype=np.float64))
    sim, ql, xl = np.empty(len(row)), length(q), length(x)
    for s in range(0, len(row), 65_536):
        e = slice(s, s + 65_536)
        sim[e] = np.einsum("ij,ij->i", q[row[e]].astype(np.float64), x[hit[e]].astype(np.float64)) / (ql[row[e]] * xl[hit[e]])
    return _lists(len(q), row, ids[hit], sim, k)


def _lists(n: int, row: np.ndarray, ids: np.ndarray, sim: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of hits ``row, ids, sim`` the best ``k`` of each of ``n`` rows as matrices, ties to the smaller id."""
    order = np.lexsort((ids, -sim, row))
    row, ids, sim = row[order], ids[order], sim[order]
    first = np.searchsorted(row, np.arange(n))
    rank = np.arange(len(row)) - first[row]
    keep = rank < k
    near, sims = np.full((n, k), -1, np.int64), np.full((n, k), -np.inf)
    near[row[keep], rank[keep]], sims[row[keep], rank[keep]] = ids[keep], sim[keep]
    return near, sims


def _merged(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
    """The best ``k`` of two lists of matrices over the same rows; the two have no id in common."""
    near, sims = np.concatenate([a[0], b[0]], 1), np.concatenate([a[1], b[1]], 1)
    row, col = np.nonzero(sims > -np.inf)
    return _lists(len(near), row, near[row, col], sims[row, col], k)


def shard_name(model: Column, pivot: Column, part: Column) -> Column:
    """A name that is safe in a path: the model's hash, the pivot and the part."""
    return F.concat_ws("-", F.hex(F.xxhash64(model)), pivot.cast("string"), part.cast("string"))


def build_shards(routed_reps: DataFrame, path: str, shard_rows: int, k: int, ef: int = 32, m: int = 12, tight: float = 0.8, group_rows: int = 8192, top: int = TOP) -> list[tuple]:
    """A graph per shard, stored below ``path`` in a folder of its own together with what it answers to its own vectors
    (the ``k`` nearest others). A pivot's vectors are hashed into parts of about ``shard_rows``.

    Returns ``(shard, model, pivot, part)`` of every shard: some rows per pivot, no more than the driver plans tasks for.
    """
    home = F.element_at("homes", 1)
    parts = routed_reps.groupBy("model", home.alias("pivot")).agg(F.ceil(F.count("*") / shard_rows).cast("int").alias("parts"))
    sizes = [tuple(r) for r in parts.collect()]
    shards_of: dict[str, int] = {}
    for model, _, n in sizes:
        shards_of[model] = shards_of.get(model, 0) + n
    told = [(m, p, n, shards_of[m] == 1) for m, p, n in sizes]
    parts = F.broadcast(routed_reps.sparkSession.createDataFrame(told, "model string, pivot int, parts int, alone boolean"))  # a row per pivot
    rows = routed_reps.withColumn("pivot", home).join(parts, ["model", "pivot"])
    name = shard_name(F.col("model"), F.col("pivot"), F.pmod(F.xxhash64("rep"), F.col("parts")))
    names = [c.split()[0] for c in SHARDS.split(", ")]
    width = k + 1

    def run(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
        one_thread()
        b = b.iloc[np.argsort(_mix(b["rep"].to_numpy()), kind="stable")]  # an order without meaning, the same each time
        x, ids = matrix(b["vec"]), b["rep"].to_numpy()
        g = Hnsw.build(units(x), ef, top, m, k + 5)
        near, sims = _answers(g, ids, x, x, np.arange(len(b), dtype=np.int32), k, ef, (tight, group_rows))
        labels = g.tight_groups(tight) if g.links else np.arange(len(x))
        homes = np.stack(b["homes"].to_numpy()).astype("<i4")
        alone = bool(b["alone"].iloc[0])  # no other shard is to be asked, none asks
        firsts = np.full((len(b), width), NONE, "<i8")
        for i, f in enumerate(b["firsts"]):
            firsts[i, : len(f)] = f
        row = (key[0], x.shape[1], ids.astype("<i8").tobytes(), firsts.tobytes(), None if alone else x.tobytes(), None if alone else g.pack(), None if alone else labels.astype("<i4").tobytes(), homes.tobytes(), near.astype("<i8").tobytes(), sims.astype("<f8").tobytes())
        return pd.DataFrame([row], columns=names)

    # A number of tasks that follows the shards: their bytes say little about their work, so they must not be merged by size.
    n = min(10_000, max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2 * sum(p for _, _, p in sizes)))
    rows = rows.select(name.alias("shard"), "alone", "rep", "firsts", "vec", "homes").repartition(n, "shard")
    rows.groupBy("shard").applyInPandas(run, SHARDS).write.partitionBy("shard").parquet(path)
    made = rows.sparkSession.createDataFrame([(m, p, i) for m, p, n in sizes for i in range(n)], "model string, pivot int, part int")
    return [tuple(r) for r in made.select(shard_name(F.col("model"), F.col("pivot"), F.col("part")), "model", "pivot", "part").collect()]


class _Store:
    """Shards as they lie below a folder of the shared storage."""

    def __init__(self, path: str) -> None:
        self.fs, self.folder = located(path)

    def get(self, shard: str, *columns: str) -> dict | None:
        """The columns of a shard; None if it has no vector."""
        import pyarrow.dataset as ds
        from pyarrow import fs as pafs

        where = f"{self.folder}/shard={shard}"
        if self.fs.get_file_info(where).type == pafs.FileType.NotFound:
            return None
        rows = ds.dataset(where, filesystem=self.fs, format="parquet").to_table(columns=list(columns)).to_pylist()
        return rows[0] if rows else None


def _expanded(ids: np.ndarray, firsts: np.ndarray, near: np.ndarray, sims: np.ndarray, known: tuple[np.ndarray, np.ndarray], k: int) -> pd.DataFrame:
    """``result_id, rank, other_id, sim`` of the results whose vectors are rows ``ids``, of up to ``k`` results each.

    ``firsts``: the smallest ``k`` + 1 results of each row's vector; ``known``: ids and firsts of the vectors in ``near``.
    Results of one vector are nearest to each other, then come those of the near vectors.
    """
    row, col = np.nonzero(sims > -np.inf)
    order = np.argsort(known[0])
    at = order[np.searchsorted(known[0][order], near[row, col])] if len(row) else np.zeros(0, np.int64)
    r, c = np.nonzero(known[1][at] != NONE)
    others, far = _lists(len(ids), row[r], known[1][at][r, c], sims[row, col][r], k)
    out = []
    size = (firsts != NONE).sum(1)
    for n in range(1, k + 1):
        mine = np.flatnonzero(size == n)
        for i in range(n if len(mine) else 0):
            twins = np.delete(firsts[mine, :n], i, axis=1)
            other = np.concatenate([twins, others[mine]], 1)[:, :k]
            sim = np.concatenate([np.ones(twins.shape), far[mine]], 1)[:, :k]
            r, c = np.nonzero(sim > -np.inf)
            out.append(pd.DataFrame({"result_id": firsts[mine[r], i], "rank": c + 1, "other_id": other[r, c], "sim": sim[r, c]}))
    return pd.concat(out) if out else pd.DataFrame({"result_id": [], "rank": [], "other_id": [], "sim": []})


def search(spark: SparkSession, path: str, shards: list[tuple], k: int, ef: int = 16, m: int = 12, group_rows: int = 8192, top: int = TOP) -> DataFrame:
    """``NEAREST``: of each result in the shards whose vector no more than ``k`` results have, the ``k`` nearest others,
    in its own shard and those of its vector's other pivots.

    A task reads its shard and, one after another, those that some of its vectors are to be searched in. What a walk
    finds there is checked exactly against the tight groups of its hits, in blocks of ``group_rows``.
    """
    of: dict[tuple[str, int], list[str]] = {}
    for shard, model, pivot, _ in shards:
        of.setdefault((model, pivot), []).append(shard)
    ship = spark.sparkContext.broadcast(of)  # a name per shard

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        one_thread()
        store, of = _Store(path), ship.value
        array = lambda r, c, kind, width=None: np.frombuffer(r[c], kind) if width is None else np.frombuffer(r[c], kind).reshape(-1, width)
        for b in batches:
            for mine, model in zip(b["shard"], b["model"]):
                r = store.get(mine, "dim", "ids", "firsts", "vectors", "homes", "near", "sims")
                if r is None:
                    continue
                ids, firsts = array(r, "ids", "<i8"), array(r, "firsts", "<i8", k + 1)
                best = array(r, "near", "<i8", k), array(r, "sims", "<f8", k)
                homes = array(r, "homes", "<i4").reshape(len(ids), -1)
                known = [(ids, firsts)]
                if r["vectors"] is not None:
                    best = best[0].copy(), best[1].copy()
                    q = array(r, "vectors", np.float32, r["dim"])
                    for pivot in np.unique(homes):
                        asks = np.flatnonzero((homes == pivot).any(1))
                        for other in of.get((model, int(pivot)), ()):
                            if other == mine or (t := store.get(other, "ids", "firsts", "vectors", "links", "labels")) is None:
                                continue
                            there, x = array(t, "ids", "<i8"), array(t, "vectors", np.float32, r["dim"])
                            g = Hnsw.unpack(units(x), t["links"], top, m)
                            found = _answers(g, there, x, q[asks], np.full(len(asks), -1, np.int32), k, ef, groups=(array(t, "labels", "<i4"), group_rows))
                            best[0][asks], best[1][asks] = _merged((best[0][asks], best[1][asks]), found, k)
                            used = np.isin(there, best[0][asks])
                            known.append((there[used], array(t, "firsts", "<i8", k + 1)[used]))
                both = np.concatenate([a for a, _ in known]), np.concatenate([f for _, f in known])
                yield _expanded(ids, firsts, *best, both, k).assign(model=model)[["model", "result_id", "rank", "other_id", "sim"]]

    todo = spark.createDataFrame([s[:2] for s in shards], "shard string, model string")
    return todo.repartition(max(1, min(10_000, len(shards)))).mapInPandas(run, NEAREST)


def nearest_vectors(results: DataFrame, catalog: DataFrame, k: int = 5, shard_rows: int = 32_768, probes: int = 8, ef: int = 32, m: int = 12, tight: float = 0.8, group_rows: int = 8192, top: int = TOP) -> DataFrame:
    """``model, result_id, rank, other_id, sim``: for each usable vector the ``k`` most similar others of its model.

    Identical vectors are indexed once and come back with all their results: their similarity is 1, the smaller
    result ranks first. Vectors that are null, of another length, not finite or all zero are left out, re-delivered
    rows count once, other columns are ignored, an empty table gives an empty result.

    The graph (of models of more than ``top`` vectors) is approximate; nodes it joins by links of ``tight`` or more are compared with one another exactly, large
    groups in blocks of ``group_rows``. ``ef`` is the list a walk keeps while the graph is built (half of it when it is
    searched), ``m`` the links a node makes. The defaults are for neighbours of 0.8 and more; far ones, which differ
    little in similarity, need more. See the README for the recall measured against brute force.
    """
    reps, members = collapse(usable(results, catalog))
    key = ["model", "h1", "h2"]
    # Of identical vectors only the k + 1 smallest results can be anyone's neighbour; a task passes on no more of them.
    place = F.row_number().over(Window.partitionBy(*key).orderBy("result_id"))
    first = members.withColumn("pos", place).filter(F.col("pos") <= k + 1)
    first = first.groupBy(*key).agg(F.array_sort(F.collect_list("result_id")).alias("firsts"))
    reps = materialize(reps.drop("rep").join(first, key).select(*key, F.element_at("firsts", 1).alias("rep"), "firsts", "vec"), "reps")
    spark, path = results.sparkSession, scratch(results.sparkSession, "shards")
    rows = reps.select("model", "rep", "firsts", "vec")
    shards = build_shards(routed(rows, fit_pivots(rows, shard_rows), probes), path, shard_rows, k, ef, m, tight, group_rows, top)
    others = search(spark, path, shards, k, max(16, ef // 2), m, group_rows, top)
    # Vectors of more than k results: each result's nearest are the smallest of the same vector.
    many = reps.filter(F.size("firsts") > k).select(*key, "firsts")
    twins = members.join(many, key).select("model", "result_id", F.posexplode(F.slice(F.array_except("firsts", F.array("result_id")), 1, k)).alias("pos", "other_id"))
    return twins.select("model", "result_id", (F.col("pos") + 1).alias("rank"), "other_id", F.lit(1.0).alias("sim")).unionByName(others)


def similar_pairs(results: DataFrame, catalog: DataFrame, least: float = 0.8, **how) -> DataFrame:
    """``result_id_1, result_id_2``: pairs of similarity ``least`` or more of which one ranks among the other's nearest."""
    near = nearest_vectors(results, catalog, **how).filter(F.col("sim") >= least)
    return near.select(F.least("result_id", "other_id").alias("result_id_1"), F.greatest("result_id", "other_id").alias("result_id_2")).distinct()
