import math
import tracemalloc
from datetime import datetime

import numpy as np
import pytest

from rasterloom.common import table
from rasterloom.llm import cluster, neighbours
from rasterloom.llm.hnsw import Hnsw, beam, level_sizes, top_k
from rasterloom.llm.kmeans import KMeans, hashed
from rasterloom.llm.vectors import collapse, units, usable

T = datetime(2024, 1, 1)
SCHEMA = "result_id bigint, model string, embedding array<float>, ingested_at timestamp"


def catalog(spark, **dims):
    return spark.createDataFrame(list(dims.items()), "model string, dim int")


def frame(spark, rows):
    return spark.createDataFrame([(i, m, None if v is None else [None if x is None else float(x) for x in v], T) for i, m, v in rows], SCHEMA)


def usable_of(rows, dims):
    out = {}
    for i, m, v in rows:
        if i is not None and m in dims and v is not None and len(v) == dims[m] and all(x is not None and math.isfinite(x) for x in v) and any(v):
            out[i] = (m, np.array(v, np.float32).astype(np.float64))
    return out


def sims(a, b):
    return 1.0 if (a == b).all() else float(a @ b / math.sqrt(a @ a) / math.sqrt(b @ b))


def brute_pairs(rows, dims, k=5, least=0.8):
    v, out = usable_of(rows, dims), set()
    for i, (m, x) in v.items():
        near = sorted(((-sims(x, y), j) for j, (n, y) in v.items() if n == m and j != i))[:k]
        out |= {(min(i, j), max(i, j)) for s, j in near if -s >= least}
    return out


def brute_groups(rows, dims, least=0.8):
    v = usable_of(rows, dims)
    near = {i: frozenset([i] + [j for j, (n, y) in v.items() if n == m and j != i and sims(x, y) >= least]) for i, (m, x) in v.items()}
    return {(min(g), i) for i, g in near.items() if len(g) >= 3 and all(near[j] == g for j in g)}


def clumps(rng, n_groups, dim, first=0, model="m", noise=0.3):
    rows, i = [], first
    for g in range(n_groups):
        c = rng.normal(size=dim)
        for _ in range(1 + g % 7):
            rows.append((i, model, (c + noise * rng.normal(size=dim)) * rng.uniform(0.1, 5)))
            i += 1
    return rows


DIRTY = [(900, "m", None), (901, "m", [1.0] * 15), (902, "m", [float("nan")] * 16), (903, "m", [0.0] * 16), (904, "m", [None] + [1.0] * 15), (905, "other", [1.0] * 16), (906, "m", [float("inf")] + [1.0] * 15), (None, "m", [1.0] * 16), (907, None, [1.0] * 16)]


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(2)
    rows = clumps(rng, 40, 16) + clumps(rng, 10, 12, 500, "n")
    rows += [(700 + i, "m", rows[3][2]) for i in range(9)] + [(720 + i, "n", [1.0] + [0.0] * 11) for i in range(2)]
    return [(i, m, np.float32(v)) for i, m, v in rows] + DIRTY


DIMS = {"m": 16, "n": 12}


@pytest.mark.parametrize("how", [{}, {"shard_rows": 40, "probes": 4, "top": 8}])
def test_pairs_against_brute_force(spark, rows, how):
    df = frame(spark, rows)
    got = [tuple(r) for r in neighbours.similar_pairs(df, catalog(spark, **DIMS), **how).collect()]
    want = brute_pairs(rows, DIMS)
    assert len(got) == len(set(got)) and len(want) > 100
    assert len(set(got) & want) >= 0.99 * len(want) and (how or set(got) == want)


def test_ranks_of_identical_vectors(spark):
    v = [1.0, 2.0]
    df = frame(spark, [(i, "m", v) for i in range(10)] + [(20, "m", [2.0, 3.9])] + [(5, "m", v)])
    got = {(r.result_id, r["rank"]): r.other_id for r in neighbours.nearest_vectors(df, catalog(spark, m=2)).collect()}
    assert [got[9, k] for k in range(1, 6)] == [0, 1, 2, 3, 4] and [got[2, k] for k in range(1, 6)] == [0, 1, 3, 4, 5]
    assert [got[20, k] for k in range(1, 6)] == [0, 1, 2, 3, 4] and len(got) == 55


def test_groups_against_brute_force(spark, rows):
    got = [(r.cluster_id, r.result_id) for r in cluster.mutual_groups(frame(spark, rows), catalog(spark, **DIMS), per_cluster=20).collect()]
    want = brute_groups(rows, DIMS)
    assert len(got) == len(set(got)) and len(want) > 80
    assert set(got) == want


def test_a_chain_is_no_group_and_blocks_agree(spark):
    turn = lambda a: [math.cos(math.radians(a)), math.sin(math.radians(a))]
    rows = [(i, "m", turn(30 * i)) for i in range(4)] + [(10 + i, "m", turn(200 + 5 * i)) for i in range(7)]
    want = brute_groups(rows, {"m": 2})
    assert want == {(10, 10 + i) for i in range(7)}
    for how in ({}, {"block_rows": 2}, {"per_cluster": 3}):
        got = {(r.cluster_id, r.result_id) for r in cluster.mutual_groups(frame(spark, rows), catalog(spark, m=2), **how).collect()}
        assert got == want


def test_links_that_no_cell_holds_are_found(spark, rows):
    rng = np.random.default_rng(12)
    one = [(1000 + i, "m", np.float32(v)) for i, v in enumerate(rng.normal(size=16) + 0.2 * rng.normal(size=(60, 16)))]  # more than 8 centroids
    want = brute_groups(rows + one, DIMS)
    assert len({c for c, i in want if i >= 1000}) == 1
    for how in ({"per_cluster": 2, "cells": 1}, {"per_cluster": 2}, {"per_cluster": 2, "cells": 1, "reach_floats": 480}):
        got = {(r.cluster_id, r.result_id) for r in cluster.mutual_groups(frame(spark, rows + one), catalog(spark, **DIMS), **how).collect()}
        assert got == want


def test_blocks_are_compared_in_one_job_not_one_each(spark):
    rng = np.random.default_rng(17)
    rows = clumps(rng, 60, 16) + [(500 + i, "m", v) for i, v in enumerate(rng.normal(size=(60, 16)))] + [(600 + i, "m", [math.cos(i / 4), math.sin(i / 4)] + [0.0] * 14) for i in range(30)]
    rows = [(i, m, np.float32(v)) for i, m, v in rows]
    want, jobs = brute_groups(rows, {"m": 16}), []
    for how in ({}, {"reach_floats": 160}):  # one block, and 33
        before = spark.sparkContext._jsc.sc().dagScheduler().numTotalJobs()
        got = cluster.mutual_groups(frame(spark, rows), catalog(spark, m=16), per_cluster=4, **how).collect()
        jobs.append(spark.sparkContext._jsc.sc().dagScheduler().numTotalJobs() - before)
        assert {(r.cluster_id, r.result_id) for r in got} == want and len(got) == len(want) > 100
    assert jobs[1] <= jobs[0] + 5


def test_parts_of_a_hot_cell_hold_no_pairs():
    rng = np.random.default_rng(18)
    x = (rng.normal(size=16) + 0.25 * rng.normal(size=(4000, 16))).astype(np.float32)
    x[:1500] = rng.normal(size=(1500, 16))
    x[1500:1540, :] = [[math.cos(i / 4), math.sin(i / 4)] + [0.0] * 14 for i in range(40)]
    u = x / np.linalg.norm(x.astype(np.float64), axis=1)[:, None]
    linked = u @ u.T >= 0.8
    tracemalloc.start()
    lab, links = cluster._parts(x, 0.8)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (links == linked.sum(1) - 1).all()
    assert (lab[linked.argmax(1)] == lab).all() and all(lab[r].min() == lab[r].max() == lab[i] for i, r in enumerate(linked))
    assert links.sum() / 2 * 16 > 40e6 and peak < 20e6  # 2.6 million pairs and more, as two numbers each


def test_centroids_of_a_sample_keep_every_model_and_size(spark):
    rng = np.random.default_rng(19)
    df = frame(spark, [(i, "m", v) for i, v in enumerate(rng.normal(size=(900, 6)).tolist())] + [(1000, "n", [1.0] * 6)])
    reps = collapse(usable(df, catalog(spark, m=6, n=6)))[0].select("model", "rep", "vec")
    km = KMeans.fit(reps, per_cluster=100, sample=8)
    assert km.sizes == {"m": 900, "n": 1} and len(km.centroids["n"]) == 1 and 1 <= len(km.centroids["m"]) <= 9
    assert km.assign(reps, 4, 0.1).filter("size(cells) between 1 and 4").count() == 901


def test_a_long_chain_settles_and_costs_no_other_group(spark):
    n = 4000
    ring = [(i, "ring", [math.cos(2 * math.pi * i / n), math.sin(2 * math.pi * i / n)]) for i in range(n)]
    clean = [(10_000 + i, "clean", [1.0, 0.01 * i]) for i in range(4)]
    got = cluster.mutual_groups(frame(spark, ring + clean), catalog(spark, ring=2, clean=2), per_cluster=3).collect()
    assert {(r.cluster_id, r.result_id) for r in got} == {(10_000, 10_000 + i) for i in range(4)}


def test_components_of_a_path_and_of_stars(spark):
    rng = np.random.default_rng(13)
    name = rng.permutation(100_000)
    path = [(int(name[i]), int(name[i + 1])) for i in range(99_999)]
    star = [(200_000 + i, 200_000) for i in range(50)] + [(300_000, 300_000)]
    got = {r.rep: r.label for r in cluster.components(spark.createDataFrame(path + star, "rep bigint, root bigint")).collect()}
    assert len(got) == 100_051 and {got[i] for i in range(100_000)} == {0}
    assert {got[200_000 + i] for i in range(50)} == {200_000} and got[300_000] == 300_000


def test_nothing_usable_and_clashing_columns(spark):
    none, c = frame(spark, DIRTY), catalog(spark, m=16)
    for df in (none, none.limit(0)):
        assert neighbours.nearest_vectors(df, c).count() == 0
        assert cluster.mutual_groups(df, c).count() == 0
        assert cluster.describe(df, c).count() == 0
    df = frame(spark, [(i, "m", [1.0, 1.0]) for i in range(3)]).selectExpr("*", "1 AS rep", "2 AS dim", "3 AS vec", "4 AS pivot")
    assert neighbours.nearest_vectors(df, catalog(spark, m=2)).count() == 6
    assert cluster.mutual_groups(df, catalog(spark, m=2)).count() == 3


def test_repeated_delivery_counts_once(spark):
    df = frame(spark, [(i, "m", [1.0, 1.0]) for i in (1, 2, 2, 2)])
    assert cluster.mutual_groups(df, catalog(spark, m=2)).count() == 0
    reps, members = collapse(usable(df, catalog(spark, m=2)))
    assert reps.count() == 1 and members.count() == 2


def test_clusters_cover_everything(spark):
    d = "/root/testdata/sf0.01"
    r, c = table(spark, d, "model_results"), table(spark, d, "model_catalog")
    got = cluster.describe(r, c).collect()
    assert sum(x["size"] for x in got) == usable(r, c).select("result_id").distinct().count()
    assert all(1 <= len(x.typical) <= 3 and x.n_distinct <= x["size"] for x in got)


def test_clusters_separate_what_is_apart(spark):
    rng = np.random.default_rng(4)
    rows = [(i, "m", np.eye(8)[i % 4] * 5 + rng.normal(size=8) * 0.1) for i in range(400)]
    got = cluster.describe(frame(spark, rows), catalog(spark, m=8), per_cluster=100).collect()
    assert len(got) == 4 and {x["size"] for x in got} == {100}
    assert all(len({t % 4 for t in x.typical}) == 1 for x in got)


def test_typical_members_are_nearest(spark):
    rng = np.random.default_rng(5)
    df = frame(spark, [(i, "m", rng.normal(size=6)) for i in range(60)])
    reps, _ = collapse(usable(df, catalog(spark, m=6)))
    reps = reps.select("model", "rep", "vec").cache()
    km = KMeans.fit(reps, per_cluster=30)
    rows = km.assign(reps).collect()
    near = {(r.cells[0], r.rep): r.near for r in rows}
    f = {r.rep: km.features("m", __import__("pandas").Series([r.vec]))[0] for r in rows}
    for (c, rep), s in near.items():
        assert s == pytest.approx(float(f[rep] @ km.centroids["m"][c]), abs=1e-5)
        assert s >= max(float(f[rep] @ x) for x in km.centroids["m"]) - 1e-5


def test_hashed_features_keep_similarity():
    rng = np.random.default_rng(6)
    a = units(rng.normal(size=(200, 64)))
    h = hashed(a, np.ones(64))
    assert np.allclose(np.linalg.norm(h, axis=1), 1, atol=1e-5)
    assert np.corrcoef((a @ a.T).ravel(), (h @ h.T).ravel())[0, 1] > 0.8  # 64 components in 128 buckets: some share one


def test_graph_recall_and_storage():
    rng = np.random.default_rng(7)
    c = rng.normal(size=(900, 32))
    x = units((c[rng.integers(0, 900, 6000)] + 0.4 * rng.normal(size=(6000, 32))))
    g = Hnsw.build(x)
    assert len(level_sizes(6000)) == 2 and len(g.links) == 1 and len(level_sizes(6000, 100)) == 3
    own = np.arange(6000, dtype=np.int32)
    ids, s = g.search(x, 6, own=own)
    sample = rng.permutation(6000)[:500]
    true = x[sample] @ x.T
    true[np.arange(500), sample] = -1
    want = top_k(true, 5)
    hits = sum(len(set(w.tolist()) & set(ids[i].tolist())) for i, w in zip(sample, want))
    assert hits / 2500 >= 0.95
    cold, _ = g.search(x[sample], 6)
    assert sum(len(set(w.tolist()) & set(r.tolist())) for r, w in zip(cold, want)) / 2500 >= 0.9
    again = Hnsw.unpack(x, g.pack())
    assert all((a == b).all() for a, b in zip(g.links, again.links))
    assert (again.search(x[:50], 6, own=own[:50])[0] == ids[:50]).all()


def test_reranking_betters_every_list_and_respects_its_limit():
    rng = np.random.default_rng(9)
    c = rng.normal(size=(8, 32))
    x = units(c[rng.integers(0, 8, 4000)] + 0.5 * rng.normal(size=(4000, 32)))
    g = Hnsw.build(x, 16)
    ids, s = g.search(x, 6, 8, np.arange(4000, dtype=np.int32))
    best, bs = g.reranked(ids, s, 0.6, 4000)
    assert (bs >= s - 1e-6).all() and all(len(set(r.tolist())) == 6 for r in best)
    want = top_k(x @ x.T, 6)
    share = lambda got: sum(len(set(a.tolist()) & set(b.tolist())) for a, b in zip(got, want)) / want.size
    assert share(best) > 0.99 > share(ids)
    assert (g.reranked(ids, s, 0.6, 2)[0] == ids).mean() > 0.999


def test_a_tight_group_of_any_size_is_compared_exactly():
    rng = np.random.default_rng(10)
    x = units(rng.normal(size=16) + 0.3 * rng.normal(size=(8800, 16)))  # one group of more than group_rows = 8192
    g = Hnsw.build(x, 16)
    assert np.bincount(g.tight_groups(0.8)).max() > 8192
    near, _ = neighbours._answers(g, np.arange(8800), x, x, np.arange(8800, dtype=np.int32), 5, 16, (0.8, 8192))
    true = x @ x.T
    np.fill_diagonal(true, -1)
    want = {(i, j) for i, r in enumerate(top_k(true, 5).tolist()) for j in r}
    assert len(want & {(i, j) for i, r in enumerate(near.tolist()) for j in r}) > 0.999 * len(want)


def test_other_shards_compare_the_groups_of_their_hits_exactly(spark):
    rng = np.random.default_rng(11)
    x = (rng.normal(size=64) + 0.3 * rng.normal(size=(12_000, 64))).astype(np.float32)  # one group in three shards or more
    df = frame(spark, [(i, "m", v) for i, v in enumerate(x.tolist())])
    got = neighbours.nearest_vectors(df, catalog(spark, m=64), shard_rows=5000, probes=8).toPandas()
    u = units(x)
    true = u @ u.T
    np.fill_diagonal(true, -1)
    want = {(i, j) for i, r in enumerate(top_k(true, 5).tolist()) for j in r}
    share = len(want & set(zip(got["result_id"], got["other_id"]))) / len(want)
    assert share > 0.999


def five_of(got, u):
    """The share of the true five nearest of each row of unit vectors ``u`` that ``got`` names."""
    true = u @ u.T
    np.fill_diagonal(true, -1)
    want = {(i, j) for i, r in enumerate(top_k(true, 5).tolist()) for j in r}
    return len(want & set(zip(got["result_id"], got["other_id"]))) / len(want)


def test_a_small_model_beside_a_large_one_keeps_its_neighbours(spark):
    rng = np.random.default_rng(14)
    big = [(i, "big", v) for i, v in enumerate(rng.normal(size=(4000, 16)).tolist())]
    small = rng.normal(size=(60, 16)).astype(np.float32)
    df = frame(spark, big + [(10_000 + i, "small", v) for i, v in enumerate(small.tolist())])
    reps, _ = collapse(usable(df, catalog(spark, big=16, small=16)))
    assert set(neighbours.fit_pivots(reps.select("model", "rep", "vec"), 40)) == {"big", "small"}
    got = neighbours.nearest_vectors(df, catalog(spark, big=16, small=16), shard_rows=40).filter("model = 'small'").toPandas()
    got[["result_id", "other_id"]] -= 10_000
    assert five_of(got, units(small)) == 1.0  # two shards, both asked


def test_parts_of_one_pivot_are_all_searched(spark):
    rng = np.random.default_rng(15)
    x = rng.normal(size=(300, 8)).astype(np.float32)
    reps = spark.createDataFrame([("m", i, [i], v) for i, v in enumerate(x.tolist())], "model string, rep bigint, firsts array<bigint>, vec array<float>")
    there = neighbours.routed(reps, {"m": units(x[:1])}, 8)
    path = neighbours.scratch(spark, "shards")
    shards = neighbours.build_shards(there, path, 60, 5, top=16)
    assert len(shards) == 5
    got = neighbours.search(spark, path, shards, 5, top=16).toPandas()
    assert five_of(got, units(x)) > 0.99


def test_eight_merged_graphs_keep_all_five_neighbours(spark):
    rng = np.random.default_rng(16)
    c = rng.normal(size=(1500, 48))
    x = (c[rng.integers(0, 1500, 12_000)] + 0.5 * rng.normal(size=(12_000, 48))).astype(np.float32)
    got = neighbours.nearest_vectors(frame(spark, [(i, "m", v) for i, v in enumerate(x.tolist())]), catalog(spark, m=48), shard_rows=1500, ef=48).toPandas()
    assert five_of(got, units(x)) >= 0.95


def test_small_and_single_graphs():
    x = units(np.eye(3, dtype=np.float32))
    for n in (1, 2, 3):
        ids, s = Hnsw.build(x[:n]).search(x[:n], 5)
        assert ids.shape == (n, 5) and (ids[:, 0] == np.arange(n)).all() and (ids[:, n:] == -1).all()


def test_walk_finds_a_neighbour_of_a_line():
    x = units(np.stack([np.cos(np.linspace(0, 1, 64)), np.sin(np.linspace(0, 1, 64))], 1))
    links = np.stack([np.maximum(np.arange(64) - 1, 0), np.minimum(np.arange(64) + 1, 63)], 1).astype(np.int32)
    ids, _ = beam(x, links, x[60:61], np.array([[0]], np.int32), 4)
    assert ids[0, 0] == 60 and set(ids[0].tolist()) == {58, 59, 60, 61, 62} - {58 if 62 in ids[0] else 62}
