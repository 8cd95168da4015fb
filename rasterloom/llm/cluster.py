"""Clusters of mutually similar vectors, found inside overlapping k-means cells and checked exactly.

k-means brings similar vectors together; each vector goes to the cell of its nearest centroid and to those of others
nearly as near, so that a group on a border still meets. Inside a cell, blocks of rows are compared and only a star per connected part leaves
the task, never the pairs. Stars are joined over cells by star contraction; what no cell has settled is compared with its root and then pair by pair, in blocks.
Links that no cell holds are found last: what is closed so far is packed into blocks of sorted groups, a file each, and every
pair of blocks is compared, a group by its centre and radius.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from rasterloom.common import located, materialize, scratch
from rasterloom.llm.kmeans import KMeans
from rasterloom.llm.vectors import collapse, matrix, one_thread, usable

SAMPLE_ROWS = 32  # per centroid


def _blocks(rows: DataFrame, keys: list[str], block_rows: int) -> DataFrame:
    """Rows with ``i, j``: a key's rows hashed into blocks, each row sent to the pairs of blocks it belongs to."""
    n = rows.groupBy(*keys).agg(F.ceil(F.count("*") / block_rows).cast("int").alias("nb"))
    mine = F.pmod(F.xxhash64("rep", F.lit(5)), F.col("nb")).cast("int")
    rows = rows.join(n, keys).withColumn("b", mine).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    return rows.withColumn("i", F.least("b", "o")).withColumn("j", F.greatest("b", "o")).drop("nb", "o")


def _labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index of each one's connected part."""
    lab = np.arange(n)
    while True:
        low = np.minimum(lab[a], lab[b])
        new = lab.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == lab).all():
            return lab
        lab = new


def _units(x: np.ndarray) -> np.ndarray:
    u = x.astype(np.float64)
    return u / np.sqrt(np.einsum("ij,ij->i", u, u))[:, None]


def _tiles(f: np.ndarray, g: np.ndarray, rows: int = 256, cols: int = 2048) -> Iterator[tuple[int, int, np.ndarray]]:
    """Cosines of the unit rows of ``f`` and ``g``, tile by tile with its first row and column; a tile is valid until the next."""
    room = np.empty(rows * cols, np.float32)
    for s in range(0, len(f), rows):
        for t in range(0, len(g), cols):
            a, b = f[s : s + rows], g[t : t + cols]
            yield s, t, np.matmul(a, b.T, out=room[: len(a) * len(b)].reshape(len(a), len(b)))


def _parts(x: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """The smallest index of each row's connected part by links of ``least`` or more, and each row's number of links.

    Pairs are compared tile by tile, near the border in double precision; of a tile only what joins two parts is kept.
    """
    one_thread()
    u = _units(x)
    f = u.astype(np.float32)
    lab, links = np.arange(len(x), dtype=np.int32), np.zeros(len(x), np.int64)
    for s in range(0, len(x), 256):
        for _, t, c in _tiles(f[s : s + 256], f[s:]):
            linked = c >= least - 1e-4
            if t == 0:
                linked &= np.arange(c.shape[1]) > np.arange(len(c))[:, None]  # a pair once
            if not linked.any():
                continue
            p, q = np.divmod(np.flatnonzero(linked & (c < least + 1e-4)), c.shape[1])
            for e in range(0, len(p), 65_536):
                i, j = p[e : e + 65_536], q[e : e + 65_536]
                linked[i, j] = np.einsum("ij,ij->i", u[s + i], u[s + t + j]) >= least
            mine, other = slice(s, s + len(c)), slice(s + t, s + t + c.shape[1])
            links[mine] += np.count_nonzero(linked, axis=1)
            links[other] += np.count_nonzero(linked, axis=0)
            while True:
                apart = linked & (lab[mine, None] != lab[other])
                j = np.flatnonzero(apart.any(0))
                if not len(j):
                    break
                lab = _labels(len(x), lab[s + apart[:, j].argmax(0)], lab[s + t + j])[lab].astype(np.int32)
    return lab, links


def stars(assigned: DataFrame, least: float, block_rows: int = 8192) -> DataFrame:
    """``rep, root, n, whole``: for each cell (and pair of its blocks), each linked row with the smallest of its
    connected part, the part's size there, and whether all its pairs are linked."""
    rows = _blocks(assigned.select("model", F.explode("cells").alias("cell"), "rep", "vec"), ["model", "cell"], block_rows)

    def run(b: pd.DataFrame) -> pd.DataFrame:
        b = b.drop_duplicates("rep").sort_values("rep", ignore_index=True)
        lab, links = _parts(matrix(b["vec"]), least)
        n, ends = np.bincount(lab, minlength=len(b)), np.bincount(lab, links, minlength=len(b))
        linked = n[lab] > 1
        root = lab[linked]
        rep = b["rep"].to_numpy()
        return pd.DataFrame({"rep": rep[linked], "root": rep[root], "n": n[root], "whole": ends[root] == n[root] * (n[root] - 1)})

    return rows.groupBy("model", "cell", "i", "j").applyInPandas(run, "rep bigint, root bigint, n bigint, whole boolean")


def components(edges: DataFrame) -> DataFrame:
    """``rep, label``: each end of the links ``rep, root`` with the smallest id of its connected component.

    An end of one root only takes that root's label, so only the graph of roots that share an end is contracted: by large
    and small stars in turn, every node handing its smallest neighbour to the larger ones, then to the smaller ones.
    Rounds grow with the logarithm of a component's size, however long its chains are, and there is no limit to them;
    each is a stored table, and the driver sees only its count and checksum.
    """
    edges = edges.select("rep", "root")
    edges = edges.unionByName(edges.select(F.col("root").alias("rep"), "root")).distinct()  # a root is an end of its own
    low = materialize(edges.groupBy("rep").agg(F.min("root").alias("root"), F.max("root").alias("most")), "lowest")
    shared = low.filter("root <> most").select("rep", F.col("root").alias("v"))
    e, now = _stored(edges.join(shared, "rep").filter("root <> v").select(F.col("root").alias("u"), "v").distinct())
    before = None
    while now[0] and now != before:  # no edge: every end has its label
        before = now
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e, now = _stored(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
    return low.join(e, low["root"] == e["u"], "left").select("rep", F.coalesce("v", "root").alias("label"))


def _stored(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """``edges`` as a stored table, with its count and checksum taken as it is written."""
    seen = Observation()
    e = materialize(edges.observe(seen, F.count("*").alias("n"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0)).alias("x")), "edges")
    return e, (seen.get["n"], seen.get["x"])


def broken(labelled: DataFrame, least: float, block_rows: int = 8192) -> DataFrame:
    """``label``: the groups of ``label, rep, vec`` in which some two are less similar than ``least``.

    First every member is compared with its root (the member ``rep = label``), which finds chains in one pass; only
    groups that lie around their root as a whole are then compared in pairs of blocks.
    """
    labelled = materialize(labelled, "labelled")
    roots = labelled.filter("rep = label").select(F.col("label").alias("root"), F.col("vec").alias("root_vec"))

    def far(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for _, at in b.groupby(b["vec"].map(len)).indices.items():  # models differ in length
                u, v = (x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None] for x in (matrix(b[c].iloc[at]).astype(np.float64) for c in ("vec", "root_vec")))
                itself = b["rep"].to_numpy()[at] == b["label"].to_numpy()[at]
                out.append(b["label"].to_numpy()[at][~itself & (np.einsum("ij,ij->i", u, v) < least)])
            yield pd.DataFrame({"label": np.unique(np.concatenate(out)) if out else np.zeros(0, np.int64)})

    apart = labelled.join(roots, F.col("label") == F.col("root")).select("label", "rep", "vec", "root_vec")
    apart = materialize(apart.mapInPandas(far, "label bigint").distinct(), "apart")
    rows = _blocks(labelled.join(apart, "label", "left_anti"), ["label"], block_rows)

    def run(b: pd.DataFrame) -> pd.DataFrame:
        b = b.drop_duplicates("rep")
        n = len(b)
        whole = _parts(matrix(b["vec"]), least)[1].sum() == n * (n - 1)
        return pd.DataFrame({"label": b["label"].iloc[: 0 if whole else 1]})

    return apart.unionByName(rows.groupBy("label", "i", "j").applyInPandas(run, "label bigint")).distinct()


def _packed(b: pd.DataFrame, least: float) -> tuple:
    """A block of ``label, chunk, bad, rep, vec`` as ``PACKED`` has it: first the groups of two rows or more, one after another,
    then single rows, then those of broken groups. Of each group its length, its centre, and the cosine to the centre below which
    no vector can reach ``least`` with any of its rows (triangle inequality of angles)."""
    label, chunk, rep, bad = (b[c].to_numpy() for c in ("label", "chunk", "rep", "bad"))
    order = np.lexsort((rep, chunk, label, bad))
    label, chunk, bad, x = label[order], chunk[order], bad[order], matrix(b["vec"])[order]
    new = np.flatnonzero(np.r_[True, bad[1:] | (label[1:] != label[:-1]) | (chunk[1:] != chunk[:-1])])
    count = np.diff(np.r_[new, len(label)])
    kind = np.where(bad, 2, np.repeat(count == 1, count))
    order = np.argsort(kind, kind="stable")
    label, x, count = label[order], x[order], count[~bad[new] & (count > 1)]
    u, first = _units(x[: count.sum()]), np.r_[0, np.cumsum(count)][:-1]
    centre, bound = np.zeros((0, x.shape[1])), np.zeros(0)
    if len(count):
        centre = np.add.reduceat(u, first)
        centre /= np.sqrt(np.einsum("ij,ij->i", centre, centre))[:, None]
        near = np.minimum.reduceat(np.einsum("ij,ij->i", u, np.repeat(centre, count, axis=0)), first)
        # cos(angle) >= cos(threshold + radius), with a margin for single precision
        bound = np.cos(np.minimum(np.arccos(least) + np.arccos(np.clip(near, -1, 1)) + 1e-3, np.pi)) - 1e-4
    held = label.astype("<i8"), count.astype("<i4"), x.astype("<f4"), centre.astype("<f4"), bound.astype("<f4")
    return x.shape[1], int((kind == 1).sum()), *(a.tobytes() for a in held)


class _Block:
    """A block as :func:`_packed` has stored it; rows are ``x``, as unit rows ``f``."""

    def __init__(self, r: dict) -> None:
        array = lambda c, kind: np.frombuffer(r[c], kind)
        self.label, self.count = array("labels", "<i8"), array("counts", "<i4").astype(np.int64)
        self.x, self.centre = (array(c, "<f4").reshape(-1, r["dim"]) for c in ("vectors", "centres"))
        self.bound, self.f = array("bounds", "<f4"), _units(self.x).astype(np.float32)
        self.first = np.r_[0, np.cumsum(self.count)][:-1]
        self.grouped = int(self.count.sum())  # rows in groups, then singles, then broken ones
        self.closed = self.grouped + r["singles"]
        self.group = self.label[self.first]


def _above(f: np.ndarray, g: np.ndarray, bound: float | np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of ``f`` and ``g`` of a cosine of ``bound`` (one, or one for each row of ``g``) or more, where there are any."""
    bound = np.broadcast_to(np.float32(bound), len(g))
    for s, t, c in _tiles(f, g):
        near = c >= bound[t : t + c.shape[1]]
        if near.any():
            p, q = np.divmod(np.flatnonzero(near), c.shape[1])
            yield p + s, q + t


def _linked(a: _Block, b: _Block, p: np.ndarray, q: np.ndarray, least: float) -> np.ndarray:
    """Pairs (label, other label) of the rows ``p`` of ``a`` and ``q`` of ``b`` that are linked, in double precision."""
    ok = np.einsum("ij,ij->i", _units(a.x[p]), _units(b.x[q])) >= least
    return np.unique(np.stack([a.label[p[ok]], b.label[q[ok]]], 1), axis=0)


def _members(a: _Block, b: _Block, begin: int, least: float) -> Iterator[np.ndarray]:
    """Pairs (label, other label) of linked rows of ``a``'s groups and ``b``'s rows from ``begin`` on: those that a group's
    radius lets reach it are compared with all its rows."""
    for y, g in _above(b.f[begin:], a.centre, a.bound):
        y = y + begin
        other = a.group[g] != b.label[y]
        g, y = g[other], y[other]
        for t in range(0, len(g), 4096):
            p, q = g[t : t + 4096], y[t : t + 4096]
            n = a.count[p]
            start = np.r_[0, np.cumsum(n)]
            for e, h in _spans(start, 65_536):
                m, r = n[e:h], start[e : h + 1] - start[e]
                i = np.repeat(a.first[p[e:h]], m) + np.arange(r[-1]) - np.repeat(r[:-1], m)
                yield _linked(a, b, i, np.repeat(q[e:h], m), least)


def _reaching(a: _Block, b: _Block, least: float) -> Iterator[np.ndarray]:
    """Pairs (label, other label) of linked rows of two blocks, or of one; not of two broken groups."""
    one_thread()
    turns = [(a, b, slice(a.grouped, a.closed), slice(b.grouped, None))]
    if a is not b:
        turns.append((b, a, slice(b.grouped, b.closed), slice(a.closed, None)))  # broken rows of the other side
    for v, w, mine, theirs in turns:
        for p, q in _above(v.f[mine], w.f[theirs], least - 1e-4):
            p, q = p + mine.start, q + theirs.start
            other = v.label[p] != w.label[q]
            p, q = p[other], q[other]
            for t in range(0, len(p), 65_536):
                yield _linked(v, w, p[t : t + 65_536], q[t : t + 65_536], least)
    yield from _members(a, b, 0, least)
    if a is not b:
        yield from _members(b, a, a.grouped, least)  # two groups: once is enough


def _sized(rows: DataFrame, most: int = 1 << 18) -> DataFrame:
    """A stored table of ids, to be broadcast in a join if it has few rows (4 MB); otherwise the join shuffles."""
    return F.broadcast(rows) if rows.count() <= most else rows


ENDS = "rep bigint, label bigint, bad boolean, chunk int, block int, part int"


def _placed(reps: DataFrame, labels: DataFrame, wrong: DataFrame, sizes: DataFrame, blocks: dict[str, range], rows: int) -> DataFrame:
    """``ENDS`` of all vectors (``model, rep, part``), those of no group with ``label = rep``: hashed into their model's
    ``blocks`` of about ``rows`` rows, closed groups as a whole, members of the groups in ``wrong`` (``bad``) one by one.

    A group of more than an eighth of a block is cut by a hash of its members into chunks, which are groups to the
    search. ``sizes`` (``label, total``).
    """
    large = sizes.select("label", F.ceil(F.col("total") * 8 / rows).cast("int").alias("chunks")).filter("chunks > 1")
    known = labels.join(wrong.withColumn("bad", F.lit(True)), "label", "left").join(large, "label", "left")
    known = known.select("rep", "label", "bad", F.pmod(F.xxhash64("rep"), F.coalesce("chunks", F.lit(1))).cast("int").alias("chunk"))
    first = F.broadcast(reps.sparkSession.createDataFrame([(m, r.start, len(r)) for m, r in blocks.items()], "model string, start int, blocks int"))  # a row per model
    out = reps.select("model", "rep", "part").join(first, "model").join(known, "rep", "left")
    out = out.withColumns({"label": F.coalesce("label", "rep"), "bad": F.coalesce("bad", F.lit(False)), "chunk": F.coalesce("chunk", F.lit(0))})
    block = F.pmod(F.xxhash64(F.when(F.col("bad"), F.col("rep")).otherwise(F.col("label")), "chunk"), F.col("blocks")).cast("int")
    return out.select("rep", "label", "bad", "chunk", (F.col("start") + block).cast("int").alias("block"), "part")


def _told(reps: DataFrame, path: str) -> DataFrame:
    """``block, label, bad, chunk, rep, vec`` of ``part, rep, vec``: what is stored of a part below ``path`` (see :func:`_placed`)
    is read by the task that has its vectors, which are not shuffled to be joined."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.dataset as ds

        (fs, folder), at, held = located(path), None, None
        for b in batches:
            part = b["part"].to_numpy()
            for p in np.unique(part):
                if p != at:
                    at, held = p, ds.dataset(f"{folder}/part={p}", filesystem=fs, format="parquet").to_table().sort_by("rep")
                rows = b.filter(pa.array(part == p))
                mine = held.take(np.searchsorted(held["rep"].to_numpy(), rows["rep"].to_numpy()))
                columns = [mine[c].combine_chunks() for c in ("block", "label", "bad", "chunk")]
                yield pa.RecordBatch.from_arrays([*columns, rows["rep"], rows["vec"]], ["block", "label", "bad", "chunk", "rep", "vec"])

    return reps.select("part", "rep", "vec").mapInArrow(run, "block int, label bigint, bad boolean, chunk int, rep bigint, vec array<float>")


PACKED = "block int, dim int, singles int, labels binary, counts binary, vectors binary, centres binary, bounds binary"


def bridges(placed: DataFrame, blocks: dict[str, range], least: float) -> DataFrame:
    """``label, other``: the links of ``least`` or more from a closed group to a vector of another label.

    ``placed`` (see :func:`_placed`, with ``vec``) holds all vectors. A block is one file of the shared folder, so vectors are
    shuffled for it once; a task has one block and reads half of its model's others in turn, so that each pair of blocks is
    compared once. Single vectors are compared with each other, all rows with the centres of groups; a vector can be linked
    to a member only within the threshold's angle plus the group's radius around its centre, and those are compared with all
    members, so no link is lost. The work grows with single vectors squared and with groups times vectors.
    """
    spark, path = placed.sparkSession, scratch(placed.sparkSession, "blocks")
    names = [c.split()[0] for c in PACKED.split(", ")]

    def pack(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(key[0], *_packed(b, least))], columns=names)

    placed.groupBy("block").applyInPandas(pack, PACKED).write.partitionBy("block").parquet(path)
    todo = [(r, i) for r in sorted(blocks.values(), key=len, reverse=True) for i in range(len(r))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, folder = located(path)
        for b in batches:
            for r, i in (todo[t] for t in b["id"]):
                if (mine := _read(fs, f"{folder}/block={r[i]}")) is None:
                    continue
                for k in range(len(r) // 2 + 1):
                    if 2 * k == len(r) and i >= k:
                        continue  # the other one's task has the pair
                    if (other := _read(fs, f"{folder}/block={r[(i + k) % len(r)]}") if k else mine) is None:
                        continue
                    for pairs in _reaching(mine, other, least):
                        yield pd.DataFrame({"label": pairs[:, 0], "other": pairs[:, 1]})

    return materialize(spark.range(0, len(todo), 1, len(todo)).mapInPandas(run, "label bigint, other bigint").distinct(), "bridges")


def _read(fs, where: str) -> _Block | None:
    """The block stored at ``where``; None if no row fell to it."""
    import pyarrow.dataset as ds
    from pyarrow import fs as pafs

    if fs.get_file_info(where).type == pafs.FileType.NotFound:
        return None
    rows = ds.dataset(where, filesystem=fs, format="parquet").to_table(columns=[c.split()[0] for c in PACKED.split(", ")][1:]).to_pylist()
    return _Block(rows[0]) if rows else None


def _spans(start: np.ndarray, rows: int) -> list[tuple[int, int]]:
    """Consecutive ranges of the lengths that ``start`` adds up, each of about ``rows`` in total, or of one."""
    out, e = [], 0
    while e < len(start) - 1:
        h = max(e + 1, int(np.searchsorted(start, start[e] + rows, side="right")) - 1)
        out.append((e, h))
        e = h
    return out


def mutual_groups(results: DataFrame, catalog: DataFrame, least: float = 0.8, smallest: int = 3, cells: int = 4, margin: float = 0.1, per_cluster: int = 256, block_rows: int = 8192, reach_floats: int = 1 << 21) -> DataFrame:
    """``cluster_id, result_id, rep``: the groups of at least ``smallest`` usable vectors of a model in which every
    two are similar (``least`` or more) and none outside is similar to any; ``cluster_id`` is the smallest result.

    Identical vectors are compared once and all count as members. Vectors that are null, of another length, not
    finite or all zero are left out, re-delivered rows count once, an empty table gives an empty result. A vector goes to
    up to ``cells`` cells, those within ``margin`` of its nearest; links whose ends share no cell are found by
    :func:`bridges` wherever they bear on a group.
    """
    reps, members = collapse(usable(results, catalog))
    reps = materialize(reps, "reps")
    members = materialize(members.join(reps.select("model", "h1", "h2", "rep"), ["model", "h1", "h2"]).select("model", "rep", "result_id"), "members")
    reps = reps.select("model", "rep", "vec")
    if reps.isEmpty():
        return members.select(F.col("rep").alias("cluster_id"), "result_id", "rep")
    # Cells only bring rows together, so a sample tells the centroids.
    km = KMeans.fit(reps, per_cluster, sample=SAMPLE_ROWS)
    assigned = materialize(km.assign(reps, cells, margin).select("model", "rep", "vec", "cells", F.spark_partition_id().alias("part")), "assigned")
    found = materialize(stars(assigned, least, block_rows), "stars")
    labels = materialize(components(found), "labels")
    # A part of a group that some cell has seen not to be mutual settles it; so does a cell that holds it as a whole.
    seen = found.join(labels, "rep").groupBy("label").agg(F.min("whole").alias("whole"), F.max(F.when(F.col("rep") == F.col("root"), F.col("n"))).alias("n"))
    size = materialize(labels.groupBy("label").agg(F.count("*").alias("total")).join(seen, "label"), "sizes")
    open_ = materialize(labels.join(size.filter("whole and n < total").select("label"), "label"), "open")
    wrong = size.filter("not whole").select("label")
    if not open_.isEmpty():
        wrong = wrong.unionByName(broken(reps.join(_sized(open_), "rep").select("label", "rep", "vec"), least, block_rows))
    # A broken group stays broken whatever it is linked to; what is closed so far must have no other link.
    wrong = materialize(wrong, "wrong")
    rows = max(1, reach_floats // max(len(w) for w in km.weights.values()))
    blocks, n = {}, 0
    for model, total in km.sizes.items():
        blocks[model] = range(n, n := n - -total // rows)
    path = scratch(reps.sparkSession, "ends")
    _placed(assigned, labels, wrong, size, blocks, rows).repartition("part").write.partitionBy("part").parquet(path)
    new = bridges(_told(assigned, path), blocks, least)
    labels = reps.sparkSession.read.schema(ENDS).parquet(path).select("rep", "label")
    if not new.isEmpty():
        low = F.least("label", "other")
        merged = materialize(components(new.select(F.explode(F.array("label", "other")).alias("rep"), low.alias("root"))).select(F.col("rep").alias("label"), F.col("label").alias("whole")), "merged")
        lost = merged.join(wrong, "label").select(F.col("whole").alias("label")).distinct()
        open_ = materialize(labels.join(merged, "label").select(F.col("whole").alias("label"), "rep").join(lost, "label", "left_anti"), "linked")
        open_ = reps.join(_sized(open_), "rep").select("label", "rep", "vec")
        labels = labels.join(merged, "label", "left").select("rep", F.coalesce("whole", "label").alias("label"))
        wrong = wrong.unionByName(lost).unionByName(broken(open_, least, block_rows)).distinct()
    rows = members.join(labels, "rep").withColumnRenamed("label", "cluster_id").join(wrong.withColumnRenamed("label", "cluster_id"), "cluster_id", "left_anti")
    large = rows.groupBy("cluster_id").agg(F.count("*").alias("n")).filter(F.col("n") >= smallest)
    return rows.join(large, "cluster_id", "left_semi").select("cluster_id", "result_id", "rep")


def describe(results: DataFrame, catalog: DataFrame, per_cluster: int = 256, typical: int = 3) -> DataFrame:
    """``model, cluster, size, n_distinct, mean_near, typical``: the k-means clusters of the usable vectors, each with
    its size and the ``typical`` members nearest its centroid (result ids, nearest first, ties to the smaller id)."""
    reps, members = collapse(usable(results, catalog))
    reps = materialize(reps, "reps")
    sizes = members.groupBy("model", "h1", "h2").agg(F.count("*").alias("size")).join(reps.select("model", "h1", "h2", "rep"), ["model", "h1", "h2"]).select("model", "rep", "size")
    reps = reps.select("model", "rep", "vec")
    schema = "model string, cluster int, size bigint, n_distinct bigint, mean_near double, typical array<bigint>"
    if reps.isEmpty():
        return results.sparkSession.createDataFrame([], schema)
    rows = materialize(KMeans.fit(reps, per_cluster).assign(reps).select("model", "rep", F.element_at("cells", 1).alias("cluster"), "near"), "clusters")
    w = Window.partitionBy("model", "cluster").orderBy(F.desc("near"), "rep")
    best = rows.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= typical)
    best = best.groupBy("model", "cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "rep"))), lambda x: x["rep"]).alias("typical"))
    total = rows.join(sizes, ["model", "rep"]).groupBy("model", "cluster").agg(F.sum("size").alias("size"), F.count("*").alias("n_distinct"), F.round(F.avg("near"), 6).alias("mean_near"))
    return total.join(best, ["model", "cluster"])
