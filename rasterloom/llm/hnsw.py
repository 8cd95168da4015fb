"""A hierarchical navigable small-world graph over one shard of unit vectors, in flat arrays and whole batches.

Nodes are numbered in order of insertion, the nodes of the upper levels first, so a level is a prefix of the nodes and
one ``int32`` matrix of neighbours. The uppermost level is small enough to be compared as a whole. A node's links are
``m`` chosen at its insertion for closeness and diversity, which nothing displaces, and the closest of those that later
nodes have made to it, five thirds of ``m`` at most.
"""

from __future__ import annotations

import numpy as np

#: A level holds one of ``RATIO`` nodes of the level below; the uppermost has at most ``TOP``.
RATIO, TOP = 32, 1024
BATCH = 512


def level_sizes(n: int, top: int = TOP) -> list[int]:
    sizes = [n]
    while sizes[-1] > top:
        sizes.append(-(-sizes[-1] // RATIO))
    return sizes


def top_k(sims: np.ndarray, k: int) -> np.ndarray:
    """Columns of the ``k`` largest of each row, largest first."""
    k = min(k, sims.shape[1])
    at = np.argpartition(-sims, k - 1, axis=1)[:, :k] if k < sims.shape[1] else np.broadcast_to(np.arange(k), sims.shape)
    return np.take_along_axis(at, np.argsort(-np.take_along_axis(sims, at, 1), axis=1, kind="stable"), 1)


def beam(x: np.ndarray, links: np.ndarray, q: np.ndarray, start: np.ndarray, ef: int, wide: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """The ``ef`` nodes nearest to each query that a best-first walk from ``start`` finds: ids (-1: none) and similarities.

    All queries of a batch take their steps together, expanding ``wide`` nodes each; a node is compared once per query.
    """
    out, outs = np.full((len(q), ef), -1, np.int32), np.full((len(q), ef), -np.inf, np.float32)
    seen = np.zeros((len(q), len(links)), bool)
    ids, sims = out.copy(), outs.copy()
    n0 = min(start.shape[1], ef)
    ids[:, :n0] = start[:, :n0]
    sims[:, :n0] = np.where(ids[:, :n0] >= 0, np.matmul(x[ids[:, :n0]], q[:, :, None])[:, :, 0], -np.inf)
    row, col = np.nonzero(ids >= 0)
    seen[row, ids[row, col]] = True
    done = ids < 0
    live = np.arange(len(q))
    while len(live):
        open_sims = np.where(done, -np.inf, sims)
        pick = np.argpartition(-open_sims, wide - 1, axis=1)[:, :wide]
        good = np.take_along_axis(open_sims, pick, 1) > -np.inf
        more = good.any(1)
        if not more.all():
            out[live[~more]], outs[live[~more]] = ids[~more], sims[~more]
            live, pick, good, ids, sims, done = live[more], pick[more], good[more], ids[more], sims[more], done[more]
            if not len(live):
                break
        np.put_along_axis(done, pick, True, 1)
        near = np.where(good[:, :, None], links[np.take_along_axis(ids, pick, 1)], -1).reshape(len(live), -1)
        row, col = np.nonzero(near >= 0)
        node = near[row, col]
        new = ~seen[live[row], node]
        row, col, node = row[new], col[new], node[new]
        seen[live[row], node] = True
        s = np.full(near.shape, -np.inf, np.float32)
        s[row, col] = np.einsum("ij,ij->i", x[node], q[live[row]])
        best = top_k(np.concatenate([sims, s], 1), ef)
        done = np.take_along_axis(np.concatenate([done, s == -np.inf], 1), best, 1)
        ids = np.take_along_axis(np.concatenate([ids, near], 1), best, 1)
        sims = np.take_along_axis(np.concatenate([sims, s], 1), best, 1)
        # No node where nothing is left, and a node that two others have led to once.
        none = sims == -np.inf
        none[:, 1:] |= ids[:, 1:] == ids[:, :-1]
        ids[none], sims[none], done[none] = -1, -np.inf, True
    return out, outs


def diverse(x: np.ndarray, ids: np.ndarray, sims: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each row's candidates (nearest first, -1: none) ``m`` links: those nearer to the node than to any link
    already taken, then the nearest of the rest."""
    v = x[ids]
    between = np.matmul(v, v.transpose(0, 2, 1))
    b, c = ids.shape
    keep = np.zeros((b, c), bool)
    count = np.zeros(b, np.int64)
    for j in range(c):
        hidden = (keep[:, :j] & (between[:, j, :j] > sims[:, j, None])).any(1)
        keep[:, j] = ~hidden & (ids[:, j] >= 0) & (count < m)
        count += keep[:, j]
    rank = np.where(ids < 0, 2 * c, np.where(keep, 0, c)) + np.arange(c)
    at = np.argsort(rank, axis=1)[:, :m]
    return np.take_along_axis(ids, at, 1), np.take_along_axis(sims, at, 1)


class Hnsw:
    def __init__(self, x: np.ndarray, links: list[np.ndarray], top: int = TOP, m: int = 12) -> None:
        #: unit vectors in insertion order; neighbours of each level from the lowest, without the uppermost
        self.x, self.links = x, links
        self.sizes = level_sizes(len(x), top)
        self.m_out, self.m_in = m, 5 * m // 3

    @classmethod
    def build(cls, x: np.ndarray, ef: int = 32, top: int = TOP, m: int = 12, keep: int = 10) -> Hnsw:
        """``x``: float32 unit vectors, in an order that has nothing to do with their content. Up to ``top`` nodes are
        one level and have no graph.

        Each node's insertion finds its nearest among those before it and offers it to them; ``near`` are the ``keep``
        best of both, so the nodes' own neighbours need no second walk."""
        g = cls(x, [], top, m)
        sizes = g.sizes
        g.near = np.full((len(x), keep), -1, np.int32), np.full((len(x), keep), -np.inf, np.float32)
        for level in range(len(sizes) - 2, -1, -1):
            g.links.insert(0, g._level(sizes[level], sizes[level + 1], ef, level == 0))
        return g

    def _level(self, n: int, above: int, ef: int, lowest: bool) -> np.ndarray:
        x = self.x
        links = np.full((n, self.m_out + self.m_in), -1, np.int32)
        back = np.full((n, self.m_in), -np.inf, np.float32)
        have = min(n, max(above, 1024))
        for a in range(0, have, BATCH):  # the first nodes are compared with one another
            b = min(a + BATCH, have)
            s = x[a:b] @ x[:have].T
            s[np.arange(b - a), np.arange(a, b)] = -np.inf
            at = top_k(s, min(ef, have - 1))
            self._link(links, back, a, b, at.astype(np.int32), np.take_along_axis(s, at, 1))
            if lowest:
                self._offer(a, b, at.astype(np.int32), np.take_along_axis(s, at, 1), False)
        while have < n:
            end = min(n, have + min(2048, have))
            inner = x[have:end] @ x[have:end].T
            np.fill_diagonal(inner, -np.inf)
            found = []
            for a in range(have, end, BATCH):
                b = min(a + BATCH, end)
                q = x[a:b]
                ids, sims = beam(x, links, q, self._enter(q, above, have), ef)
                s = inner[a - have : b - have]
                at = top_k(s, self.m_out)
                ids, sims = np.concatenate([ids, (at + have).astype(np.int32)], 1), np.concatenate([sims, np.take_along_axis(s, at, 1)], 1)
                best = top_k(sims, ef)
                found.append((a, b, np.take_along_axis(ids, best, 1), np.take_along_axis(sims, best, 1)))
            for a, b, ids, sims in found:
                self._link(links, back, a, b, ids, sims)
                if lowest:
                    self._offer(a, b, ids, sims, True)
            have = end
        return links

    def _enter(self, q: np.ndarray, above: int, have: int, n: int = 4) -> np.ndarray:
        """Where a walk begins: the nearest nodes of the uppermost level, led down through the levels between."""
        at = top_k(q @ self.x[: min(self.sizes[-1], have)].T, n).astype(np.int32)
        for links in reversed(self.links):
            if len(links) <= above:
                at = beam(self.x, links, q, at, 8)[0][:, :n]
        return at

    def _back(self, links: np.ndarray, back: np.ndarray, src: np.ndarray, dst: np.ndarray, sims: np.ndarray) -> None:
        """Add the links ``dst`` -> ``src``; of too many, the closest stay."""
        node, ids, s = _best_of(links[:, self.m_out :], back, src, dst, sims)
        links[node, self.m_out :], back[node] = ids, s

    def _offer(self, a: int, b: int, ids: np.ndarray, sims: np.ndarray, both: bool) -> None:
        """What nodes ``a`` to ``b`` have found goes to their lists, and they to the lists of what they found."""
        near, ns = self.near
        width = min(near.shape[1], ids.shape[1])
        near[a:b, :width], ns[a:b, :width] = ids[:, :width], sims[:, :width]
        if both:
            # Of nodes inserted together, those found by both would be on a list twice.
            ok = (ids >= 0) & ((ids < a) | (ids >= b))
            node, ids, s = _best_of(near, ns, np.repeat(np.arange(a, b, dtype=np.int32), ok.sum(1)), ids[ok], sims[ok])
            twice = np.zeros(ids.shape, bool)
            twice[:, 1:] = ids[:, 1:] == ids[:, :-1]
            near[node], ns[node] = np.where(twice, -1, ids), np.where(twice, -np.inf, s)

    def _link(self, links: np.ndarray, back: np.ndarray, a: int, b: int, ids: np.ndarray, sims: np.ndarray) -> None:
        ids, sims = diverse(self.x, ids, sims, self.m_out)
        links[a:b, : ids.shape[1]] = ids
        ok = ids >= 0
        self._back(links, back, np.repeat(np.arange(a, b, dtype=np.int32), ok.sum(1)), ids[ok], sims[ok])

    def search(self, q: np.ndarray, k: int, ef: int = 32, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ``k`` nearest nodes of each query: ids (-1: none) and similarities, nearest first.

        ``own``: nodes that the queries themselves are (-1: none); a walk then begins at its own links, too.
        """
        n = len(self.x)
        ids = np.full((len(q), k), -1, np.int32)
        sims = np.full((len(q), k), -np.inf, np.float32)
        for a in range(0, len(q), BATCH):
            part = q[a : a + BATCH]
            if not self.links:
                s = part @ self.x.T
                at = top_k(s, k)
                got, gs = at.astype(np.int32), np.take_along_axis(s, at, 1)
            else:
                start = self._enter(part, n - 1, n)
                if own is not None:
                    mine = own[a : a + BATCH, None]
                    start = np.concatenate([mine, np.where(mine >= 0, self.links[0][mine[:, 0]], -1)[:, : ef - 5], start], 1)
                    start = _distinct(start)
                got, gs = beam(self.x, self.links[0], part, start, max(ef, k))
            got, gs = got[:, :k], gs[:, :k]
            ids[a : a + BATCH, : got.shape[1]], sims[a : a + BATCH, : got.shape[1]] = got, gs
        return ids, sims

    def tight_groups(self, tight: float) -> np.ndarray:
        """A number per node: equal for nodes that links of similarity ``tight`` or more join."""
        links = self.links[0]
        row, col = np.nonzero(links >= 0)
        row, col = row.astype(np.int32), links[row, col]
        keep = np.zeros(len(row), bool)
        for s in range(0, len(row), 262_144):
            e = slice(s, s + 262_144)
            keep[e] = np.einsum("ij,ij->i", self.x[row[e]], self.x[col[e]]) >= tight
        row, col = row[keep], col[keep]
        lab = np.arange(len(self.x))
        while True:
            low = np.minimum(lab[row], lab[col])
            new = lab.copy()
            np.minimum.at(new, row, low)
            np.minimum.at(new, col, low)
            new = new[new]
            if (new == lab).all():
                return lab
            lab = new

    def reranked(self, ids: np.ndarray, sims: np.ndarray, tight: float, most: int | None = None, block_rows: int = 8192) -> tuple[np.ndarray, np.ndarray]:
        """Every node's list (``ids[i]`` of node ``i``), checked exactly against the nodes it is tightly joined with.

        Among hundreds of nodes that are all about as near, a walk settles for some; the graph has brought them
        together, so they are compared with one another, a group of more than ``block_rows`` in blocks of that many.
        With ``most``, groups of more nodes keep what the walks found.
        """
        if not self.links:
            return ids, sims
        k = ids.shape[1]
        lab = self.tight_groups(tight)
        order = np.argsort(lab, kind="stable")
        first = np.flatnonzero(np.r_[True, np.diff(lab[order]) > 0])
        more, ms = np.full_like(ids, -1), np.full_like(sims, -np.inf)
        for a, b in zip(first, np.r_[first[1:], len(order)]):
            if 2 <= b - a and (most is None or b - a <= most):
                group = order[a:b]
                for s in range(0, len(group), 1024):
                    me = group[s : s + 1024]
                    more[me], ms[me] = self._nearest_of(self.x[me], group, k, block_rows)
        out, outs = np.empty_like(ids), np.empty_like(sims)
        for a in range(0, len(ids), 4096):
            e = slice(a, a + 4096)
            new = more[e].copy()
            new[(new[:, :, None] == ids[e, None, :]).any(2)] = -1
            both, bs = np.concatenate([ids[e], new], 1), np.concatenate([sims[e], np.where(new >= 0, ms[e], -np.inf)], 1)
            best = top_k(bs, k)
            out[e], outs[e] = np.take_along_axis(both, best, 1), np.take_along_axis(bs, best, 1)
        out[outs == -np.inf] = -1
        return out, outs

    def reached(self, q: np.ndarray, ids: np.ndarray, sims: np.ndarray, lab: np.ndarray, block_rows: int = 8192) -> tuple[np.ndarray, np.ndarray]:
        """The lists ``ids`` of queries that are no nodes, checked exactly against the whole tight groups (``lab``, see
        :meth:`tight_groups`) of all their nodes."""
        if not self.links:
            return ids, sims
        k = ids.shape[1]
        order = np.argsort(lab, kind="stable").astype(np.int32)
        first = np.flatnonzero(np.r_[True, np.diff(lab[order]) > 0])
        ends = np.r_[first[1:], len(order)]
        at = np.searchsorted(lab[order][first], lab)  # of each node its group
        group = np.where((ids >= 0) & ((ends - first)[at[ids]] > 1), at[ids], -1)
        row = np.repeat(np.arange(len(q)), k)[group.ravel() >= 0]
        pairs = np.unique(np.stack([group[group >= 0], row], 1), axis=0)  # each group with its queries
        out, outs = ids.copy(), sims.copy()
        starts = np.flatnonzero(np.r_[True, np.diff(pairs[:, 0]) > 0]) if len(pairs) else []
        for a, b in zip(starts, np.r_[starts[1:], len(pairs)] if len(pairs) else []):
            members = order[first[pairs[a, 0]] : ends[pairs[a, 0]]]
            for s in range(a, b, 1024):
                me = pairs[s : min(s + 1024, b), 1]
                new, ns = self._nearest_of(q[me], members, k, block_rows)
                ns[(new[:, :, None] == out[me][:, None, :]).any(2)] = -np.inf
                both, bs = np.concatenate([out[me], new], 1), np.concatenate([outs[me], ns], 1)
                best = top_k(bs, k)
                out[me], outs[me] = np.take_along_axis(both, best, 1), np.take_along_axis(bs, best, 1)
        out[outs == -np.inf] = -1
        return out, outs

    def _nearest_of(self, q: np.ndarray, group: np.ndarray, k: int, block_rows: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``k`` nodes of ``group`` nearest to each query: ids (-1: none) and similarities, by blocks of the group."""
        ids, sims = np.full((len(q), k), -1, np.int32), np.full((len(q), k), -np.inf, np.float32)
        for s in range(0, len(group), block_rows):
            block = group[s : s + block_rows]
            sim = q @ self.x[block].T
            at = top_k(sim, k)
            both, bs = np.concatenate([ids, block[at].astype(np.int32)], 1), np.concatenate([sims, np.take_along_axis(sim, at, 1)], 1)
            best = top_k(bs, k)
            ids, sims = np.take_along_axis(both, best, 1), np.take_along_axis(bs, best, 1)
        return ids, sims

    def pack(self) -> bytes:
        return b"".join(links.tobytes() for links in self.links)

    @classmethod
    def unpack(cls, x: np.ndarray, data: bytes, top: int = TOP, m: int = 12) -> Hnsw:
        flat, links, at = np.frombuffer(data, np.int32), [], 0
        for n in level_sizes(len(x), top)[:-1]:
            size = n * (m + 5 * m // 3)
            links.append(flat[at : at + size].reshape(n, -1))
            at += size
        return cls(x, links, top, m)


def _best_of(ids: np.ndarray, sims: np.ndarray, src: np.ndarray, dst: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The nodes in ``dst``, and for each the closest of its row of ``ids`` and the ``src`` that come with it."""
    width = ids.shape[1]
    order = np.lexsort((-new, dst))
    src, dst, new = src[order], dst[order], new[order]
    first = np.flatnonzero(np.r_[True, dst[1:] != dst[:-1]]) if len(dst) else np.zeros(0, np.int64)
    size = np.diff(np.r_[first, len(dst)])
    rank = np.arange(len(dst)) - np.repeat(first, size)
    node = dst[first]
    both = np.concatenate([ids[node], np.full((len(node), width), -1, np.int32)], 1)
    s = np.concatenate([sims[node], np.full((len(node), width), -np.inf, np.float32)], 1)
    fits = rank < width
    row = np.repeat(np.arange(len(node)), size)[fits]
    both[row, width + rank[fits]], s[row, width + rank[fits]] = src[fits], new[fits]
    best = top_k(s, width)
    return node, np.take_along_axis(both, best, 1), np.take_along_axis(s, best, 1)


def _distinct(ids: np.ndarray) -> np.ndarray:
    """Each row's ids once, repeats as -1."""
    ids = np.sort(ids, axis=1)[:, ::-1].copy()
    ids[:, 1:][ids[:, 1:] == ids[:, :-1]] = -1
    return ids
