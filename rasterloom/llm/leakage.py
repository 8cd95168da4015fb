"""Evaluation passages in training text, by pigeonhole pieces and Myers' bit-parallel distance.

A passage of ``run`` words with at most ``errors`` edits, cut into ``errors`` + 1 pieces, has one piece intact. Every
window of ``run`` words of every item is such a passage; the pieces of all windows form one table of word hashes.
Documents are read once: an exact piece hit names windows, and Myers' algorithm, run for all hits of a batch at once,
gives the least edit distance of each window to the words around the hit. Distance 0 is a verbatim run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.text import words

_FLUSH_WORDS = 400_000
_U = np.uint64


def myers(pattern: np.ndarray, text: np.ndarray) -> np.ndarray:
    """For each row the least edit distance of ``pattern`` (up to 63 symbols) to any stretch of ``text``.

    Symbols are positive integers; 0 in the text equals nothing.
    """
    m = pattern.shape[1]
    if not 0 < m < 64:
        raise ValueError("patterns have 1 to 63 symbols")
    ones = _U((1 << m) - 1)
    high = _U(1 << (m - 1))
    pv = np.full(len(pattern), ones, _U)
    mv = np.zeros(len(pattern), _U)
    score = np.full(len(pattern), m, np.int64)
    best = score.copy()
    bits = _U(1) << np.arange(m, dtype=_U)
    for j in range(text.shape[1]):
        eq = np.where((pattern == text[:, j, None]) & (pattern > 0), bits, _U(0)).sum(1, dtype=_U)
        xv = eq | mv
        xh = ((((eq & pv) + pv) & ones) ^ pv) | eq
        ph = mv | (~(xh | pv) & ones)
        mh = pv & xh
        score += ((ph & high) != 0).astype(np.int64) - ((mh & high) != 0)
        ph = (ph << _U(1)) & ones  # a stretch may begin anywhere: no cost to the left
        mh = (mh << _U(1)) & ones
        pv = mh | (~(xv | ph) & ones)
        mv = ph & xv
        np.minimum(best, score, out=best)
    return best


class Items:
    """The held-out items as numbers: vocabulary, windows and the table of their pieces."""

    def __init__(self, items: list[tuple[int, str | None]], run: int, errors: int) -> None:
        self.run, self.errors = run, errors
        self.piece = run // (errors + 1)
        if self.piece < 1:
            raise ValueError("more errors than words in a run")
        self.vocabulary: dict[str, int] = {}
        ids, owner, first = [], [], [0]
        for item, text in items:
            w = words(text, brackets=False)
            ids += [self.vocabulary.setdefault(x, len(self.vocabulary) + 1) for x in w]
            owner.append(item)
            first.append(len(ids))
        self.ids = np.array(ids, np.int64)
        self.owner, self.first = np.array(owner, np.int64), np.array(first)
        self.item_of = np.repeat(np.arange(len(owner)), np.diff(self.first))
        n = max(len(self.ids) - self.piece + 1, 0)
        at = np.arange(n)
        at = at[self.item_of[at] == self.item_of[at + self.piece - 1]] if n else at
        h = grams(self.ids, self.piece)[at] if n else np.zeros(0, _U)
        order = np.argsort(h, kind="stable")
        self.hashes, self.places = h[order], at[order]
        self.filter = np.zeros(1 << 22, bool)
        self.filter[(self.hashes >> _U(42)).astype(np.int64)] = True


def grams(ids: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of each run of ``n`` numbers."""
    h = np.zeros(max(len(ids) - n + 1, 0), _U)
    for j in range(n):
        h = (h ^ ids[j : j + len(h)].astype(_U)) * _U(0x9E3779B97F4A7C15)
        h ^= h >> _U(29)
    return h * _U(0xBF58476D1CE4E5B9)


def matches(items: Items, docs: np.ndarray, ids: np.ndarray) -> pd.DataFrame:
    """``doc, item, distance`` (least over all windows and hits) for words ``ids`` of documents ``docs``, each
    document's words followed by at least ``run`` zeros."""
    run, e = items.run, items.errors
    out = [pd.DataFrame({"doc": [], "item": [], "distance": []}, dtype=np.int64)]
    pad = np.concatenate([np.zeros(run + e, ids.dtype), ids, np.zeros(run + 2 * e, ids.dtype)])
    for q, p in _hits(items, ids):
        for k in range(e + 1):  # the hit as piece k of a window
            begin = p - k * items.piece
            own = items.item_of[p]
            ok = (begin >= items.first[own]) & (begin + run <= items.first[own + 1])
            w, x = begin[ok], q[ok] - k * items.piece + run  # from e words before the window's place, in the padded words
            if not len(w):
                continue
            distance = myers(items.ids[w[:, None] + np.arange(run)], pad[x[:, None] + np.arange(run + 2 * e)])
            found = pd.DataFrame({"doc": docs[q[ok]], "item": items.owner[own[ok]], "distance": distance})
            out.append(found[found["distance"] <= e].groupby(["doc", "item"], as_index=False)["distance"].min())
    return pd.concat(out).groupby(["doc", "item"], as_index=False)["distance"].min()


def _hits(items: Items, ids: np.ndarray, rows: int = 65_536) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Where pieces of items stand: places in ``ids`` and in the items, about ``rows`` at a time.

    A formula that many items share multiplies with its uses; the product is formed piece by piece, never as a whole.
    """
    h = grams(ids, items.piece)
    maybe = np.flatnonzero(items.filter[(h >> _U(42)).astype(np.int64)])
    lo, hi = np.searchsorted(items.hashes, h[maybe], "left"), np.searchsorted(items.hashes, h[maybe], "right")
    total = np.r_[0, np.cumsum(hi - lo)]
    for s in range(0, int(total[-1]), rows):
        at = np.arange(s, min(s + rows, int(total[-1])))  # numbers of hits
        use = np.searchsorted(total, at, "right") - 1
        q, p = maybe[use], items.places[lo[use] + at - total[use]]
        same = np.ones(len(q), bool)
        for j in range(items.piece):
            same &= ids[q + j] == items.ids[p + j]
        yield q[same], p[same]


def leaks(docs: DataFrame, items: DataFrame, run: int = 12, errors: int = 1, block_bytes: int = 32 << 20) -> DataFrame:
    """``doc_id, item_id, distance``: each document with a stretch of words at most ``errors`` edits from some ``run``
    consecutive words of an item, and the least such distance; 0 is a verbatim run.

    What stands in closed, unnested brackets is left out of both. Null and empty texts and items of fewer words match
    nothing; items that share a passage are reported each; a repeated document or item is reported once; an empty
    table gives an empty result. Items go to the tasks in hashed blocks of about ``block_bytes`` of text (an item is not
    cut, so one of more is a block by itself and others), as arrays that the driver makes once; the documents are read
    once per block, and no document is cut, however long.
    """
    spark = docs.sparkSession
    wanted = items.filter("item_id is not null").select("item_id", F.col("text"))
    size = wanted.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-2 * size // block_bytes) or 1  # hashed blocks come out uneven: half full on average
    rows = docs.filter("doc_id is not null and text is not null").select("doc_id", "text")
    out = None
    for block in range(blocks):
        part = wanted.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).distinct().orderBy("item_id")
        ship = spark.sparkContext.broadcast(Items([tuple(r) for r in part.collect()], run, errors))  # of block_bytes of text

        def scan(batches: Iterator[pd.DataFrame], ship=ship) -> Iterator[pd.DataFrame]:
            index = ship.value
            get, gap = index.vocabulary.get, [0] * (run + errors)

            def flush() -> pd.DataFrame:
                ids = np.array(held, np.int64)
                found = matches(index, np.repeat(np.array(owners, np.int64), lengths), ids)
                return found.rename(columns={"doc": "doc_id", "item": "item_id"}).astype("int64")

            held, owners, lengths = [], [], []
            for b in batches:
                for doc, text in zip(b["doc_id"], b["text"]):
                    before = len(held)
                    held.extend([get(w, 0) for w in words(text, brackets=False)])
                    held.extend(gap)
                    owners.append(doc)
                    lengths.append(len(held) - before)
                    if len(held) > _FLUSH_WORDS:
                        yield flush()
                        held, owners, lengths = [], [], []
            if held:
                yield flush()

        found = rows.mapInPandas(scan, "doc_id bigint, item_id bigint, distance bigint")
        out = found if out is None else out.unionByName(found)
    return out.groupBy("doc_id", "item_id").agg(F.min("distance").cast("int").alias("distance"))
