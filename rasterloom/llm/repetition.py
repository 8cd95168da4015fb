"""Repetition inside a document: its share of repeated runs, counted, and boosted trees that judge it by other statistics.

The trees never see the share they are to tell: they score a document by its repeated pairs, long runs, lines and
sentences. A rule with an exact limit cannot come from such a score, so the count decides what is reported as repetitive.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.llm import gbt
from rasterloom.llm.text import resolved, words_in

FEATURES = ("share_pairs", "share_long_runs", "share_lines", "share_sentences", "share_top_word", "share_distinct", "log_words")
#: The score must not fall as more of a text repeats.
RISING = (0, 1, 2, 3)
_SENTENCE = re.compile(r"[.!?]+\s+|\n+")


def _ranks(ids: np.ndarray, n: int) -> np.ndarray:
    """A number per run of ``n`` ids, equal for equal runs: exact, by ranking doubled runs."""
    have, cur = 1, ids
    while have < n:
        step = min(have, n - have)
        m = len(cur) - step
        if m <= 0:
            return cur[:0]
        cur = np.unique(cur[:m] * (int(cur.max()) + 1) + cur[step : step + m], return_inverse=True)[1]
        have += step
    return cur


def _share_again(parts: list[str]) -> float:
    """The share of characters in parts that occurred before."""
    total = again = 0
    seen = set()
    for p in parts:
        p = p.strip()
        if p:
            total += len(p)
            again += len(p) if p in seen else 0
            seen.add(p)
    return again / total if total else 0.0


def _share_runs(ids: np.ndarray, n: int) -> tuple[int, float]:
    """How many runs of ``n`` words already occurred earlier, and their share of all runs."""
    runs = _ranks(ids, n)
    again = len(runs) - (int(runs.max()) + 1) if len(runs) else 0
    return again, again / len(runs) if len(runs) else 0.0


def statistics(text: str | None, run: int = 5) -> tuple[int, int, np.ndarray]:
    """Number of words, of runs that already occurred earlier, and the features."""
    text = resolved(text) if text else ""
    w = words_in(text)
    n = len(w)
    x = np.zeros(len(FEATURES))
    if not n:
        return 0, 0, x
    known: dict[str, int] = {}
    ids = np.array([known.setdefault(a, len(known)) for a in w], np.int64)
    again, _ = _share_runs(ids, run)
    x[0], x[1] = _share_runs(ids, 2)[1], _share_runs(ids, 2 * run)[1]
    x[2] = _share_again(text.split("\n"))
    x[3] = _share_again(_SENTENCE.split(text))
    x[4] = np.bincount(ids).max() / n
    x[5] = len(known) / n
    x[6] = math.log(n)
    return n, again, x


def _measured(docs: DataFrame, run: int) -> DataFrame:
    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [statistics(t, run) for t in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"], "n_words": [r[0] for r in rows], "n_again": [r[1] for r in rows], "x": [r[2] for r in rows]})

    rows = docs.filter("doc_id is not null").select("doc_id", "text")
    return rows.mapInPandas(measure, "doc_id bigint, n_words bigint, n_again bigint, x array<double>")


def _labelled(docs: DataFrame, least: float, least_words: int, run: int, sample_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels (1: ``least`` of the runs occurred before) of about ``sample_rows`` documents of at least
    ``least_words`` words, never more than twice as many, drawn by a hash of their id."""
    n = docs.count()
    share = min(1.0, sample_rows / n) if n else 1.0
    drawn = docs.filter(F.pmod(F.xxhash64("doc_id", F.lit(13)), F.lit(1 << 20)) < math.ceil(share * (1 << 20)))
    got = _measured(drawn, run).limit(2 * sample_rows).toPandas().sort_values("doc_id")
    got = got[got.n_words >= max(least_words, run)]
    x = np.stack(got.x.to_numpy()) if len(got) else np.zeros((0, len(FEATURES)))
    return x, (got.n_again >= least * (got.n_words - run + 1) - 1e-9).to_numpy().astype(float)


def train(docs: DataFrame, least: float = 0.3, least_words: int = 30, run: int = 5, sample_rows: int = 4000) -> gbt.Trees:
    """Trees fitted on the labelled sample, see :func:`held_out` for how well they tell."""
    return gbt.fit(*_labelled(docs, least, least_words, run, sample_rows), RISING)


def held_out(docs: DataFrame, least: float = 0.3, least_words: int = 30, run: int = 5, sample_rows: int = 4000) -> tuple[float, float]:
    """Precision and recall of ``likely`` on the second half of the labelled sample, the trees fitted on the first."""
    x, y = _labelled(docs, least, least_words, run, sample_rows)
    half = len(x) // 2
    guess = gbt.fit(x[:half], y[:half], RISING).score(x[half:]) >= 0
    both = float((guess & (y[half:] > 0)).sum())
    return both / max(1, guess.sum()), both / max(1.0, y[half:].sum())


def repetition(docs: DataFrame, least: float = 0.3, least_words: int = 30, run: int = 5) -> DataFrame:
    """``doc_id, n_words, n_again, share, repetitive`` of every document, by counting.

    ``share`` is that of its runs of ``run`` words that already occurred earlier in it (0 where it has none);
    ``repetitive`` are those of ``least`` or more and ``least_words`` words. Null and empty texts have no words and
    share 0; a repeated row is reported each time; rows without doc_id are left out; an empty table gives an empty result.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for text in b["text"]:
                known: dict[str, int] = {}
                ids = np.array([known.setdefault(a, len(known)) for a in words_in(resolved(text))] if text else [], np.int64)
                rows.append((len(ids), *_share_runs(ids, run)))
            n, again, share = (np.array([r[i] for r in rows]) for i in range(3))
            yes = (n >= least_words) & (n >= run) & (again >= least * np.maximum(n - run + 1, 1) - 1e-9)
            yield pd.DataFrame({"doc_id": b["doc_id"], "n_words": n, "n_again": again, "share": share, "repetitive": yes})

    rows = docs.filter("doc_id is not null").select("doc_id", "text")
    return rows.mapInPandas(count, "doc_id bigint, n_words bigint, n_again bigint, share double, repetitive boolean")


def scores(docs: DataFrame, least: float = 0.3, least_words: int = 30, run: int = 5, sample_rows: int = 4000) -> DataFrame:
    """``doc_id, score, likely`` of every document: the trees' log-odds that it repeats itself, and whether they are
    positive for a text of ``least_words`` words. Cases as in :func:`repetition`; a table without repetitive documents in
    the sample gives one low score to all."""
    ship = docs.sparkSession.sparkContext.broadcast(train(docs, least, least_words, run, sample_rows))

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [statistics(t, run) for t in b["text"]]
            score = ship.value.score(np.stack([r[2] for r in rows]) if rows else np.zeros((0, len(FEATURES))))
            yield pd.DataFrame({"doc_id": b["doc_id"], "score": score, "likely": (score >= 0) & (np.array([r[0] for r in rows], np.int64) >= least_words)})

    return docs.filter("doc_id is not null").select("doc_id", "text").mapInPandas(judge, "doc_id bigint, score double, likely boolean")
