"""Filling containers of fixed capacity with documents, by minimum bin slack over the histogram of lengths.

Documents of one length are alike to the packer, so it works on how many there are of each length: at most one count
per token of capacity, however many documents. It fixes the longest length left, finds by bitset subset-sum dynamic
programming the fullest combination of available lengths with it, and fills as many containers that way as the counts
allow. The documents then find their containers by rank among those of their length.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rasterloom.common import materialize

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How the vocabulary's tokenizer cuts a text before merging: a fixed value of that public tokenizer.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def token_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """``doc_id, n_tokens`` of whole texts; null texts have none. ``vocabulary`` is a path that every executor reads."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import tiktoken

        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        enc = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "n_tokens": [len(enc.encode_ordinary(t)) if t else 0 for t in b["text"]]})

    return docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text")).mapInPandas(run, "doc_id bigint, n_tokens bigint")


def fullest(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The combination of lengths (at most ``counts`` of each) with the largest sum up to ``capacity``."""
    mask = (1 << (capacity + 1)) - 1
    reach, steps = 1, []
    for length in sorted((x for x in counts if x <= capacity and counts[x] > 0), reverse=True):
        left, lot = min(counts[length], capacity // length), 1
        while left:
            lot = min(lot, left)
            steps.append((reach, length, lot))
            reach |= (reach << (length * lot)) & mask
            left -= lot
            lot *= 2
        if reach >> capacity & 1:
            break
    total = reach.bit_length() - 1
    out: dict[int, int] = {}
    for before, length, lot in reversed(steps):
        if not before >> total & 1:
            out[length] = out.get(length, 0) + lot
            total -= length * lot
    return out


def plan(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """``(combination, containers filled that way)`` until no length is left; lengths from 1 to ``capacity``."""
    left = {k: v for k, v in counts.items() if v > 0}
    if any(not 1 <= k <= capacity for k in left):
        raise ValueError("lengths must lie between 1 and the capacity")
    out = []
    while left:
        longest = max(left)
        left[longest] -= 1
        combination = fullest(left, capacity - longest)
        left[longest] += 1
        combination[longest] = combination.get(longest, 0) + 1
        times = min(left[k] // n for k, n in combination.items())
        for k, n in combination.items():
            left[k] -= n * times
            if not left[k]:
                del left[k]
        out.append((combination, times))
    return out


def _places(steps: list[tuple[dict[int, int], int]]) -> tuple[dict[int, np.ndarray], int]:
    """By length, rows (first rank, per container, first container, token offset); the number of containers."""
    rows: dict[int, list[tuple[int, int, int, int]]] = {}
    rank: dict[int, int] = {}
    container = 0
    for combination, times in steps:
        offset = 0
        for length, n in sorted(combination.items(), reverse=True):
            rows.setdefault(length, []).append((rank.get(length, 0), n, container, offset))
            rank[length] = rank.get(length, 0) + n * times
            offset += n * length
        container += times
    return {k: np.array(v, np.int64) for k, v in rows.items()}, container


def pack(sizes: DataFrame, capacity: int = 4096, bucket_rows: int = 100_000) -> DataFrame:
    """``doc_id, piece, n_tokens, container_id, start``: each document of ``sizes`` (``doc_id, n_tokens``) in one
    container, ``start`` being its first token's place there.

    A document longer than ``capacity`` is cut into pieces of that length and a last, shorter one, from piece 0; no
    other is cut. Documents without tokens (null, empty) take no space and are spread over the containers. Null sizes
    count as 0. Repeated rows are packed each. An empty table gives an empty result.
    """
    whole, rest = F.col("n") / capacity, F.col("n") % capacity
    pieces = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(whole), F.lit(1)).cast("int") - 1), lambda i: F.struct(i.alias("piece"), F.when((i + 1) * capacity <= F.col("n"), capacity).otherwise(rest).cast("int").alias("n_tokens")))
    rows = sizes.select("doc_id", F.coalesce("n_tokens", F.lit(0)).cast("bigint").alias("n")).select("doc_id", F.explode(pieces).alias("p")).select("doc_id", "p.*")
    rows = materialize(rows, "pieces")
    counts = {r["n_tokens"]: r["n"] for r in rows.groupBy("n_tokens").agg(F.count("*").alias("n")).collect()}  # at most capacity + 1 rows
    n = sum(counts.values())
    places, containers = _places(plan({k: v for k, v in counts.items() if k}, capacity))
    ship = sizes.sparkSession.sparkContext.broadcast((places, max(containers, 1)))

    # Ranks among those of one length, without one task seeing them all: hashed buckets, their counts summed up.
    buckets = max(8, n // bucket_rows)
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)).cast("int"))
    first = rows.groupBy("n_tokens", "bucket").agg(F.count("*").alias("c"))
    before = Window.partitionBy("n_tokens").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = first.select("n_tokens", "bucket", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("first"))
    inside = F.row_number().over(Window.partitionBy("n_tokens", "bucket").orderBy("doc_id", "piece"))
    ranked = rows.withColumn("r", inside).join(first, ["n_tokens", "bucket"]).select("doc_id", "piece", "n_tokens", (F.col("first") + F.col("r") - 1).alias("rank"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        places, containers = ship.value
        for b in batches:
            rank = b["rank"].to_numpy()
            at, start = rank % containers, np.zeros(len(b), np.int64)
            for length, rows in b.groupby("n_tokens").indices.items():
                if length:
                    t, r = places[length], rank[rows]
                    k = np.searchsorted(t[:, 0], r, "right") - 1
                    d = r - t[k, 0]
                    at[rows] = t[k, 2] + d // t[k, 1]
                    start[rows] = t[k, 3] + d % t[k, 1] * length
            yield b[["doc_id", "piece", "n_tokens"]].assign(container_id=at, start=start)

    return ranked.mapInPandas(run, "doc_id bigint, piece int, n_tokens int, container_id bigint, start bigint")


def containers(packed: DataFrame, capacity: int = 4096) -> DataFrame:
    """``container_id, n_items, used, unused`` of the result of :func:`pack`."""
    return packed.groupBy("container_id").agg(F.count("*").alias("n_items"), F.sum("n_tokens").alias("used")).withColumn("unused", F.lit(capacity) - F.col("used"))
