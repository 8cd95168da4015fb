"""Checks that stop or report, counters, retries, and metadata of results."""

from __future__ import annotations

import time
import warnings
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

# Texts by which a failed scan is told apart.
TOO_MANY_PIXELS = ("too many pixels in sample",)
NOT_ALLOWED = ("permission", "not authorized", "unauthenticated", "credentials")
META_KEYS = ("model", "type", "backend", "source", "sensor", "temporal", "image_size")


def required(df: DataFrame, what: str) -> DataFrame:
    """``df``, with a row that raises where ``df`` is empty: nothing is counted beforehand.

    The check looks for one row and runs with the query.
    """
    n = df.limit(1).agg(F.count("*").alias("n"))
    # In the filter, so that it is evaluated whatever columns are asked for.
    stop = n.filter(F.when(F.col("n") == 0, F.raise_error(F.lit(f"no {what} for the region and window")).cast("boolean")).otherwise(F.lit(False)))
    return df.unionByName(stop.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema]))


def digital_numbers(v: Column) -> Column:
    """Aggregate: the values look scaled to 0..2 already, not like digital numbers."""
    return (F.min(v) >= 0) & (F.max(v) <= 2)


def error_kind(message: Column) -> Column:
    m = F.lower(F.coalesce(message, F.lit("")))
    has = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: m.contains(w))
    return F.when(m == "", "none").when(has(TOO_MANY_PIXELS), "too_large").when(has(NOT_ALLOWED), "access").otherwise("other")


def counted(df: DataFrame, name: str, failed: Column, cached: Column | None = None) -> tuple[DataFrame, Observation]:
    """``df`` and an observation of ``total``, ``completed``, ``failed`` and ``cache_hits`` rows, filled by the query itself
    when it runs."""
    o = Observation(name)
    n = lambda c: F.coalesce(F.count_if(c), F.lit(0))
    bad = F.coalesce(failed, F.lit(False))
    return df.observe(o, F.count("*").alias("total"), n(~bad).alias("completed"), n(bad).alias("failed"), n(F.lit(False) if cached is None else cached).alias("cache_hits")), o


def counted_text(counts: dict[str, int]) -> str:
    return f"{counts['total']} fetched: {counts['completed']} ok, {counts['failed']} failed, {counts['cache_hits']} from the cache"


def retried(f: Callable, retries: int = 0, backoff_s: float = 0.0):
    """``f()``, tried again after waits that double; the last error stands. For calls inside a task's function."""
    for attempt in range(retries + 1):
        try:
            return f()
        except Exception:
            if attempt == retries:
                raise
            time.sleep(backoff_s * 2**attempt)


def result_meta(**given: Column) -> Column:
    """A result's metadata: the seven keys, null where not given, and the rest under ``extra`` as text."""
    unknown = {k: v for k, v in given.items() if k not in META_KEYS}
    pairs = [x for k, v in sorted(unknown.items()) for x in (F.lit(k), v.cast("string"))]
    extra = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
    return F.struct(*[given.get(k, F.lit(None)).cast("string").alias(k) for k in META_KEYS], extra.alias("extra"))


def array_digest(values: Column) -> Column:
    """sha1 of an array's length and values as text: equal arrays, equal digests."""
    return F.sha1(F.concat(F.size(values).cast("string"), F.lit(":"), F.array_join(F.transform(values, lambda v: v.cast("string")), ",", "null")))


def effective_backend(model_type: Column, backend: Column) -> Column:
    """Products are read the same way under any backend; models keep theirs, ``auto`` where there is none."""
    from rasterloom.functions.strings import or_auto

    b = or_auto(backend)
    return F.when((model_type == "precomputed") & b.isin("auto", "local"), "auto").otherwise(b)


def indices_in(values: Column, n: int) -> Column:
    """Channel numbers as they count: negative ones from the end, those out of range and repeats left out."""
    wrapped = F.transform(values, lambda i: F.when(i < 0, i + n).otherwise(i))
    return F.array_distinct(F.filter(wrapped, lambda i: (i >= 0) & (i < n)))


def array_sha1(values: Column) -> Column:
    """sha1 of an array's type, shape and bytes (the first 2,000,000), as of a one-dimensional float32 array."""

    @F.pandas_udf("string")
    def digest(v: pd.Series) -> pd.Series:
        import hashlib

        def one(x) -> str | None:
            if x is None:
                return None
            a = np.ascontiguousarray(x, np.float32)
            h = hashlib.sha1(str(a.dtype).encode())
            h.update(str(a.shape).encode())
            h.update(a.tobytes()[:2_000_000])
            return h.hexdigest()

        return v.map(one)

    return digest(values)


def error_text(e: BaseException, depth: int = 6) -> str:
    """The messages of an exception and those it came from, with what to do about a refused access."""
    said: list[str] = []
    while e is not None and depth:
        text = f"{type(e).__name__}: {e}".rstrip(": ")
        if text not in said:
            said.append(text)
        e, depth = e.__cause__ or e.__context__, depth - 1
    out = " <- ".join(said)
    if any(w in out.lower() for w in NOT_ALLOWED):
        out += " (is the account signed in, and is the project set?)"
    return out


def finite_weights(values: DataFrame, value: str = "value", near_zero: bool = False) -> DataFrame:
    """``ok, why`` of a model's first parameters: some are there, all are finite and, if asked, not all about 0."""
    v = F.col(value)
    fine = v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    flat = F.lit(near_zero) & (F.coalesce(F.stddev_pop(v), F.lit(0.0)) < 1e-6) & (F.max(F.abs(v)) < 1e-5)
    why = F.when(F.count("*") == 0, "no parameters").when(F.count_if(~F.coalesce(fine, F.lit(False))) > 0, "not finite").when(flat, "about zero")
    return values.agg(why.alias("why")).withColumn("ok", F.col("why").isNull())


def warn(text: str) -> None:
    """A warning of the library: plain text, once per place, with the caller's line."""
    warnings.warn(text, UserWarning, stacklevel=3)
