"""What an export says of itself: per model, per point, on resuming and on failure; and loading it again.

Results are rows ``model, point_index, status, error, embedding, meta``. Arrays stay columns; what a file format needs to
know of them (stacked or ragged, which rows failed and why) is an aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.operators import export, guards


def packed(results: DataFrame) -> DataFrame:
    """``model, n_items, layout, dim, indices, failed_indices, errors_by_index, status``, a row per model.

    ``stacked``: every point is there and all vectors are equally long; else ``ragged`` with the ``indices`` of those there.
    """
    ok = (F.lower("status") == "ok") & F.col("embedding").isNotNull()
    size = F.when(ok, F.size("embedding"))
    at = F.when(ok, F.col("point_index"))
    bad = F.when(~F.coalesce(ok, F.lit(False)), F.struct("point_index", F.coalesce("error", F.lit("no embedding")).alias("error")))
    rows = results.groupBy("model").agg(
        (F.max("point_index") + 1).alias("n_items"), F.count("*").alias("n"), F.min(size).alias("lo"), F.max(size).alias("hi"),
        F.array_sort(F.collect_list(at)).alias("indices"), F.array_sort(F.collect_list(bad)).alias("bad"),
    )
    whole = (F.size("bad") == 0) & (F.col("lo") == F.col("hi")) & (F.col("n") == F.col("n_items"))
    status = export.status_of(F.col("n"), F.size("bad"), F.lit(0))
    return rows.select(
        "model", "n_items", F.when(whole, "stacked").otherwise("ragged").alias("layout"), F.when(F.col("lo") == F.col("hi"), F.col("lo")).alias("dim"), "indices",
        F.transform("bad", lambda b: b["point_index"]).alias("failed_indices"), F.map_from_entries("bad").alias("errors_by_index"), status.alias("status"),
    )


def by_point(results: DataFrame) -> DataFrame:
    """``point_index, models, status``: per point each model's status, error, length and digest, models in order of name."""
    digest = F.when(F.col("embedding").isNotNull(), guards.array_digest(F.col("embedding")))
    one = F.struct("model", "status", "error", F.when(F.col("embedding").isNotNull(), F.size("embedding")).alias("dim"), digest.alias("sha1"))
    rows = results.groupBy("point_index").agg(F.array_sort(F.collect_list(one)).alias("models"))
    failed = F.size(F.filter("models", lambda m: F.lower(m["status"]) == "failed"))
    partial = F.size(F.filter("models", lambda m: F.lower(m["status"]) == "partial"))
    return rows.withColumn("status", export.status_of(F.size("models"), failed, partial))


def manifest_order() -> Column:
    """The order of manifests: by point, those without one first."""
    return F.coalesce(F.col("point_index"), F.lit(-1))


def resumed(requests: DataFrame, done: DataFrame, by: list[str]) -> DataFrame:
    """Of ``requests`` the rows found stored: ``skipped``, with the reason."""
    return requests.join(done.select(*by).distinct(), by, "left_semi").withColumn("status", F.lit("skipped")).withColumn("reason", F.lit("stored under the same fingerprint"))


def failures(results: DataFrame, stage: str) -> DataFrame:
    """Failure rows ``point_index, model, stage, error, error_kind`` of what did not come about."""
    bad = results.filter(F.lower("status") == "failed")
    return bad.select("point_index", "model", F.lit(stage).alias("stage"), F.coalesce("error", F.lit("unknown")).alias("error"), guards.error_kind(F.col("error")).alias("error_kind"))


def models_of(results: DataFrame, status: str) -> DataFrame:
    """The models whose rolled-up status is ``status``, sorted by name."""
    return export.model_rollup(results, ["model"]).filter(F.col("status") == status).select("model").orderBy("model")


def embedding_of(results: DataFrame, model: str) -> DataFrame:
    """``point_index, embedding`` of a model, every point from 0; KeyError if the export has no such model, ValueError if
    nothing of it came about."""
    mine = results.filter(F.col("model") == model)
    seen = mine.agg(F.count("*").alias("n"), F.count("embedding").alias("ok")).first()
    if not seen["n"]:
        raise KeyError(f"the export has no model {model!r}")
    if not seen["ok"]:
        raise ValueError(f"the export has no embedding of {model!r}")
    return export.aligned(mine, ["model"]).select("point_index", "embedding")


def point_of(name: Column, manifest_index: Column) -> Column:
    """The point of an item's file: what its manifest says, else the digits of ``p00007``; null for other files."""
    return F.coalesce(manifest_index.cast("int"), F.regexp_extract(name, r"^p(\d+)(\.[a-z]+)?$", 1).try_cast("int"))


def per_item(files: DataFrame) -> DataFrame:
    """``files`` (``name, manifest_index`` and more) of an item directory with their ``point_index``: files of no point are
    left out, two of one point stop the query."""
    rows = files.withColumn("point_index", point_of(F.col("name"), F.col("manifest_index"))).filter("point_index is not null")
    n = rows.groupBy("point_index").agg(F.count("*").alias("__n"))
    stop = F.raise_error(F.concat(F.lit("two files of point "), F.col("point_index").cast("string"))).cast("int")
    return rows.join(n, "point_index").withColumn("point_index", F.when(F.col("__n") > 1, stop).otherwise(F.col("point_index"))).drop("__n")


def ragged_rows(arrays: DataFrame, entries: DataFrame) -> DataFrame:
    """``model, point_index, embedding``: arrays (``key, value``) of models (``entries``: ``model, base, n_items, indices``)
    stored one by one. A key's point is its place in ``indices``, else its trailing digits ``__00007``; a point without an
    array has null, and so have all of a model whose arrays differ in length."""
    number = F.regexp_extract("key", r"__(\d+)$", 1).try_cast("int")
    base = F.regexp_replace("key", r"__\d+$", "")
    rows = arrays.select(base.alias("base"), number.alias("no"), "value").filter("no is not null").join(entries, "base")
    place = F.when(F.size("indices") > 0, F.try_element_at("indices", F.col("no") + 1)).otherwise(F.col("no"))
    rows = rows.select("model", place.alias("point_index"), "value")
    size = rows.groupBy("model").agg((F.min(F.size("value")) == F.max(F.size("value"))).alias("even"))
    every = entries.select("model", F.explode(F.sequence(F.lit(0), F.col("n_items") - 1)).alias("point_index"))
    return every.join(rows, ["model", "point_index"], "left").join(size, "model", "left").select("model", "point_index", F.when(F.col("even"), F.col("value")).alias("embedding"))


def without(arrays: DataFrame, removed: DataFrame, base: str = "base") -> DataFrame:
    """``arrays`` (``key``) without those of removed models: keys equal to a base or beginning with it and ``__``."""
    stem = F.explode(F.array_distinct(F.array(F.col("key"), *[F.substring_index("key", "__", n) for n in range(1, 5)])))
    hit = arrays.select("key", stem.alias("__stem")).join(removed.select(F.col(base).alias("__stem")), "__stem", "left_semi").select("key").distinct()
    return arrays.join(hit, "key", "left_anti")


def complete(stored: DataFrame, arrays: DataFrame) -> DataFrame:
    """Of stored models (``model, status, keys array``) those to be kept on resuming: ok, and every array is there."""
    need = stored.filter(F.lower("status") == "ok").select("model", "keys", F.explode("keys").alias("key"))
    have = need.join(arrays.select("key").distinct(), "key", "left_semi").groupBy("model").agg(F.count("*").alias("n"))
    return stored.join(have, "model").filter(F.col("n") == F.size("keys")).select("model")


def in_request_order(requests: DataFrame, done: DataFrame, order: str = "pos") -> DataFrame:
    """Models asked for and not done yet; ``pos`` keeps the order of the request."""
    return requests.join(done.select("model"), "model", "left_anti").orderBy(order)
