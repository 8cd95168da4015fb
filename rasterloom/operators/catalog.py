"""Bands, sensors and models as small tables, and what requests need of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.functions import strings

# Names of bands by sensor family, and the band of the product they stand for.
S2_BANDS = {
    "BLUE": "B2", "GREEN": "B3", "RED": "B4", "NIR": "B8", "NIR_BROAD": "B8", "NIR_WIDE": "B8",
    "NIR_NARROW": "B8A", "NIRN": "B8A", "NIRNARROW": "B8A", "NIR_N": "B8A",
    "RE1": "B5", "RED_EDGE_1": "B5", "RE2": "B6", "RED_EDGE_2": "B6", "RE3": "B7", "RED_EDGE_3": "B7", "RE4": "B8A", "RED_EDGE_4": "B8A",
    "SWIR1": "B11", "SWIR_1": "B11", "SWIR2": "B12", "SWIR_2": "B12",
}
LANDSAT89_BANDS = {"BLUE": "SR_B2", "GREEN": "SR_B3", "RED": "SR_B4", "NIR": "SR_B5", "SWIR1": "SR_B6", "SWIR2": "SR_B7"}
LANDSAT457_BANDS = {"BLUE": "SR_B1", "GREEN": "SR_B2", "RED": "SR_B3", "NIR": "SR_B4", "SWIR1": "SR_B5", "SWIR2": "SR_B7"}
FAMILIES = {"S2": S2_BANDS, "L89": LANDSAT89_BANDS, "L457": LANDSAT457_BANDS}
MODALITIES = {"sentinel1": "s1", "sentinel-1": "s1", "sentinel2": "s2", "sentinel-2": "s2"}


def aliases(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(f, a, b) for f, m in FAMILIES.items() for a, b in m.items()], "family string, alias string, native string")


def native_bands(bands: DataFrame) -> DataFrame:
    """``bands`` (``family, band``) with ``native``: the alias in any case, else the band as it is."""
    found = F.broadcast(aliases(bands.sparkSession))  # a few dozen fixed rows
    return bands.join(found, (bands["family"] == found["family"]) & (F.upper(bands["band"]) == found["alias"]), "left").select(*[bands[c] for c in bands.columns], F.coalesce("native", bands["band"]).alias("native"))


def fetch_plan(members: DataFrame) -> DataFrame:
    """``members`` (``model, collection, semantics, pos, bands``) with ``fetch_bands`` and ``channels``: members that
    scan alike share one scan of the union of their bands, in order of first use, and take their channels from it."""
    group = ["collection", "semantics"]
    use = members.select(*group, "pos", F.posexplode("bands").alias("i", "band"))
    first = use.groupBy(*group, "band").agg(F.min(F.struct("pos", "i")).alias("at"))
    union = first.groupBy(*group).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "band"))), lambda x: x["band"]).alias("fetch_bands"))
    return members.join(union, group).withColumn("channels", F.transform("bands", lambda b: (F.array_position(F.col("fetch_bands"), b) - 1).cast("int")))


def select_channels(values, channels):
    """The channels of an array column, in the wanted order."""
    return F.transform(channels, lambda i: F.element_at(values, i + 1))


def missing_bands(wanted, present):
    return F.array_except(wanted, present)


def overridden(override: str, base: str, fields: tuple[str, ...] = ("scale_m", "cloudy_pct", "fill_value", "composite")):
    """A sensor with the fields of an override that are not null."""
    return F.struct(*[F.coalesce(F.col(f"{override}.{f}"), F.col(f"{base}.{f}")).alias(f) for f in fields])


def modality(name):
    return strings.canonical(name, MODALITIES)


def duplicates(names: DataFrame, name: str) -> DataFrame:
    """Names that are one after sanitising."""
    return names.groupBy(strings.sanitized(F.col(name)).alias("key")).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(name)).alias("names")).filter("n > 1")


def supported(requests: DataFrame, catalog: DataFrame) -> DataFrame:
    """``requests`` with ``support``: ok, or what the model's catalog row lacks."""
    rows = requests.join(catalog, "model", "left")
    why = F.when(F.col("outputs").isNull(), "unknown model").when(~F.array_contains("outputs", F.col("output")), "output").when(~F.array_contains("backends", F.col("backend")), "backend").otherwise("ok")
    return rows.withColumn("support", why).select(*requests.columns, "support")


def chunks(rows: DataFrame, order: str, size: int = 16) -> DataFrame:
    """``rows`` with ``chunk`` and ``place``: consecutive groups of ``size`` in order of ``order`` (dense from 0).

    ``order`` is a dense number, so this is arithmetic, not a global window.
    """
    return rows.withColumn("chunk", F.floor(F.col(order) / size)).withColumn("place", F.col(order) % size)


def first_by(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Whose input a row reuses: ``owner`` is the first of its key, ``reused`` says it is another. An aggregate and a join,
    so a key that many rows share is no task's alone."""
    first = rows.groupBy(key).agg(F.min(order).alias("owner"))
    return rows.join(first, key).withColumn("reused", F.col("owner") != F.col(order))


def listed(rows: DataFrame, key: str, *columns: str) -> DataFrame:
    """A catalog table sorted by its key, each key once; rows without one are left out."""
    return rows.filter(F.col(key).isNotNull()).groupBy(key).agg(*[F.min(c).alias(c) for c in columns]).orderBy(key)
