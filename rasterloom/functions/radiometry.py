"""Radiometric scaling. Per-band statistics are joined as a small table, per-image ones are windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Per-band mean and standard deviation of public sensor-normalisation tables, in the band order given.
BAND_STATS = {
    "s2_ten_a": (
        ("B2", "B3", "B4", "B5", "B6", "B7", "B8", "B8A", "B11", "B12"),
        (1105.0, 1355.0, 1552.0, 1887.0, 2422.0, 2630.0, 2743.0, 2785.0, 2388.0, 1835.0),
        (1809.0, 1757.0, 1888.0, 1870.0, 1732.0, 1697.0, 1742.0, 1648.0, 1470.0, 1379.0),
    ),
    "s2_ten_unit": (
        ("B2", "B3", "B4", "B5", "B6", "B7", "B8", "B8A", "B11", "B12"),
        (0.17662, 0.195923, 0.213948, 0.263378, 0.300818, 0.313144, 0.308133, 0.320993, 0.22155, 0.175772),
        (0.26452, 0.252949, 0.25918, 0.272771, 0.248175, 0.235432, 0.226434, 0.223274, 0.171606, 0.156223),
    ),
    "s2_ten_agri": (
        ("B2", "B3", "B4", "B5", "B6", "B7", "B8", "B8A", "B11", "B12"),
        (4179.192015478227, 4065.9106675194444, 3957.274910960156, 5207.452475253116, 4327.12234687, 4873.16102239, 5049.1637925, 5111.07806856, 3056.86349163, 2490.9675032),
        (4041.5212325268735, 3691.003119315892, 3629.331318356375, 2973.5178530908756, 3569.73343885, 3085.9151435, 2937.56005119, 2806.04462314, 1808.30013156, 1694.20220774),
    ),
    "s2_nine_255": (
        ("B4", "B3", "B2", "B5", "B6", "B7", "B8", "B11", "B12"),
        (114.1099739, 114.81779093, 126.63977424, 84.33539309, 97.84789168, 103.94461911, 101.435633, 72.32804172, 56.66528851),
        (77.84352553, 69.96844919, 67.42465279, 64.57022983, 61.72545487, 61.34187099, 60.29744676, 47.88519516, 42.55886798),
    ),
    "s2_twelve_v1": (
        ("B1", "B2", "B3", "B4", "B5", "B6", "B7", "B8", "B8A", "B9", "B11", "B12"),
        (1390.458, 1503.317, 1718.197, 1853.91, 2199.1, 2779.975, 2987.011, 3083.234, 3132.22, 3162.988, 2424.884, 1857.648),
        (2106.761, 2141.107, 2038.973, 2134.138, 2085.321, 1889.926, 1820.257, 1871.918, 1753.829, 1797.379, 1434.261, 1334.311),
    ),
    "s2_twelve_v01": (
        ("B1", "B2", "B3", "B4", "B5", "B6", "B7", "B8", "B8A", "B9", "B11", "B12"),
        (794.311, 925.161, 1183.128, 1338.041, 1667.254, 2233.633, 2460.96, 2555.569, 2619.542, 2703.298, 2406.497, 1841.645),
        (1164.883, 1205.586, 1223.713, 1399.638, 1403.298, 1378.513, 1434.924, 1491.141, 1454.089, 1660.395, 1473.248, 1365.08),
    ),
    "imagenet": (("B4", "B3", "B2"), (0.485, 0.456, 0.406), (0.229, 0.224, 0.225)),
    "fmow": (("B4", "B3", "B2"), (0.4182007312774658, 0.4214799106121063, 0.3991275727748871), (0.28774282336235046, 0.27541765570640564, 0.2764017581939697)),
}
# Means and standard deviations of a public pre-training set, by how many channels a group of inputs has, in order.
CHANNEL_STATS = {
    13: (
        (-11.728724389184965, -18.85558188024017, 1395.3408730676722, 1338.4026921784578, 1343.09883810357, 1543.8607982512297, 2186.2022069512263, 2525.0932853316694, 2410.3377187373408, 2750.2854646886753, 2234.911100061487, 1474.5311266077113, 0.2892116502999044),
        (4.887145774840316, 5.730270320384293, 917.7041440370853, 913.2988423581528, 1092.678723527555, 1047.2206083460424, 1048.0101611156767, 1143.6903026819996, 1098.979177731649, 1204.472755085893, 1145.9774063078878, 980.2429840007796, 0.2720939024500081),
    ),
    16: (
        (673.0152819503361, 5.930092668915115, 0.10470439140978786, 0.23965913270066183, 0.08158044385860364, 0.04246976254259546, 0.11304392863520317, 0.17329647890362473, 0.0698981691616277, 0.12130267132802142, 0.04671318615236216, 10.973119802517362, 1.0927069179958768, 1.6991394232855903, 0.03720594618055555, 1.3671352688259548),
        (983.0697298296237, 8.167406789813247, 0.18771647977504985, 0.2368313455675914, 0.08024268534756586, 0.04045374496146404, 0.11350342472061795, 0.1279898111718168, 0.12042341550438586, 0.13602408145504347, 0.043971116096060345, 31.255340146970997, 10.395974878206689, 12.92380617159917, 1.9285254295940466, 11.612179775408928),
    ),
    6: (
        (271.5674963541667, 0.08554303677156568, 657.3181260091111, 692.1291795806885, 562.781331880633, 1.5647115934036673),
        (79.80828940314429, 0.11669547098151486, 704.0008695557707, 925.0116126406431, 453.2434022278578, 7.513020170832818),
    ),
    18: (
        (188.20315880851746, 0.2804946561574936, 0.11371652073860168, 0.058778801321983334, 0.10474256777763366, 0.2396918488264084, 0.08152248692512512, 0.04248040814399719, 0.11303179881572724, 0.17326324067115784, 0.06998309404850006, 0.12122812910079957, 0.04671641788482666, 10.98456594619751, 1.0968475807189941, 1.6947754135131836, 0.03320046615600586, 1.3602827312469483),
        (1154.5919128300602, 0.5276998078079327, 0.7021637331734328, 0.36528892213195063, 0.17470213191865785, 0.20411195416718833, 0.0660782470089761, 0.03380702424871257, 0.09809195568521663, 0.11292471052124119, 0.09720748930233268, 0.12912217763726777, 0.0399973913151906, 23.725471823867462, 5.715238079725388, 9.030481416228302, 0.9950220242487364, 7.754429123862099),
    ),
}
# Central wavelengths of the bands in micrometres.
WAVELENGTHS = {"B1": 0.443, "B2": 0.490, "B3": 0.560, "B4": 0.665, "B5": 0.705, "B6": 0.740, "B7": 0.783, "B8": 0.842, "B8A": 0.865, "B9": 0.945, "B11": 1.610, "B12": 2.190}


def band_stats(spark: SparkSession, name: str) -> DataFrame:
    bands, mean, std = BAND_STATS[name]
    return spark.createDataFrame(list(zip(bands, mean, std)), "band string, mean double, std double")


def clip(v: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.least(v, F.lit(hi)), F.lit(lo))


def cleaned(v: Column) -> Column:
    """Null and NaN as 0, infinities at the ends of the digital range."""
    return F.nanvl(F.coalesce(v, F.lit(0.0)), F.lit(0.0))


def digital(v: Column) -> Column:
    return clip(cleaned(v), 0.0, 10000.0)


def unit(v: Column) -> Column:
    return digital(v) / 10000


def zscore(rows: DataFrame, stats: DataFrame, value: Column, eps: float = 0.0) -> DataFrame:
    """``rows`` with ``z``, by its band's statistics; null for a band without. The statistics are one row per band."""
    std = F.greatest("std", F.lit(eps)) if eps else F.col("std")
    return rows.join(F.broadcast(stats), "band", "left").withColumn("z", (value - F.col("mean")) / std).drop("mean", "std")


def zscore_channels(values: Column, n: int, eps: float = 1.1920929e-07) -> Column:
    """An array of ``n`` channels by the statistics for that many; ValueError where there are none."""
    if n not in CHANNEL_STATS:
        raise ValueError(f"no statistics for {n} channels; there are some for {', '.join(map(str, CHANNEL_STATS))}")
    mean, std = (F.array(*[F.lit(float(x)) for x in v]) for v in CHANNEL_STATS[n])
    return F.transform(values, lambda v, i: (v - F.element_at(mean, i + 1)) / F.greatest(F.element_at(std, i + 1), F.lit(eps)))


_own: dict = {}


def register_normaliser(name: str, f) -> None:
    """A scaling by its name in :func:`normalised`: ``f(rows, value)`` adds ``z``. For those whose statistics are not public."""
    _own[name] = f


def wavelengths(bands: Column) -> Column:
    """The bands' wavelengths in order; null if one of them has none."""
    known = F.create_map(*[F.lit(x) for kv in WAVELENGTHS.items() for x in kv])
    out = F.transform(bands, lambda b: F.try_element_at(known, b))
    return F.when(~F.exists(out, lambda v: v.isNull()), out)


def normalised(rows: DataFrame, how: str, spark: SparkSession, value: str = "value", keys: tuple[str, ...] = ("point_index",)) -> DataFrame:
    """``rows`` (``keys, band, value``) with ``z``, scaled as a model's catalog entry says.

    ``none``: values, no number as 0; ``raw``: clipped digital numbers; ``unit``: over 10,000; ``tile_minmax`` and
    ``tile_zscore``: by the image's own bands; ``rgb8`` and ``rgb8_minmax``: 0..255, the latter between the image's extremes
    over all bands; ``imagenet``, ``fmow``: unit values by the table; other names are tables of ``BAND_STATS`` for digital
    numbers, 0..255 (``_255``) or unit values (``_unit``). A band that a table lacks has null.
    """
    v = F.col(value)
    if how in _own:
        return _own[how](rows, value)
    if how in ("none", "raw", "unit", "rgb8"):
        return rows.withColumn("z", {"none": cleaned(v), "raw": digital(v), "unit": unit(v), "rgb8": rgb8(cleaned(v)).cast("double")}[how])
    if how == "tile_zscore":
        return zscore_tile(rows, [*keys, "band"], value)
    if how == "tile_minmax":
        return minmax_tile(rows, [*keys, "band"], unit(v)).withColumnRenamed("scaled", "z")
    if how == "rgb8_minmax":
        ends = rows.groupBy(*keys).agg(F.min(cleaned(v)).alias("__lo"), F.max(cleaned(v)).alias("__hi"))
        z = F.when(F.col("__hi") > F.col("__lo"), (cleaned(v) - F.col("__lo")) / (F.col("__hi") - F.col("__lo"))).otherwise(F.lit(0.0))
        return rows.join(ends, list(keys)).withColumn("z", F.floor(clip(z, 0.0, 1.0) * 255).cast("double")).drop("__lo", "__hi")
    if how not in BAND_STATS:
        raise ValueError(f"no normalisation {how!r}")
    if how.endswith("_unit"):
        x = unit(v)
    elif how.endswith("_255"):
        x = unit(v) * 255
    elif how in ("imagenet", "fmow"):
        x = rgb8(cleaned(v)) / 255.0
    else:
        x = digital(v)
    return zscore(rows, band_stats(spark, how), x, 1e-6)


def zscore_tile(rows: DataFrame, keys: list[str], value: str = "value", eps: float = 1e-6) -> DataFrame:
    """``z`` by the mean and population deviation of each image and band; null becomes 0."""
    w = Window.partitionBy(*keys)
    z = (F.col(value) - F.avg(value).over(w)) / (F.stddev_pop(value).over(w) + eps)
    return rows.withColumn("z", F.coalesce(z, F.lit(0.0)))


def minmax_tile(rows: DataFrame, keys: list[str], value: Column, eps: float = 1e-6) -> DataFrame:
    w = Window.partitionBy(*keys)
    lo, hi = F.min(value).over(w), F.max(value).over(w)
    return rows.withColumn("scaled", (value - lo) / (hi - lo + eps))


def log_p99(rows: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """``scaled``: log1p by the 99th percentile over all bands of an image, clipped to 0..1."""
    v = F.log1p(F.greatest(F.coalesce(F.col(value), F.lit(0.0)), F.lit(0.0)))
    p = F.percentile(F.col("__v"), 0.99).over(Window.partitionBy(*keys))
    p = F.when((p > 0) & ~F.isnan(p), p).otherwise(F.lit(1.0))
    return rows.withColumn("__v", v).withColumn("scaled", clip(F.col("__v") / p, 0.0, 1.0)).drop("__v")


def decibel(v: Column) -> Column:
    return 10 * F.log10(F.greatest(v, F.lit(1e-10)))


def looks_decibel(rows: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """``keys, rejected``: more than half of the finite, non-zero values are negative."""
    v = F.col(value)
    counted = v.isNotNull() & ~F.isnan(v) & (v != 0)
    return rows.groupBy(*keys).agg(F.coalesce(F.avg(F.when(counted, (v < 0).cast("int"))) > 0.5, F.lit(False)).alias("rejected"))


def rgb8(v: Column) -> Column:
    """0..255, truncated, from digital numbers."""
    return (clip(v / 10000, 0.0, 1.0) * 255).cast("int")


def sigma8(v: Column, mean: Column, std: Column) -> Column:
    """0..255, truncated: two deviations to either side of the mean."""
    return clip((v - (mean - 2 * std)) / (4 * std) * 255, 0.0, 255.0).cast("int")


def reflectance(v: Column, divisor: float) -> Column:
    return clip(v / divisor, 0.0, 1.0)


def emissive(v: Column, lo: float, hi: float) -> Column:
    return clip((v - lo) / (hi - lo), 0.0, 1.0)


def stretch(rows: DataFrame, keys: list[str], value: str = "value", lo: float = 0.02, hi: float = 0.98, gamma: float = 1.0) -> DataFrame:
    """``stretched``: 0..1 between two percentiles of each image and band."""
    w = Window.partitionBy(*keys)
    a, b = (F.percentile(F.col(value), p).over(w) for p in (lo, hi))
    s = clip((F.col(value) - a) / F.greatest(b - a, F.lit(1e-8)), 0.0, 1.0)
    return rows.withColumn("stretched", F.pow(s, F.lit(1 / gamma)) if gamma != 1.0 else s)
