"""Labels from delimited text, and where an export's tables are found."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def label_table(spark: SparkSession, path: str, columns: dict[str, str], numeric: tuple[str, ...] = (), equal: dict[str, str] | None = None, contains: dict[str, str] | None = None) -> DataFrame:
    """``columns`` (name in the file -> name here) of CSV files with a header: numbers coerced (null where they are
    none), rows kept where a column equals or, in any case, contains a text, rows with a null left out.

    All columns are read as text, so no pass over the data infers types, and only those named are parsed.
    """
    rows = spark.read.option("header", True).csv(path).select(*[F.col(f"`{a}`").alias(b) for a, b in columns.items()])
    rows = rows.withColumns({c: F.col(c).try_cast("double") for c in numeric})
    for c, v in (equal or {}).items():
        rows = rows.filter(F.col(c) == v)
    for c, v in (contains or {}).items():
        rows = rows.filter(F.lower(c).contains(v.lower()))
    return rows.dropna()


def first_present(*readers) -> DataFrame:
    """The first of several readers (functions of no argument) that finds its files."""
    last: Exception | None = None
    for read in readers:
        try:
            return read()
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            last = e
    raise FileNotFoundError("none of the places has an export") from last


# Export formats and the names of their files.
FORMATS = {"parquet": ".parquet", "npz": ".npz", "netcdf": ".nc"}


def export_format(name: str) -> str:
    """A known format's name; ValueError for others."""
    key = (name or "").strip().lower()
    if key not in FORMATS:
        raise ValueError(f"no export format {name!r}; there are {', '.join(FORMATS)}")
    return key


def item_names(indices: DataFrame, index: str = "point_index", given: str | None = None) -> DataFrame:
    """``indices`` with ``item``: the given name, sanitised, else ``p00000`` by number."""
    from rasterloom.functions.strings import sanitized

    default = F.format_string("p%05d", F.col(index).cast("int"))
    return indices.withColumn("item", default if given is None else F.when(F.col(given).isNull(), default).otherwise(sanitized(F.col(given))))


def item_index(name, manifest_index):
    """The point of an item file: what its manifest says, else the digits of ``p00007``."""
    return F.coalesce(manifest_index, F.regexp_extract(name, r"^p(\d+)", 1).try_cast("int"))


def targets(n: int, path: str, kind: str = "parquet", layout: str = "combined", names: list[str] | None = None) -> list[str]:
    """The files of an export: one with the format's ending, or one per point, named as given or ``p00000`` by number.
    ValueError for another number of names than points, or a name twice."""
    ending = FORMATS[export_format(kind)]
    if layout == "combined":
        return [path if path.endswith(ending) else path + ending]
    if layout != "per_item":
        raise ValueError(f"no layout {layout!r}")
    if names is not None and len(names) != n:
        raise ValueError(f"{len(names)} names for {n} points")
    import re

    plain = [re.sub("_+", "_", re.sub("[^0-9a-zA-Z_]+", "_", x)).strip("_") or "item" for x in names] if names else [f"p{i:05d}" for i in range(n)]
    if len(set(plain)) != len(plain):
        raise ValueError("two points have one name")
    return [f"{path.rstrip('/')}/{x}{ending}" for x in plain]


def export_points(path: str) -> list[tuple[int, str, str]]:
    """``(point_index, item, manifest file)`` of an export folder, in order of points: as its ``manifest.json`` lists them,
    else by the sidecars beside the arrays, else by sidecars in its subfolders ``pNNNNN``. FileNotFoundError if there are none."""
    import re

    from rasterloom.sources import storage

    whole = storage.read_json_object(f"{path}/manifest.json")
    if whole and isinstance(whole.get("items"), list):
        found = [(int(e.get("point_index", i)), str(e.get("item", f"p{i:05d}")), f"{path}/manifest.json") for i, e in enumerate(whole["items"])]
    else:
        places = [(path, n) for n in storage.names(path)]
        if not any(re.match(r"^p\d+\.json$", n) for _, n in places):
            places = [(f"{path}/{f}", n) for f in storage.folders(path) if re.match(r"^p\d+$", f) for n in storage.names(f"{path}/{f}")]
        found = []
        for where, n in places:
            m = storage.read_json_object(f"{where}/{n}") if n.endswith(".json") else None
            digits = re.match(r"^p(\d+)", n if where == path else where.rpartition("/")[2])
            if m is not None and (digits or "point_index" in m):
                found.append((int(m.get("point_index", digits[1] if digits else -1)), n.removesuffix(".json"), f"{where}/{n}"))
    if not found:
        raise FileNotFoundError(f"no points of an export in {path}")
    return sorted(found)
