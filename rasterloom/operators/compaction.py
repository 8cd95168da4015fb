"""Far too many small files: consolidation without losing or repeating a record.

Two layers. ``compact`` joins small Parquet files into well-sized ones by copying their encoded column chunks and
writing new footers; no value is decoded, and schema, block counts and row totals are checked. ``consolidate`` does
the same for stored texts: whole records are cut out of payloads of any layout, each is kept once, as it stands but for
line breaks between its tokens, and laid into few files per group with a footer of counts and a digest; the files of the result pass through ``compact``.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.common import located, once, read_json, scratch
from rasterloom.sources import footer as ft

REPORT = "target string, files_in int, groups_in int, groups_out int, rows_in bigint, rows_out bigint, bytes_in bigint, bytes_out bigint, rejected string"


class _Target:
    """One output file: takes row groups until it is closed, then appears under its name at once."""

    def __init__(self, fs, folder: str) -> None:
        self.fs, self.name = fs, f"{folder}/part-{uuid.uuid4().hex}.parquet"
        self.tmp = f"{folder}/_tmp-{uuid.uuid4().hex}"
        self.out = fs.open_output_stream(self.tmp)
        self.out.write(ft.MAGIC)
        self.at, self.base, self.groups = 4, None, []
        self.files = self.rows = self.bytes_in = 0

    def add(self, source, size: int, footer: dict) -> None:
        groups = []
        for g in footer[ft.FILE_GROUPS][1][1]:
            new, spans = ft.moved_group(g, self.at, len(self.groups) + len(groups))
            for start, n in spans:
                source.seek(start)
                block = source.read(n)
                if len(block) != n:
                    raise OSError(f"{n} bytes of a block wanted, {len(block)} read")
                self.out.write(block)
                self.at += n
            groups.append(new)
        self.groups += groups
        self.base = self.base or footer
        self.files += 1
        self.rows += footer[ft.FILE_ROWS][1]
        self.bytes_in += size

    def close(self) -> tuple:
        import pyarrow.parquet as pq

        end = dict(self.base)
        end[ft.FILE_ROWS] = (ft.I64, self.rows)
        end[ft.FILE_GROUPS] = (ft.LIST, (ft.STRUCT, self.groups))
        tail = ft.encode(end)
        self.out.write(tail + struct.pack("<I", len(tail)) + ft.MAGIC)
        self.out.close()
        with self.fs.open_input_file(self.tmp) as f:  # a second reader must agree on the new footer
            meta = pq.ParquetFile(f).metadata
            rows = sum(meta.row_group(i).num_rows for i in range(meta.num_row_groups))
        if (meta.num_row_groups, rows, meta.num_rows) != (len(self.groups), self.rows, self.rows):
            raise ValueError(f"{self.tmp}: {meta.num_row_groups} blocks and {rows} rows, {len(self.groups)} and {self.rows} were copied")
        self.fs.move(self.tmp, self.name)
        size = self.at + len(tail) + 8
        return self.name, self.files, len(self.groups), meta.num_row_groups, self.rows, rows, self.bytes_in, size, None


def compact(spark: SparkSession, source: str, target: str, target_bytes: int = 128 << 20, tasks: int | None = None) -> DataFrame:
    """Join the Parquet files below ``source`` into files of about ``target_bytes`` in the folder ``target``.

    The listing is a distributed table; a task takes a share of the paths and copies block after block, so its memory
    is one column chunk. Files of different schemas never share an output. Empty files (no rows) give nothing; files
    that are cut off or no Parquet are reported in ``rejected`` and left where they are. A task that is run again
    writes under new names, and only the names in the report belong to the result: use :func:`read_compacted`.

    Returns the report, one row per output file or rejected input.
    """
    listing = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(source).select("path", "length")
    if tasks is None:
        # One number: the bytes to copy. A task gets some files' worth, so that sizes come out near the target.
        total = listing.agg(F.sum("length")).first()[0] or 0
        tasks = max(1, min(10_000, -(-total // (4 * target_bytes))))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, folder = located(target)
        fs.create_dir(folder)
        opened: dict[bytes, _Target] = {}
        names = [c.split()[0] for c in REPORT.split(", ")]

        def row(*values) -> pd.DataFrame:
            return pd.DataFrame([values], columns=names)

        for b in batches:
            for path, length in zip(b["path"], b["length"]):
                src_fs, src = located(path)
                with src_fs.open_input_file(src) as f:
                    try:
                        footer = ft.read_footer(f, length)
                        groups = footer[ft.FILE_GROUPS][1][1]
                        ends = [sum(ft.chunk_span(c[ft.CHUNK_META][1])) for g in groups for c in g[ft.GROUP_COLUMNS][1][1]]
                        if max(ends, default=0) > length or sum(g[ft.GROUP_ROWS][1] for g in groups) != footer[ft.FILE_ROWS][1]:
                            raise ValueError("blocks and footer disagree")
                    except (ValueError, KeyError, IndexError, TypeError) as e:
                        yield row(path, 1, 0, 0, 0, 0, length, 0, str(e) or "unreadable")
                        continue
                    if not groups:
                        continue
                    key = ft.schema_key(footer)
                    if key not in opened:
                        opened[key] = _Target(fs, folder)
                    opened[key].add(f, length, footer)
                if opened[key].at >= target_bytes:
                    yield row(*opened.pop(key).close())
        for t in opened.values():
            yield row(*t.close())

    return listing.repartition(tasks, F.xxhash64("path")).mapInPandas(run, REPORT)


def read_compacted(spark: SparkSession, report: DataFrame, schema, target: str) -> DataFrame:
    """The table in the files named by ``report`` (already written); RuntimeError if its totals don't agree."""
    t = report.agg(F.sum("rows_in"), F.sum("rows_out"), F.sum("groups_in"), F.sum("groups_out"), F.count("rejected"), F.count("*")).first()
    if (t[0], t[2], t[4]) != (t[1], t[3], 0):
        raise RuntimeError(f"consolidation of {target} doesn't add up: {t}")
    if not t[5]:
        return spark.createDataFrame([], schema)
    # Names of lost attempts may lie in the folder too, so the files are named one by one. Their list is as long as the
    # one that any scan of the folder keeps on the driver; no row is joined or shuffled.
    names = [r["target"].rsplit("/", 1)[-1] for r in report.filter("rejected is null").select("target").toLocalIterator()]
    return spark.read.schema(schema).parquet(*[f"{target}/{n}" for n in names])


KEY = ("export_id", "point_index", "model")


def _is_record(o) -> bool:
    whole = lambda v: isinstance(v, int) and not isinstance(v, bool)
    return isinstance(o, dict) and whole(o.get("export_id")) and whole(o.get("point_index")) and isinstance(o.get("model"), str)


def records_in(payload: str | None) -> Iterator[tuple[int, int, str, str]]:
    """``export_id, point_index, model`` and the text of each record that stands whole in ``payload``.

    Records may stand by line, in a list or inside an object; the text is cut out as it is. What is cut off is
    skipped, so of a broken list or object the whole records before the break still count.
    """
    at = payload.find("{") if payload else -1
    while at >= 0:
        try:
            o, end = read_json(payload, at)
        except ValueError:
            at = payload.find("{", at + 1)
            continue
        if _is_record(o):
            yield o["export_id"], o["point_index"], o["model"], payload[at:end]
            at = payload.find("{", end)
        elif any(isinstance(v, (dict, list)) for v in o.values()):
            at = payload.find("{", at + 1)
        else:
            at = payload.find("{", end)


def layout_name(c) -> F.Column:
    """A layout as spelt in the model: lower case, ``_`` between words; null for null and blank."""
    return F.nullif(F.regexp_replace(F.lower(F.trim(c)), r"[\s-]+", "_"), F.lit(""))


def consolidated(files: DataFrame, target_bytes: int = 1 << 20) -> DataFrame:
    """``export_id, layout, file_no, n_records, n_bytes, digest, payload``: the records of ``files`` (export_files),
    each once, one per line, in files of about ``target_bytes`` per export and layout.

    Of a record in several files the shortest text stays (ties: the smallest). An export's layout is the one most of
    its files name; null where none does. A record goes to a file by the hash of its point and model, so even the
    largest export is laid out in parallel and no group exceeds a file. Null, empty and unreadable payloads give no
    record; re-delivered rows count once; an empty table gives an empty result; other columns are ignored.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(*r, lay) for p, lay in zip(b["payload"], b["layout"]) for r in records_in(p)]
            yield pd.DataFrame(rows, columns=[*KEY, "raw", "layout"])

    rows = once(files.select("file_id", "layout", "payload", "written_at"), "file_id", "written_at").select("payload", layout_name(F.col("layout")).alias("layout"))
    found = rows.mapInPandas(run, "export_id bigint, point_index int, model string, raw string, layout string")
    # One flat line each: a record's own line breaks lie between tokens, never inside a JSON string.
    line = F.regexp_replace("raw", r"\s*[\r\n]+\s*", " ")
    best = found.withColumn("raw", line).groupBy(*KEY).agg(F.min(F.struct(F.length("raw").alias("n"), "raw")).alias("r"), F.max("layout").alias("layout"))
    size = F.octet_length("r.raw") + 1
    per = best.groupBy("export_id").agg(F.mode("layout", True).alias("of"), F.ceil(F.sum(size) / target_bytes).cast("int").alias("n_files"))
    placed = best.drop("layout").join(per, "export_id").withColumn("file_no", F.pmod(F.xxhash64("point_index", "model"), F.col("n_files")).cast("int"))
    lines = F.array_sort(F.collect_list(F.struct("point_index", "model", "r.raw")))
    out = placed.groupBy("export_id", F.col("of").alias("layout"), "file_no").agg(lines.alias("l"))
    payload = F.array_join("l.raw", "\n")
    return out.select(
        "export_id", "layout", "file_no", F.size("l").alias("n_records"), F.octet_length(payload).cast("bigint").alias("n_bytes"), F.sha2(payload, 256).alias("digest"), payload.alias("payload")
    )


def consolidate(files: DataFrame, target_bytes: int = 1 << 20, parquet_bytes: int = 128 << 20) -> tuple[DataFrame, DataFrame]:
    """:func:`consolidated` as a stored table of few Parquet files, and the report of their consolidation.

    The tasks write a small Parquet file each; their column blocks are then copied into well-sized files.
    """
    spark = files.sparkSession
    table = consolidated(files, target_bytes)
    small, large, said = scratch(spark, "small"), scratch(spark, "large"), scratch(spark, "report")
    table.write.parquet(small)
    compact(spark, small, large, parquet_bytes).write.parquet(said)
    report = spark.read.schema(REPORT).parquet(said)
    return read_compacted(spark, report, table.schema, large), report


def record_keys(consolidated: DataFrame) -> DataFrame:
    """The records of consolidated files by key; RuntimeError where a file's digest or count doesn't hold."""
    lines = F.split("payload", "\n")
    sound = (F.sha2("payload", 256) == F.col("digest")) & (F.size(lines) == F.col("n_records"))
    checked = consolidated.select(F.when(sound, lines).otherwise(F.raise_error(F.concat(F.lit("damaged file of export "), F.col("export_id")))).alias("lines"))
    return checked.select(F.explode("lines").alias("line")).select(F.from_json("line", "export_id bigint, point_index int, model string").alias("r")).select("r.*")
