"""Session helpers shared by all operators: tables, shared storage, lineage cuts."""

from __future__ import annotations

import json
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_written: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only where that is unset (unit tests, notebooks) a folder of this machine is made and set.
    """
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        where = "file://" + tempfile.mkdtemp(prefix="rasterloom-")
        spark.sparkContext.setCheckpointDir(where)
        spark.conf.set("spark.checkpoint.dir", where)
    elif not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def scratch(spark: SparkSession, tag: str) -> str:
    """A new path of this run in the shared folder."""
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def materialize(df: DataFrame, tag: str = "stage") -> DataFrame:
    """Cut the lineage: write ``df`` as a table in the shared folder and read it again.

    The table survives the loss of any executor, and every later stage reads only the columns it needs.
    """
    path = scratch(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Delete the tables that ``materialize`` has written; results that read them must be done."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    while _written:
        path = jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(conf).delete(path, True)


def located(path: str):
    """The Arrow file system of a path or URI in the shared storage, and the path there, for tasks that read or write
    files themselves."""
    from pyarrow import fs as pafs

    for ours, theirs in (("s3a://", "s3://"), ("s3n://", "s3://")):  # names that only Hadoop has
        if path.startswith(ours):
            path = theirs + path[len(ours) :]
    return pafs.FileSystem.from_uri(path)


def once(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row per ``key``: re-delivered rows repeat a key, the earliest ``order`` stays.

    An aggregate, so that each task first combines its own rows: a key with many deliveries costs one row per task.
    Rows with a null key are left out.
    """
    rest = [c for c in df.columns if c != key]
    return (
        df.filter(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.min_by(F.struct(*rest), F.struct(F.col(order).isNull(), order)).alias("__row"))
        .select(key, *[F.col(f"__row.{c}").alias(c) for c in rest])
    )


_NUMBER = re.compile(r"-?(?:0|[1-9]\d*)(\.\d+)?([eE][-+]?\d+)?")
_SPACE = re.compile(r"[ \t\n\r]*")
_WORDS = {"true": True, "false": False, "null": None, "NaN": float("nan"), "Infinity": float("inf"), "-Infinity": float("-inf")}


def read_json(text: str, at: int = 0) -> tuple[object, int]:
    """The JSON value that begins at ``at``, and where it ends; ValueError where there is none. Nested to any depth:
    what is too deep for the library's parser is read with a stack of its own."""
    try:
        return json.JSONDecoder().raw_decode(text, at)
    except RecursionError:
        return _read_deep(text, at)


def parse_json(text: str):
    """The JSON value in ``text``, at any depth; ValueError if there is none or more than one."""
    value, end = read_json(text, _SPACE.match(text).end())
    if _SPACE.match(text, end).end() != len(text):
        raise ValueError(f"text after a value at {end}")
    return value


def _read_deep(text: str, at: int) -> tuple[object, int]:
    """One pass over the tokens; ``open_`` holds the containers not closed yet, each with the key it waits to fill."""
    open_: list[list] = []

    def skip(i: int) -> int:
        return _SPACE.match(text, i).end()

    def key(i: int) -> tuple[str, int]:
        if text[i : i + 1] != '"':
            raise ValueError(f"no name at {i}")
        name, i = json.decoder.scanstring(text, i + 1, True)
        i = skip(i)
        if text[i : i + 1] != ":":
            raise ValueError(f"no colon at {i}")
        return name, skip(i + 1)

    while True:
        c = text[at : at + 1]
        if c in ("{", "["):
            inside, at = ({} if c == "{" else []), skip(at + 1)
            if text[at : at + 1] != ("}" if c == "{" else "]"):
                name = None
                if c == "{":
                    name, at = key(at)
                open_.append([inside, name])
                continue
            value, at = inside, at + 1
        elif c == '"':
            value, at = json.decoder.scanstring(text, at + 1, True)
        elif m := _NUMBER.match(text, at):
            value, at = (float if m[1] or m[2] else int)(m[0]), m.end()
        else:
            word = next((w for w in _WORDS if text.startswith(w, at)), None)
            if word is None:
                raise ValueError(f"no value at {at}")
            value, at = _WORDS[word], at + len(word)
        while open_:  # what is whole goes into its container, which may be whole then
            inside, name = open_[-1]
            if isinstance(inside, dict):
                inside[name] = value
            else:
                inside.append(value)
            at = skip(at)
            c, at = text[at : at + 1], skip(at + 1)
            if c == ",":
                if isinstance(inside, dict):
                    open_[-1][1], at = key(at)
                break
            if c != ("}" if isinstance(inside, dict) else "]"):
                raise ValueError(f"neither end nor more at {at}")
            value = open_.pop()[0]
            if not open_:
                return value, at
        else:
            return value, at
