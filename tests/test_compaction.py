import json
import os
from datetime import datetime

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from rasterloom.common import table
from rasterloom.operators import compaction
from rasterloom.sources import footer

T = datetime(2024, 1, 1)
SCHEMA = "file_id bigint, export_id bigint, layout string, file_name string, size_bytes bigint, payload string, written_at timestamp"


def rec(e, p, m, **more):
    return json.dumps({"export_id": e, "point_index": p, "model": m, "status": "ok", **more})


def files(spark, payloads, layout="per_item"):
    return spark.createDataFrame([(i, 1, layout, "f", 1, p, T) for i, p in enumerate(payloads)], SCHEMA)


def keys(spark, df, **how):
    got = [tuple(r) for r in compaction.record_keys(compaction.consolidate(df, **how)[0]).collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_layouts_cut_records_and_repeats(spark):
    a, b, c = rec(1, 0, "m", x="br{ace"), rec(1, 1, "m"), rec(1, 2, "n")
    payloads = [f"{a}\n{b}", f"[{a},{c}]", f'{{"n": 2, "records": [{b}]}}', f"[{a},{c[:20]}", '﻿' + c, None, "", "  ", "no json", "{}", "[]", "[1, 2]", b[:-1], f'{{"records": [{rec(2, 0, "q")}, {{"exp', json.dumps(json.loads(rec(3, 0, "z")), indent=1)]
    assert keys(spark, files(spark, payloads)) == {(1, 0, "m"), (1, 1, "m"), (1, 2, "n"), (2, 0, "q"), (3, 0, "z")}
    assert keys(spark, files(spark, payloads).limit(0)) == set()
    assert keys(spark, files(spark, [rec(1, 0, "m")]).selectExpr("*", "'x' AS raw", "1 AS point_index", "'y' AS of")) == {(1, 0, "m")}


def test_incomplete_keys_are_no_records(spark):
    bad = ['{"export_id": null, "point_index": 1, "model": "m"}', '{"export_id": 1, "point_index": true, "model": "m"}', '{"export_id": 1, "point_index": 1}', '{"export_id": 1, "point_index": 1, "model": null}']
    assert keys(spark, files(spark, bad)) == set()


def test_each_record_once_in_sized_files(spark):
    payloads = ["\n".join(rec(7, p, "m", text="ü" * 50) for p in range(s, 400)) for s in (0, 100, 399)] * 2
    df, report = compaction.consolidate(files(spark, payloads, " Per-Item "), target_bytes=4096)
    rows = df.collect()
    assert sum(r.n_records for r in rows) == 400 and len(rows) > 8
    assert {r.layout for r in rows} == {"per_item"} and all(r.n_bytes == len(r.payload.encode()) < 3 * 4096 for r in rows)
    assert {json.loads(x)["point_index"] for r in rows for x in r.payload.split("\n")} == set(range(400))
    got = report.collect()
    assert sum(r.rows_out for r in got) == len(rows) and all(r.rejected is None for r in got)


def test_damage_is_noticed(spark):
    df, _ = compaction.consolidate(files(spark, [rec(1, 0, "m"), rec(1, 1, "m")]))
    broken = df.withColumn("payload", df.payload.substr(2, 1000))
    with pytest.raises(Exception, match="damaged"):
        compaction.record_keys(broken).collect()


def test_blocks_are_copied_not_decoded(spark, tmp_path):
    src, out = tmp_path / "src", tmp_path / "out"
    src.mkdir()
    want = []
    for i in range(30):
        n = [0, 1, 50, 3000][i % 4]
        t = pa.table({"id": pa.array(range(i * 10_000, i * 10_000 + n), pa.int64()), "s": pa.array([None if j % 7 == 0 else f"v{j % 13}" for j in range(n)], pa.string()), "l": pa.array([[float(j), None] for j in range(n)], pa.list_(pa.float32()))})
        pq.write_table(t, src / f"{i}.parquet", row_group_size=1000, compression=["snappy", "zstd"][i % 2], write_page_index=True)
        want += t.to_pylist()
    pq.write_table(pa.table({"other": [1, 2]}), src / "other.parquet")
    (src / "cut.parquet").write_bytes((src / "3.parquet").read_bytes()[:-20])
    (src / "tiny.parquet").write_bytes(b"PAR1")
    report = compaction.compact(spark, f"file://{src}", f"file://{out}", target_bytes=100_000, tasks=1).collect()
    bad = [r for r in report if r.rejected]
    assert len(bad) == 2 and {os.path.basename(r.target) for r in bad} == {"cut.parquet", "tiny.parquet"}
    good = [r for r in report if not r.rejected]
    assert sum(r.rows_out for r in good) == len(want) + 2 and sum(r.groups_in for r in good) == sum(r.groups_out for r in good)
    assert len(good) < 15 and not [n for n in os.listdir(out) if n.startswith("_")]
    got = []
    for r in good:
        t = pq.read_table(r.target)
        got += t.to_pylist() if "id" in t.column_names else []
    assert sorted(got, key=lambda r: r["id"]) == sorted(want, key=lambda r: r["id"])
    assert spark.read.parquet(*[f"file://{r.target}" for r in good if "other" not in pq.read_schema(r.target).names]).count() == len(want)


def test_footer_is_written_as_read(tmp_path):
    p = tmp_path / "a.parquet"
    pq.write_table(pa.table({"a": list(range(100)), "b": [True, None] * 50}), p, row_group_size=7)
    size = p.stat().st_size
    with open(p, "rb") as f:
        tree = footer.read_footer(f, size)
        n = int.from_bytes(p.read_bytes()[-8:-4], "little")
    assert footer.encode(tree) == p.read_bytes()[-8 - n : -8]


def test_whole_table(spark):
    df = table(spark, "/root/testdata/sf0.01", "export_files")
    want = set()
    dec = json.JSONDecoder()
    for r in df.collect():
        p = r.payload or ""
        for i, ch in enumerate(p):
            if ch == "{":
                try:
                    o, _ = dec.raw_decode(p, i)
                except ValueError:
                    continue
                if {"export_id", "point_index", "model"} <= o.keys():
                    want.add((o["export_id"], o["point_index"], o["model"]))
    assert keys(spark, df) == want
