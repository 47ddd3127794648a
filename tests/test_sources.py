"""Springs from sets of files, digests of files of any size, and upserts of touched keys."""

import hashlib
import os
import random

import pytest
from pyspark.sql import functions as F

from swathe.operators.corridor import segment_springs
from swathe.sources import files
from swathe.streaming import springs

SCHEMA = "zone_id string, landcover int, ndvi_mean double, ndvi_count long, remark string"


@pytest.fixture()
def pieces(tmp_path):
    for name, lines in {"run_per_image_2019_a.csv": 3, "run_per_image_2019_b.csv": 2, "run_per_image_2020.csv": 4}.items():
        with open(tmp_path / name, "w") as f:
            f.write("zone_id,landcover,ndvi_mean,ndvi_count,remark\n" + "".join(f'z{k},41,0.{k},{k},"a, b"\n' for k in range(lines)))
    (tmp_path / "notes.txt").write_text("not measured")
    return str(tmp_path)


def test_springs_of_files(spark, pieces):
    found = files.spring_files(spark, pieces)
    assert {y: sorted(os.path.basename(f) for f in fs) for y, fs in found.items()} == {2019: ["run_per_image_2019_a.csv", "run_per_image_2019_b.csv"], 2020: ["run_per_image_2020.csv"]}
    rows = files.scan_springs(spark, pieces, SCHEMA, ["zone_id", "ndvi_count"])
    assert {(r.spring, r.source_file): r["count"] for r in rows.groupBy("spring", "source_file").count().collect()} == {(2019, "run_per_image_2019_a.csv"): 3, (2019, "run_per_image_2019_b.csv"): 2, (2020, "run_per_image_2020.csv"): 4}
    assert dict(rows.dtypes)["ndvi_count"] == "bigint" and rows.agg(F.sum("ndvi_count")).first()[0] == 3 + 1 + 6


def test_other_columns_and_springs_are_not_read(spark, pieces):
    with open(os.path.join(pieces, "x_per_image_2021.csv"), "w") as f:
        f.write("zone_id,landcover,ndvi_mean,ndvi_count,remark\nz1,41,not a number,1,x\n")
    rows = files.scan_springs(spark, pieces, SCHEMA, ["zone_id", "ndvi_count"])
    assert rows.where("spring = 2021").count() == 1  # the column that is no number isn't parsed
    with pytest.raises(Exception, match="(?i)malformed|FAILFAST"):
        files.scan_springs(spark, pieces, SCHEMA, ["ndvi_mean"]).collect()
    some = files.scan_springs(spark, pieces, SCHEMA, ["ndvi_mean"], springs=[2020])
    assert [os.path.basename(f) for f in some.inputFiles()] == ["run_per_image_2020.csv"] and some.count() == 4
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<ndvi_mean:double>" in plan


def test_wrong_headers_names_and_folders_are_errors(spark, pieces):
    with open(os.path.join(pieces, "y_per_image_2022.csv"), "w") as f:
        f.write("zone,cover,mean,count,remark\nz1,41,0.1,1,x\n")
    with pytest.raises(Exception, match="(?i)header"):
        files.scan_springs(spark, pieces, SCHEMA, ["ndvi_count"], springs=[2022]).collect()
    with open(os.path.join(pieces, "nameless.csv"), "w") as f:
        f.write("a\n")
    with pytest.raises(ValueError, match="no spring"):
        files.scan_springs(spark, pieces, SCHEMA, ["ndvi_count"])
    with pytest.raises(ValueError, match="no files"):
        files.scan_springs(spark, pieces, SCHEMA, ["ndvi_count"], pattern="*.tsv")


def test_digests_of_any_size(spark, tmp_path):
    rng = random.Random(1)
    contents = {
        "line": b"a line\n", "open": b"a\nb", "feeds": b"\n\n\n", "returns": b"a\r\nb\r\n\r", "random": rng.randbytes(300_000),
        "one_line": b"x" * 200_000, "not text": bytes(range(256)) * 1000, "ends": rng.randbytes(99_999) + b"\n",
    }
    for name, data in contents.items():
        (tmp_path / name).write_bytes(data)
    want = {name: (len(data), hashlib.sha256(data).hexdigest()) for name, data in contents.items()}
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")  # so that a file is read in many splits
        for most in (0, 10, 150_000, 1 << 30):
            assert {r.name: (r.bytes, r.sha256) for r in files.manifest(spark, str(tmp_path), most).collect()} == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_files_of_some_size_are_not_one_row(spark, tmp_path):
    data = random.Random(2).randbytes(20 << 20)
    (tmp_path / "large").write_bytes(data)
    (tmp_path / "small").write_bytes(b"a")
    found = files.streamed_hashes(spark, str(tmp_path), files.MOST_BYTES).collect()
    assert [r.sha256 for r in found] == [hashlib.sha256(data).hexdigest()]


# --- upserts ---------------------------------------------------------------------------------------------------------

FIELDS = "segment_id string, year int, ring string, landcover int, pass_date int, orbit int, image int, m double, n long, doy int"


def measured(segments, years, orbits, seed=0):
    rng = random.Random(seed)
    return [(s, y, ring, 41, y * 10 + p, o, 0, rng.random(), 30 + p, 70 + p) for s in segments for y in years for o in orbits for p in range(2) for ring in ("0-50", "500-1000")]


def rows_of(df):
    return sorted((r.segment_id, r.year, r.ring, round(r.diff_all, 9), r.passes) for r in df.collect())


def test_late_and_repeated_batches(spark, tmp_path):
    store, results = str(tmp_path / "store"), str(tmp_path / "results")
    segments = [f"s{k:02}" for k in range(20)]
    lots = [measured(segments, (2019, 2020), (0,), 1), measured(["s03"], (2019,), (1,), 2), measured(segments[:5], (2021,), (0, 1), 3)]
    batches = [spark.createDataFrame(lot, FIELDS) for lot in lots]
    first = springs.upsert(spark, batches[0], 0, store, results, 8)
    assert len(first) > 4
    late = springs.upsert(spark, batches[1], 1, store, results, 8)
    assert len(late) == 1  # a late piece of one segment makes one bucket anew
    versions = {(r.bucket, r.version) for r in spark.read.parquet(results).select("bucket", "version").distinct().collect()}
    assert {b for b, v in versions if v == 1} == set(late) and {b for b, v in versions if v == 0} == set(first)
    springs.upsert(spark, batches[2], 2, store, results, 8)
    want = rows_of(segment_springs(spark.createDataFrame([r for lot in lots for r in lot], FIELDS)))
    assert rows_of(springs.current(spark, results)) == want
    for number in (1, 2):  # a batch that comes again, after a crash, changes nothing
        springs.upsert(spark, batches[number], number, store, results, 8)
        assert rows_of(springs.current(spark, results)) == want or number == 1
    assert rows_of(springs.current(spark, results)) == want


def test_only_touched_buckets_are_read(spark, tmp_path):
    store, results = str(tmp_path / "store"), str(tmp_path / "results")
    springs.upsert(spark, spark.createDataFrame(measured([f"s{k:02}" for k in range(30)], (2019,), (0,), 1), FIELDS), 0, store, results, 16)
    late = spark.createDataFrame(measured(["s07"], (2019,), (1,), 2), FIELDS)
    touched = springs.upsert(spark, late, 1, store, results, 16)
    total = spark.read.parquet(store).count()
    read = spark.read.parquet(store).where(F.col("bucket").isin(touched))
    assert read.count() < total / 4
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan or "PartitionFilters: [isnotnull(bucket" in plan or "bucket#" in plan.split("PartitionFilters:")[1][:80]
