"""Files: multi-file scans with provenance, partitioned and sorted sinks, manifests."""

from __future__ import annotations

import fnmatch
import functools
import re
import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A spring in a path: four digits after an underscore that a name or one of its parts ends with.
SPRING = re.compile(r"_(\d{4})(?=_|\.|/|$)")
#: Paths in the shared folder that this session wrote and has not deleted.
WRITTEN: list[str] = []


@functools.cache
def _stand_in() -> str:
    return f"file://{tempfile.mkdtemp(prefix='spark-')}"


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all machines share, named by spark.checkpoint.dir; ``clear_scratch`` deletes what was put there.

    Where that is unset, a temporary folder stands in for it on a single machine; on a cluster there is no such thing, so that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        root = _stand_in()
    path = f"{root.rstrip('/')}/swathe-{name}-{uuid.uuid4().hex}"
    WRITTEN.append(path)
    return path


def drop(spark: SparkSession, path: str) -> None:
    """Delete a path that ``scratch`` gave out; any other stays."""
    if path in WRITTEN:
        here = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        here.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(here, True)
        WRITTEN.remove(path)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: its rows are fixed from then on, and its lineage ends there."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear_scratch(spark: SparkSession) -> None:
    """Delete all that this session put into the shared folder; call it when the results have been written elsewhere."""
    for path in list(WRITTEN):
        drop(spark, path)


def scan(spark: SparkSession, path: str, schema: str, **options) -> DataFrame:
    """Delimited text under a declared schema, with the name of each row's file."""
    return spark.read.options(**options).schema(schema).csv(path).withColumns({"source_file": F.col("_metadata.file_name"), "source_path": F.col("_metadata.file_path")})


def spring_files(spark: SparkSession, path: str, pattern: str = "*.csv", springs: list[int] | None = None) -> dict[int, list[str]]:
    """The paths of files under ``path`` that match, by the spring that their path names; a file that names none is an error."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = root.getFileSystem(conf).listFiles(root, True)
    out: dict[int, list[str]] = {}
    while found.hasNext():
        file = found.next().getPath()
        if fnmatch.fnmatch(file.getName(), pattern):
            years = SPRING.findall(file.toString())
            if not years:
                raise ValueError(f"{file.getName()} names no spring")
            if springs is None or int(years[-1]) in springs:
                out.setdefault(int(years[-1]), []).append(file.toString())
    return out


def scan_springs(spark: SparkSession, path: str, schema: str, columns: list[str], pattern: str = "*.csv", springs: list[int] | None = None) -> DataFrame:
    """The wanted columns of the wanted springs' pieces with the types that are declared, the spring and each row's file.

    Other springs' files are not opened, other columns are not parsed, and a piece whose header differs from what is declared is an error.
    """
    parts = []
    for year, files in sorted(spring_files(spark, path, pattern, springs).items()):
        rows = spark.read.option("header", True).option("enforceSchema", False).option("mode", "FAILFAST").schema(schema).csv(sorted(files))
        parts.append(rows.select(*columns, F.lit(year).alias("spring"), F.col("_metadata.file_name").alias("source_file")))
    if not parts:
        raise ValueError(f"no files match {pattern}")
    return reduce(DataFrame.unionByName, parts)


def year_of(name: Column) -> Column:
    """The year in a file's path: four digits after an underscore that a name or one of its parts ends with."""
    return F.regexp_extract(name, r"_(\d{4})(?:_|\.|/|$)", 1).cast("int")


def merge(parts: DataFrame, srid: str = "srid") -> DataFrame:
    """Rows of many files, or an error when they disagree on the reference system."""
    seen = parts.agg(F.count_distinct(srid)).first()[0]
    if seen > 1:
        raise ValueError(f"{seen} reference systems")
    return parts


def write_missing(rows: DataFrame, path: str, by: str, done: DataFrame | None = None, force: bool = False) -> DataFrame:
    """Write partitions that are not there yet; all of them, replacing what is there, with ``force``."""
    fresh = rows if force or done is None else rows.join(done.select(by).distinct(), by, "left_anti")
    mode = "overwrite" if force else "append"
    fresh.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)
    return rows.sparkSession.read.parquet(path)


def wkt(points: Column) -> Column:
    """A line's text, six decimals."""
    return F.concat(F.lit("LINESTRING ("), F.array_join(F.transform(points, lambda p: F.format_string("%.6f %.6f", p["x"], p["y"])), ", "), F.lit(")"))


#: Bytes of a file that is hashed as one row; a larger one is hashed as a stream of its lines.
MOST_BYTES = 1 << 24


def listing(spark: SparkSession, path: str) -> DataFrame:
    """Path, name, bytes and time of each file under a path; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.regexp_extract("path", "([^/]+)$", 1).alias("name"), F.col("length").alias("bytes"), F.col("modificationTime").alias("updated"))


def manifest(spark: SparkSession, path: str, most: int = MOST_BYTES) -> DataFrame:
    """Name, bytes, time and SHA-256 of each file, of any size but none; contents stay on the executors."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    at = F.col("_metadata.file_path").alias("at")
    whole = files.where(F.col("length") <= most).select(at, F.sha2("content", 256).alias("sha256"))
    hashes = whole.unionByName(streamed_hashes(spark, path, most))
    known = files.select(at, F.regexp_extract("path", "([^/]+)$", 1).alias("name"), F.col("length").alias("bytes"), F.col("modificationTime").alias("updated"))
    return known.join(hashes, "at", "left").drop("at")


def streamed_hashes(spark: SparkSession, path: str, most: int) -> DataFrame:
    """SHA-256 of files of more than ``most`` bytes, in memory of a line: lines are read as bytes wherever a file is split, and stream through one task a file in order."""
    lines = spark.read.format("text").option("recursiveFileLookup", "true").option("lineSep", "\n").load(path)
    lines = lines.select(F.col("value").cast("binary").alias("line"), F.col("_metadata.file_path").alias("at"), F.col("_metadata.file_size").alias("bytes"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("turn"))
    ordered = lines.where(F.col("bytes") > most).repartition("at").sortWithinPartitions("at", "start", "turn")

    def run(batches):
        import hashlib

        import pyarrow as pa

        def out(own: str, sha) -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"at": [own], "sha256": [sha.hexdigest()]})

        own, sha, left = None, None, 0
        for batch in batches:
            for line, name, size in zip(*(batch.column(k) for k in range(3)), strict=True):
                if name.as_py() != own:
                    if own is not None:
                        yield out(own, sha)
                    own, sha, left = name.as_py(), hashlib.sha256(), size.as_py()
                data = line.as_py() or b""
                sha.update(data)
                left -= len(data)
                if left:  # else the file ends without a line feed
                    sha.update(b"\n")
                    left -= 1
        if own is not None:
            yield out(own, sha)

    return ordered.select("line", "at", "bytes").mapInArrow(run, "at string, sha256 string")


#: Kind of a table by a pattern of its name; the first that matches counts.
KINDS = [("^(line|supp|part)", "measurement table"), ("^(cust|nation|region)", "place table"), ("^(doc|page|bench|label|conv)", "text table"), ("^(embed)", "discovery table"), ("", "other table")]


def kind_of(name: Column) -> Column:
    return F.coalesce(*(F.when(name.rlike(pattern), kind) for pattern, kind in KINDS))


def catalog(spark: SparkSession, folder: str, names: list[str]) -> DataFrame:
    """Each table's kind, rows, columns, files, bytes and time of its last change."""
    out = None
    for name in names:
        path = f"{folder}/{name}.parquet"
        t = spark.read.parquet(path)
        files = listing(spark, path).agg(F.count(F.lit(1)).alias("files"), F.sum("bytes").alias("bytes"), F.max("updated").alias("updated"))
        row = t.agg(F.count(F.lit(1)).alias("n_rows")).crossJoin(F.broadcast(files)).select(F.lit(name).alias("name"), kind_of(F.lit(name)).alias("kind"), "n_rows", F.lit(", ".join(t.columns)).alias("columns"), "files", "bytes", "updated")
        out = row if out is None else out.unionByName(row)
    return out
