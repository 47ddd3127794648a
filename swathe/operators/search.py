"""Vector and keyword search, and checks of quotes and numbers against evidence."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.files import written

#: Probes that are sent along with every row at once; more go in several parts.
PACK = 20_000


def unit(v: Column) -> Column:
    """A vector divided by its length; a vector without length has no direction, so null."""
    d = F.transform(v, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(d, F.lit(0.0), lambda a, x: a + x * x))
    return F.when(norm > 0, F.transform(d, lambda x: F.try_divide(x, norm)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def packs(probes: DataFrame, size: int | None = None) -> list[DataFrame]:
    """The probes (probe, pvec) as unit vectors, in parts of at most about ``size``, each one row with an array; a part's size is that of a hash range."""
    size = size or PACK
    n = max(1, -(-probes.count() // size))
    rows = probes.select("probe", unit(F.col("pvec")).alias("p")).where("p is not null")
    return [rows.where(F.pmod(F.xxhash64("probe"), F.lit(n)) == k).agg(F.collect_list(F.struct("probe", "p")).alias("_probes")) for k in range(n)]


def against(rows: DataFrame, probes: DataFrame, rows_vec: str = "vec") -> DataFrame:
    """Every row with every probe and their cosine, for a few probes; see ``nearest`` for many."""
    own = rows.withColumn("_v", unit(F.col(rows_vec)))
    parts = [own.crossJoin(F.broadcast(part)).withColumn("_p", F.explode("_probes")) for part in packs(probes)]
    every = reduce(DataFrame.unionByName, parts)
    return every.withColumns({"probe": F.col("_p.probe"), "cosine": dot(F.col("_v"), F.col("_p.p"))}).drop("_v", "_p", "_probes").where("cosine is not null")


#: Probes whose cells divide the others, at most; probes of a cell and rows of a cell in a block; what rounding may take from an angle and from a product.
PIVOTS, CELL_PACK, ROW_BLOCK, SLACK, EVEN = 1024, 1024, 1024, 1e-6, 1e-12
#: Partitions that blocks of rows are dealt to, and bytes of blocks that go to Python at once.
DEALT, BLOCK_BYTES = 64, 8 << 20


def _matrix(batch: pa.RecordBatch, name: str, row: int) -> np.ndarray:
    """A column's vectors of one row, one after the other, as a matrix with as many rows as the row has keys."""
    flat = batch.column(name)[row].values.to_numpy(zero_copy_only=False)
    return flat.reshape(len(batch.column("keys" if name == "vs" else "names")[row].values), -1)


def _angles(cosines: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosines, -1.0, 1.0))


def _best(vs: np.ndarray, ps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row the greatest product with a probe and that probe's place, of equals the first.

    A product of matrices finds those that may be greatest; they are summed again in the order of their dimensions, as equal vectors must have equal cosines.
    """
    about = vs @ ps.T
    row, place = np.nonzero(about >= about.max(axis=1, keepdims=True) - EVEN)
    cosine = np.empty(len(row))
    for at in range(0, len(row), 1 << 16):
        cosine[at : at + (1 << 16)] = np.cumsum(vs[row[at : at + (1 << 16)]] * ps[place[at : at + (1 << 16)]], axis=1)[:, -1]
    order = np.lexsort((place, -cosine, row))
    first = order[np.searchsorted(row[order], np.arange(len(vs)))]
    return cosine[first], place[first]


def _celled(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Rows (name, v) with the cell of their nearest pivot and the angle to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cosines = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) @ pivots.T
                cell = cosines.argmax(axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(_angles(cosines.max(axis=1)))], names=["name", "v", "cell", "a"])

    return rows.mapInArrow(run, f"name {dict(rows.dtypes)['name']}, v array<double>, cell int, a double")


def _blocks(celled: DataFrame, size: int, names: str, vectors: str, angles: str) -> DataFrame:
    """Blocks of about ``size`` rows of a cell, in the order of their names."""
    counts = celled.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / size).alias("_parts"))  # a row a cell
    part = F.when(F.col("_parts") > 1, F.pmod(F.xxhash64("name"), F.col("_parts"))).otherwise(0).cast("int")
    held = celled.join(F.broadcast(counts), "cell").groupBy("cell", part.alias("part")).agg(F.array_sort(F.collect_list(F.struct("name", "a", "v"))).alias("_r"))
    return held.select("cell", "part", F.col("_r.name").alias(names), F.flatten("_r.v").alias(vectors), F.col("_r.a").alias(angles))


def nearest(rows: DataFrame, probes: DataFrame, key: str, rows_vec: str = "vec") -> DataFrame:
    """Each row's best probe and their cosine, of equals the least probe; (key, cosine, nearest).  Exact: see ``looked_at``."""
    return looked_at(rows, probes, key, rows_vec).select(key, "cosine", "nearest")


def looked_at(rows: DataFrame, probes: DataFrame, key: str, rows_vec: str = "vec") -> DataFrame:
    """``nearest`` with the number of probes that each row was compared with, ``pairs``.

    About the square root of the distinct probes serve as pivots, ``PIVOTS`` at most; rows and probes belong to the cell of their nearest
    pivot and stand in blocks of a cell.  A row first meets a block of its own cell's probes.  By the triangle inequality a cell can hold a
    better one only if the row's angle to the pivot differs from what its probes have by no more than the best angle so far; blocks meet where
    that holds for one of their rows, as matrices.  Where vectors have many dimensions and no clusters it holds nearly everywhere, so the
    job is as many products as there are pairs; it needs the memory of two blocks a task, and no row is made or exchanged for a pair.
    """
    spark = rows.sparkSession
    kinds = dict(rows.dtypes)[key], dict(probes.dtypes)["probe"]
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BLOCK_BYTES))
    # equal vectors are one probe, of the least name
    asked = written(probes.select("probe", unit(F.col("pvec")).alias("v")).where("v is not null").groupBy("v").agg(F.min("probe").alias("name")).select("name", "v"), "probes")
    k = max(1, min(PIVOTS, round(asked.count() ** 0.5)))
    pivots = np.array([r.v for r in asked.orderBy(F.xxhash64("name"), "name").limit(k).select("v").collect()])
    if not len(pivots):
        return rows.limit(0).select(key, F.lit(None).cast("double").alias("cosine"), F.lit(None).cast(kinds[1]).alias("nearest"), F.lit(None).cast("long").alias("pairs"))
    held = written(_celled(asked, pivots), "cells")
    near, far = np.full(len(pivots), np.inf), np.full(len(pivots), -np.inf)
    for r in held.groupBy("cell").agg(F.min("a").alias("near"), F.max("a").alias("far")).collect():  # a row a pivot
        near[r.cell], far[r.cell] = r.near, r.far
    packs_ = written(_blocks(held, CELL_PACK, "names", "ps", "angles"), "packs").withColumnsRenamed({"cell": "_cell", "part": "_part"})
    own = written(_celled(rows.select(F.col(key).alias("name"), unit(F.col(rows_vec)).alias("v")).where("v is not null"), pivots), "rows")
    blocks = _blocks(own, ROW_BLOCK, "keys", "vs", "_a").drop("_a").repartition(DEALT, "cell", "part")

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                vs, names = _matrix(batch, "vs", row), batch.column("names")[row]
                n = len(vs)
                if names.is_valid:
                    cosine, place = _best(vs, _matrix(batch, "ps", row))
                    found, bound, met = names.values.take(pa.array(place)), _angles(cosine) + SLACK, len(names.values)
                else:  # no probe is nearest to this pivot
                    cosine, found, bound, met = np.full(n, -np.inf), pa.nulls(n, batch.schema.field("names").type.value_type), np.full(n, 4.0), 0
                angles = _angles(vs @ pivots.T)
                need = ((angles - far <= bound[:, None]) & (near - angles <= bound[:, None])).any(axis=0)
                lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (pa.array(cosine), found, pa.array(bound), pa.array(need))]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(row, 1) for c in ("cell", "part", "keys", "vs")), *lists, pa.array([met])], names=["cell", "part", "keys", "vs", "cosines", "found", "bounds", "need", "met"])

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                c, vs, ps = batch.column("_cell")[row].as_py(), _matrix(batch, "vs", row), _matrix(batch, "ps", row)
                bound, angle = (batch.column(x)[row].values.to_numpy(zero_copy_only=False) for x in ("bounds", "angles"))
                close = np.abs(angle - _angles(vs @ pivots[c])[:, None]) <= bound[:, None]
                some, these = np.nonzero(close.any(axis=1))[0], np.nonzero(close.any(axis=0))[0]
                if len(some):
                    cosine, place = _best(vs[some], ps[these])
                    yield pa.RecordBatch.from_arrays([batch.column("keys")[row].values.take(pa.array(some)), pa.array(cosine), batch.column("names")[row].values.take(pa.array(these[place])), pa.array(np.full(len(some), len(these)))], names=["key", "cosine", "probe", "k"])

    met = blocks.join(packs_.where("_part = 0"), F.col("cell") == F.col("_cell"), "left").select("cell", "part", "keys", "vs", "names", "ps")
    begun = written(met.mapInArrow(first, f"cell int, part int, keys array<{kinds[0]}>, vs array<double>, cosines array<double>, found array<{kinds[1]}>, bounds array<double>, need array<boolean>, met long").repartition(DEALT, "cell", "part"), "begun")
    pairs = begun.join(packs_, F.get("need", F.col("_cell")) & ~((F.col("cell") == F.col("_cell")) & (F.col("_part") == 0))).select("_cell", "keys", "vs", "bounds", "names", "ps", "angles")
    rest = pairs.mapInArrow(others, f"key {kinds[0]}, cosine double, probe {kinds[1]}, k long")
    start = begun.select(F.explode(F.arrays_zip("keys", "cosines", "found")).alias("_z"), "met").select(F.col("_z.keys").alias("key"), F.col("_z.cosines").alias("cosine"), F.col("_z.found").alias("probe"), F.col("met").alias("k"))
    best = F.min_by(F.struct("cosine", "probe"), F.struct(-F.col("cosine"), F.col("probe"))).alias("_b")
    every = start.unionByName(rest).groupBy("key").agg(best, F.sum("k").alias("pairs"))
    return every.select(F.col("key").alias(key), F.col("_b.cosine").alias("cosine"), F.col("_b.probe").alias("nearest"), "pairs")


def words(c: Column) -> Column:
    """Distinct lower-case words of more than two letters."""
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9]+)")), lambda w: F.length(w) > 2))


def keyword_score(query: str, c: Column) -> Column:
    q = words(F.lit(query))
    return F.try_divide(F.size(F.array_intersect(q, words(c))), F.size(q))


def plain(c: Column) -> Column:
    """Lower case, runs of anything but letters and digits as one space."""
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


#: Answers that claim nothing.
NO_CLAIM = ["unknown", "none stated", ""]


def supported(answer: Column, quote: Column, text: Column) -> Column:
    """An answer that claims nothing is supported; else its quote must have words and occur in the text."""
    q = plain(F.coalesce(quote, F.lit("")))
    claims = answer.isNotNull() & ~answer.isin(NO_CLAIM)
    return ~claims | ((q != "") & F.coalesce(plain(text).contains(q), F.lit(False)))


def evidence(rows: DataFrame, key: str, fields: dict[str, str], text: str) -> DataFrame:
    """A row for each field of a report, with its answer, the quote given for it (field -> quote's column) and whether that is in the text."""
    each = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("answer"), F.coalesce(F.col(q), F.lit("")).alias("quote")) for f, q in fields.items()))
    long = rows.select(key, text, F.explode(each).alias("_f")).select(key, text, "_f.*")
    return long.withColumn("supported", supported(F.col("answer"), F.col("quote"), F.col(text))).drop(text)


#: Fixed value: numbers as answers are scored by.
SAID = r"[-−]?(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?(?:[eE][-+]?\d+)?"


def expected_in(answer: Column, expected: Column) -> Column:
    """Whether an answer has any of the accepted alternatives, an array of (word, value, places).

    A word may be written with hyphens or spaces, in any case; a number counts at its places, with either sign.
    """
    flat = lambda x: F.translate(F.lower(x), "-–", "  ")
    said = F.transform(F.regexp_extract_all(answer, F.lit(SAID), F.lit(0)), lambda t: F.abs(F.translate(t, "−,", "-").cast("double")))
    close = lambda e: F.exists(said, lambda n: F.abs(n - F.abs(e["value"])) <= 0.5 * F.pow(F.lit(10.0), -e["places"]) + 1e-9)
    return F.coalesce(F.exists(expected, lambda e: F.when(e["word"].isNotNull(), flat(answer).contains(F.translate(F.lower(e["word"]), "-", " "))).otherwise(close(e))), F.lit(False))


def known_ids(rows: DataFrame, key: str, text: str, pattern: str, known: DataFrame, most: int | None = None) -> DataFrame:
    """Of each row the ids in its text that are known, sorted, the first ``most`` of them."""
    ids = rows.select(key, F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(f"({pattern})")))).alias("id"))
    found = ids.join(known.select("id").distinct(), "id", "left_semi").groupBy(key).agg(F.sort_array(F.collect_set("id")).alias("ids"))
    return found.select(key, (F.slice("ids", 1, most) if most else F.col("ids")).alias("ids"))


#: Patterns of ids, whose digits are no numbers, and of numbers as they are written.
IDS = r"\b\d{3}-\d{6}-\d{2}-\d{1,3}-\d{1,4}\b|\bS\d{3}\b"
NUMBER = r"(?<![\w.])[-+−]?(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?(?:[eE][-+]?\d+)?%?"


def numbers(c: Column) -> Column:
    """Numbers as written, with thousands, exponents and percent signs."""
    return F.regexp_extract_all(F.regexp_replace(c, IDS, " "), F.lit(NUMBER), F.lit(0))


def value_of(token: Column) -> Column:
    return F.translate(token, "−,%", "-").cast("double")


def is_year(token: Column) -> Column:
    return token.rlike(r"^\d+$") & value_of(token).between(2000, 2030)


def number_supported(token: Column, evidence: Column) -> Column:
    """Some number of the evidence agrees, its sign aside, at the precision the token is written with; only a percentage may match a fraction."""
    mantissa = F.regexp_extract(token, r"\.(\d+)", 1)
    exponent = F.coalesce(F.regexp_extract(token, r"[eE]([-+]?\d+)", 1).try_cast("int"), F.lit(0))
    half = 0.5 * F.pow(F.lit(10.0), exponent - F.length(mantissa)) + 1e-12
    x = F.abs(value_of(token))
    near = lambda y: F.abs(x - F.abs(y)) <= half
    return F.exists(evidence, lambda e: near(value_of(e)) | (token.endswith("%") & near(value_of(e) * 100)))


def number_check(answer: Column, evidence: Column) -> Column:
    """How many numbers of an answer were checked, and those that nothing in the evidence supports; years aren't checked."""
    found = F.filter(numbers(answer), lambda t: ~is_year(t))
    proof = numbers(evidence)
    return F.struct(F.size(found).alias("checked"), F.filter(found, lambda t: ~number_supported(t, proof)).alias("unsupported"))


def pooled_embedding(rows: DataFrame, keys: list[str], vec: str = "embedding", weight: str = "pixels") -> DataFrame:
    """Vectors of a place's parts as one, weighted by their pixels; parts without pixels or vector don't count."""
    long = rows.where((F.col(weight) > 0) & F.col(vec).isNotNull()).select(*keys, F.col(weight).alias("_w"), F.posexplode(vec).alias("_k", "_x"))
    dims = long.groupBy(*keys, "_k").agg((F.sum(F.col("_x").cast("double") * F.col("_w")) / F.sum("_w")).alias("_m"), F.sum("_w").alias("_px"))
    return dims.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("_k", "_m"))), lambda x: x["_m"]).alias(vec), F.max("_px").alias(weight))


def place_table(export: DataFrame, segments: DataFrame, sites: DataFrame) -> DataFrame:
    """Segment bands and their comparison rings as they are, and sites with their rings pooled into a circle, in one long table."""
    columns = ["place_id", "kind", "year", "spill_id", "ecoregion", "commodity", "pixels", "embedding"]
    bands = export.where("which <> 'sites' and pixels > 0 and embedding is not null").join(segments.select(F.col("segment_id").alias("place_id"), "ecoregion", F.col("commodity_group").alias("commodity")), "place_id", "left")
    bands = bands.withColumns({"kind": F.when(F.col("which") == "sample_row", "segment band").otherwise("segment comparison"), "spill_id": F.lit(None).cast("string"), "embedding": F.transform("embedding", lambda x: x.cast("double"))})
    circles = pooled_embedding(export.where("which = 'sites'"), ["place_id", "year"]).join(sites.withColumnRenamed("site_id", "place_id"), "place_id", "left")
    circles = circles.withColumns({"kind": F.when(F.col("site") == "spill", "spill site").otherwise("comparison spot"), "ecoregion": F.col("site_ecoregion"), "commodity": F.lit(None).cast("string")})
    return bands.select(*columns).unionByName(circles.select(*columns))
