"""Seeded resampling with replacement within strata, and statistics of many resamples at once.

Rows of a stratum are numbered and put into buckets of a fixed size.  A resample first deals its picks over the buckets, which
only counts, and then each bucket draws its own picks from its own rows.  So every resample of a stratum has as many picks as
the stratum has rows, no pick is ever sent anywhere, and what is exchanged are sums.

Statistics come from arrays of a few draws' picks at a time, which a task makes, sums and forgets; ``picks`` gives them as rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from . import ranks
from ..sources.files import written

#: Rows of a bucket, and value ranges by which weighted medians are found.
BUCKET_ROWS, RANGES = 1000, 256
#: The hash: remainders by a prime, mixed twice a step; what each part of the key is spread with.
PRIME, FACTOR, SHIFT = 2147483647, 48271, 13
OF_DRAW, OF_PICK, OF_BUCKET = 7919, 104729, 15485863
#: Picks that are in memory at once, picks that a task deals over buckets for one row, and rows that go to Python at once.
AT_ONCE, DEALT, BATCH_ROWS = 1 << 16, 1 << 24, 64


def mixed(x: Column) -> Column:
    """A whole number below 2^31 that looks random, of one below 2^40."""
    for _ in range(2):
        r = (x * FACTOR + 11) % PRIME
        x = r.bitwiseXOR(F.shiftright(r, SHIFT))
    return x


def mixed_array(x: np.ndarray) -> np.ndarray:
    """The same of an array of 64-bit numbers; the remainder is taken by folding, as the prime is 2^31 - 1."""
    for _ in range(2):
        x = x * FACTOR
        x += 11
        for _ in range(2):
            high = x >> 31
            x &= PRIME
            x += high
        np.subtract(x, PRIME, out=x, where=x == PRIME)
        x ^= x >> SHIFT
    return x


def mixed_sql(x: str) -> str:
    """The same in SQL, as a call of a chain that names each step once."""
    step = lambda y: f"list_transform([({y} * {FACTOR} + 11) % {PRIME}], lambda r: xor(r, r >> {SHIFT}))[1]"
    return step(step(f"({x})"))


def seed_of(seed: int, parts: list[str]) -> Column:
    text = F.concat_ws("|", F.lit(str(seed)), *(F.col(p).cast("string") for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 7), 16, 10).cast("long")


def draw(seed: int, *parts: Column | str) -> Column:
    """A deterministic whole number below 2^32 from the md5 of the parts."""
    text = F.concat_ws("|", F.lit(seed).cast("string"), *(F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def alike(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join on keys of which nulls are alike."""
    named = right.select(*(F.col(k).alias(f"_r{n}") for n, k in enumerate(keys)), *(c for c in right.columns if c not in keys))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_r{n}")) for n, k in enumerate(keys)], F.lit(True))
    return left.join(named, same, how).drop(*(f"_r{n}" for n in range(len(keys))))


def buckets(rows: DataFrame, part: list[str], order: str, columns: list[str], draws: int, seed: int) -> DataFrame:
    """A row a bucket: its rows in order, and how many picks each resample takes from it, by draw, where its stratum has others too."""
    numbered = ranks.numbered(rows.select(*part, order, *columns), part, [order], "_n").withColumns({"_i": F.col("_n") - 1, "_seed": seed_of(seed, part)})
    numbered = numbered.withColumn("_c", F.floor(F.col("_i") / BUCKET_ROWS))
    key = [*part, "_c"]
    held = numbered.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("_i", *columns))).alias("_rows"), F.max("_n_total").alias("_all"), F.max("_seed").alias("_seed"))
    times = dealt(numbered.where(F.col("_n_total") > BUCKET_ROWS).groupBy(*part).agg(F.max("_n_total").alias("_all"), F.max("_seed").alias("_seed")), part, draws)
    times = times.groupBy(*key).agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("_first", "_k"))), lambda x: x["_k"])).alias("_times"))
    own = mixed(F.col("_seed") + (F.col("_c") + 1) * OF_BUCKET % PRIME)
    return written(alike(held, times, key, "left").withColumn("_seed", own), "buckets")


def picks(held: DataFrame, draws: int, *keep: str, of_draw: str | None = None) -> DataFrame:
    """Every pick of every resample: ``draw``, ``pick`` (the row) and the kept columns.  Made where they are summed, never written.

    ``of_draw`` is a map or an array by draw, of which each pick has its draw's value as ``at``; it is looked up once a draw.
    """
    n, maps = F.size("_rows"), [of_draw] if of_draw else []
    each = held.select(*keep, *maps, "_rows", "_seed", "_all", "_times", F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("draw"))
    k = F.when(F.col("_all") > BUCKET_ROWS, F.coalesce(F.element_at("_times", F.col("draw")), F.lit(0))).otherwise(n)
    values = [F.element_at(m, F.col("draw")).alias("at") for m in maps]
    each = each.select(*keep, *values, "_rows", "draw", mixed(F.col("_seed") + F.col("draw") * OF_DRAW).alias("_h"), k.alias("_k")).where("_k > 0")
    own = [*keep, *(["at"] if of_draw else [])]
    each = each.select(*own, "_rows", "draw", "_h", F.explode(F.sequence(F.lit(0), F.col("_k") - 1)).alias("_t"))
    at = mixed(F.col("_h") + F.col("_t") * OF_PICK) % n
    return each.select(*own, "draw", F.get("_rows", at.cast("int")).alias("pick"))


def dealt(strata: DataFrame, part: list[str], draws: int) -> DataFrame:
    """How many picks each bucket of a stratum of ``_all`` rows gets in each draw: rows of a bucket (``_c``) and some draws from ``_first`` on.

    A draw's aims are counted where they are made, in memory of a count a bucket.
    """
    every = F.greatest(F.lit(1), F.floor(F.lit(DEALT) / F.col("_all"))).cast("int")
    units = strata.withColumn("_step", every).withColumn("_first", F.explode(F.sequence(F.lit(1), F.lit(draws), F.col("_step")))).repartition(_tasks(strata))
    bucket_rows, at_once = BUCKET_ROWS, AT_ONCE

    def counts(n: int, seed: int, first: int, step: int) -> np.ndarray:
        many = min(step, draws + 1 - first)
        out = np.zeros((many, -(-n // bucket_rows)), np.int64)
        for k, h in enumerate(mixed_array(seed + np.arange(first, first + many) * OF_DRAW)):
            for at in range(0, n, at_once):
                aims = mixed_array(h + np.arange(at, min(n, at + at_once)) % PRIME * OF_PICK) % n
                out[k] += np.bincount(aims // bucket_rows, minlength=out.shape[1])
        return out.T

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, unit in enumerate(zip(*(batch.column(c).to_pylist() for c in ("_all", "_seed", "_first", "_step")), strict=True)):
                found = counts(*unit)
                for at in range(0, len(found), BATCH_ROWS):
                    some = found[at : at + BATCH_ROWS]
                    lists = pa.ListArray.from_arrays(np.arange(len(some) + 1, dtype=np.int32) * some.shape[1], pa.array(some.ravel().astype(np.int32)))
                    columns = [*_repeated(batch, part, np.full(len(some), row)), pa.array(np.arange(at, at + len(some))), pa.array(np.full(len(some), unit[2], np.int32)), lists]
                    yield pa.RecordBatch.from_arrays(columns, schema=schema)

    fields = [*(strata.schema[p] for p in part), T.StructField("_c", T.LongType()), T.StructField("_first", T.IntegerType()), T.StructField("_k", T.ArrayType(T.IntegerType()))]
    schema = _arrow(fields)
    return _small_batches(units).mapInArrow(run, T.StructType(fields))


def _tasks(df: DataFrame) -> int:
    """So many tasks for work that outweighs its rows, which Spark would else put together by their bytes."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _small_batches(df: DataFrame) -> DataFrame:
    """A row may be a whole bucket, so few go to Python at once; read when the table is computed, so it stays set."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    return df


def _arrow(fields: list[T.StructField]) -> pa.Schema:
    return pa.schema([(f.name, to_arrow_type(f.dataType)) for f in fields])


def _repeated(batch: pa.RecordBatch, columns: list[str], rows: np.ndarray) -> list[pa.Array]:
    return [batch.column(c).take(pa.array(rows)) for c in columns]


def _bucket(batch: pa.RecordBatch, row: int, draws: int) -> tuple[dict[str, np.ndarray], np.ndarray, int]:
    """A bucket's columns, how many picks each draw takes from it, and its seed."""
    rows = batch.column("_rows")[row].values
    columns = {f.name: rows.field(f.name).to_numpy(zero_copy_only=False) for f in rows.type}
    given = batch.column("_times")[row].values  # none where the bucket is the whole stratum
    times = np.full(draws, len(rows)) if given is None else given.to_numpy(zero_copy_only=False).astype(np.int64)
    return columns, times, batch.column("_seed")[row].as_py()


def drawn(n: int, times: np.ndarray, seed: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Picks of a bucket of ``n`` rows as arrays, some draws at a time, numbered from 0: the first draw and the one after the last, each pick's draw from the first one on, and its row."""
    h, step = mixed_array(seed + np.arange(1, len(times) + 1) * OF_DRAW), max(1, AT_ONCE // max(1, times.max()))
    for first in range(0, len(times), step):
        k = times[first : first + step]
        own = np.repeat(np.arange(len(k)), k)
        turn = np.arange(len(own)) - np.repeat(np.cumsum(k) - k, k)
        turn *= OF_PICK
        turn += h[first : first + step][own]
        yield first, first + len(k), own, mixed_array(turn) % n


def by_group(rows: DataFrame, by: list[str], spread: str, start: Callable, schema: str) -> DataFrame:
    """What ``start()`` makes of each group's rows of a task: its ``add(batch, row)`` takes them one by one, its ``columns()`` are then put out beside the group.

    Rows are dealt by ranges of group, so most groups meet one task, and a group that is large meets all.
    """
    keys = [F.col(b) for b in by]
    sorted_ = rows.repartitionByRange(_tasks(rows), *keys, spread).sortWithinPartitions(*keys) if by else rows.repartition(_tasks(rows))
    fields = [*(rows.schema[b] for b in by), *T._parse_datatype_string(schema).fields]
    arrow = _arrow(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> Iterator[pa.RecordBatch]:
            own = state.columns()
            if len(own[0]):
                held = [pa.repeat(k, len(own[0])) for k in group]
                yield pa.RecordBatch.from_arrays([*held, *(pa.array(c, f.type) for c, f in zip(own, list(arrow)[len(by) :], strict=True))], schema=arrow)

        group = state = None
        for batch in batches:
            for row in range(batch.num_rows):
                now = [batch.column(b)[row] for b in by]
                if state is None or any(not a.equals(b) for a, b in zip(now, group, strict=True)):
                    if state is not None:
                        yield from out()
                    group, state = now, start()
                state.add(batch, row)
        if state is not None:
            yield from out()

    return _small_batches(sorted_).mapInArrow(run, T.StructType(fields))


class Means:
    """Sum and number of each draw's picks."""

    def __init__(self, draws: int):
        self.draws, self.sums, self.counts = draws, np.zeros(draws), np.zeros(draws, np.int64)

    def add(self, batch: pa.RecordBatch, row: int) -> None:
        columns, times, seed = _bucket(batch, row, self.draws)
        values = columns["_v"]
        for first, end, own, at in drawn(len(values), times, seed):
            self.sums[first:end] += np.bincount(own, values[at], minlength=end - first)
        self.counts += times

    def columns(self) -> list:
        met = np.flatnonzero(self.counts)
        return [met + 1, self.sums[met], self.counts[met]]


class Weights:
    """Sums of weights of each draw's picks by range of values; null where a range has no pick."""

    def __init__(self, draws: int, ranges: int):
        self.draws, self.ranges = draws, ranges
        self.sums, self.met = np.zeros((draws, ranges)), np.zeros((draws, ranges), bool)

    def add(self, batch: pa.RecordBatch, row: int) -> None:
        columns, times, seed = _bucket(batch, row, self.draws)
        known, weights, ranges = ~np.isnan(columns["_w"]), np.nan_to_num(columns["_w"]), columns["_b"].astype(np.int64)
        for first, end, own, at in drawn(len(weights), times, seed):
            own *= self.ranges
            own += ranges[at]
            size, shape = (end - first) * self.ranges, (end - first, self.ranges)
            sums = np.bincount(own, weights[at], minlength=size).reshape(shape)
            self.sums[first:end] += sums
            self.met[first:end] |= sums > 0 if weights.min() > 0 else np.bincount(own, known[at], minlength=size).reshape(shape) > 0

    def columns(self) -> list:
        draws = np.flatnonzero(self.met.any(axis=1))
        sums = pa.array(self.sums[draws].ravel(), mask=~self.met[draws].ravel())
        return [draws + 1, pa.ListArray.from_arrays(np.arange(len(draws) + 1, dtype=np.int32) * self.ranges, sums)]


def means(rows: DataFrame, by: list[str], order: str, value: str, draws: int, seed: int) -> DataFrame:
    """Mean of every resample of each group, one row a draw."""
    held = buckets(rows.where(F.col(value).isNotNull()).withColumn("_v", F.col(value).cast("double")), by, order, ["_v"], draws, seed)
    sums = by_group(held, by, "_c", lambda: Means(draws), "draw int, _s double, _k long")
    return sums.groupBy(*by, "draw").agg((F.sum("_s") / F.sum("_k")).alias("mean"))


def weighted_medians(rows: DataFrame, by: list[str], stratum: str, order: str, value: str, weight: str, draws: int, seed: int) -> DataFrame:
    """Weighted median of every resample of each group within its strata, one row a draw; ``value`` is never null, and ``rows`` are read twice.

    Values are dealt to ranges of about as many rows each.  One pass sums weights by range, which says in which range a
    resample's median lies; a second one looks at picks in that range alone.
    """
    ranges = RANGES
    known = rows.withColumns({"_v": F.col(value).cast("double"), "_w": F.col(weight).cast("double")})
    cuts = known.groupBy(*by).agg(F.percentile_approx("_v", F.lit([k / ranges for k in range(1, ranges)]), 4000).alias("_cuts"))
    ranged = alike(known, cuts, by).withColumn("_b", F.size(F.filter("_cuts", lambda c: c < F.col("_v"))))
    held = buckets(ranged, [*by, stratum], order, ["_v", "_w", "_b"], draws, seed)
    sums = by_group(held, by, stratum, lambda: Weights(draws, ranges), "draw int, _s array<double>")
    # a vector a group and draw from each task that met the group
    add = lambda x, y: F.zip_with(x, y, lambda p, q: F.coalesce(p + q, p, q))
    sums = sums.groupBy(*by, "draw").agg(F.aggregate(F.collect_list("_s"), F.array_repeat(F.lit(None).cast("double"), ranges), add).alias("_s"))
    sums = sums.withColumn("_total", F.aggregate("_s", F.lit(0.0), lambda t, x: t + F.coalesce(x, F.lit(0.0))))
    start = F.struct(F.lit(0).alias("b"), F.lit(0.0).alias("before"), F.lit(False).alias("there"))
    there = lambda a, x: a["there"] | (x.isNotNull() & (a["before"] + x >= F.col("_total") / 2))
    walk = lambda a, x: F.when(there(a, x), F.struct(a["b"].alias("b"), a["before"].alias("before"), F.lit(True).alias("there"))).otherwise(
        F.struct((a["b"] + 1).alias("b"), (a["before"] + F.coalesce(x, F.lit(0.0))).alias("before"), F.lit(False).alias("there"))
    )
    found = written(sums.select(*by, "draw", F.col("_total").alias("total"), F.aggregate("_s", start, walk).alias("at")).select(*by, "draw", "total", "at.b", "at.before"), "medians")
    where = found.groupBy(*by).agg(F.collect_list(F.struct("draw", "b")).alias("_at"))
    values = close(alike(held, where, by), by, draws).groupBy(*by, "draw", "_v").agg(F.sum("_s").alias("_s"))
    own = Window.partitionBy(*by, "draw")
    upto = alike(values.withColumn("_upto", F.sum("_s").over(own.orderBy("_v"))), found, [*by, "draw"])
    return upto.where(F.col("_upto") + F.col("before") >= F.col("total") / 2).groupBy(*by, "draw").agg(F.min("_v").alias("median"))


def close(held: DataFrame, by: list[str], draws: int) -> DataFrame:
    """Sums of weights by value of those picks of each draw that are in the range that ``_at`` names for it."""
    fields = [*(held.schema[b] for b in by), *T._parse_datatype_string("draw int, _v double, _s double").fields]
    schema = _arrow(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                columns, times, seed = _bucket(batch, row, draws)
                at = batch.column("_at")[row].values
                wanted = np.full(draws, -1)
                wanted[at.field("draw").to_numpy() - 1] = at.field("b").to_numpy()
                known, weights = ~np.isnan(columns["_w"]), np.nan_to_num(columns["_w"])
                values, code = np.unique(columns["_v"], return_inverse=True)
                ranges = np.where(known, columns["_b"], -2)
                for first, end, own, pick in drawn(len(weights), times, seed):
                    there = np.flatnonzero(ranges[pick] == wanted[first:end][own])
                    keys, place = np.unique(own[there] * len(values) + code[pick[there]], return_inverse=True)
                    if len(keys):
                        sums = np.bincount(place, weights[pick[there]], minlength=len(keys))
                        found = [pa.array((keys // len(values) + first + 1).astype(np.int32)), pa.array(values[keys % len(values)]), pa.array(sums)]
                        yield pa.RecordBatch.from_arrays([*_repeated(batch, by, np.full(len(keys), row)), *found], schema=schema)

    return _small_batches(held.repartition(_tasks(held))).mapInArrow(run, T.StructType(fields))


def picks_sql(source: str, by: list[str], stratum: list[str], order: str, draws: int, seed: int, name: str = "") -> dict[str, str]:
    """Steps of SQL that end in ``<name>pick``: the rows of ``source`` that each ``draw`` takes."""
    part = [*by, *stratum]
    keys, n = ", ".join(part), name
    text = ", ".join(f"cast({p} as string)" for p in part)
    same = " and ".join(f"a.{p} is not distinct from b.{p}" for p in part) or "true"
    listed = "".join(f"a.{p}, " for p in part)
    comma = f"{keys}, " if keys else ""
    over = f"partition by {keys}" if keys else ""
    return {
        f"{n}num": f"select *, row_number() over ({over} order by {order})-1 i, count(*) over ({over}) size, cast('0x'||substr(md5(concat_ws('|','{seed}'{', ' + text if text else ''})),1,7) as bigint) seed from {source}",
        f"{n}dr": f"select unnest(range(1,{draws + 1})) draw",
        f"{n}bk": f"select {comma}i//{BUCKET_ROWS} c, count(*) k, any_value(size) size, any_value({mixed_sql(f'seed+(i//{BUCKET_ROWS}+1)*{OF_BUCKET}%{PRIME}')}) own from {n}num group by {comma}i//{BUCKET_ROWS}",
        f"{n}aim": f"select {comma}({mixed_sql(mixed_sql(f'seed+draw*{OF_DRAW}') + f'+i%{PRIME}*{OF_PICK}')}) % size // {BUCKET_ROWS} c, draw from {n}num, {n}dr where size>{BUCKET_ROWS}",
        f"{n}tm": f"select {comma}c, draw, count(*) t from {n}aim group by all",
        f"{n}dealt": f"select {listed}a.c, a.k, a.draw, {mixed_sql(f'a.own+a.draw*{OF_DRAW}')} h, unnest(range(case when a.size>{BUCKET_ROWS} then coalesce(b.t,0) else a.k end)) t from (select * from {n}bk, {n}dr) a left join {n}tm b on {same} and a.c=b.c and a.draw=b.draw",
        f"{n}aimed": f"select {comma}draw, c*{BUCKET_ROWS} + ({mixed_sql(f'h+t*{OF_PICK}')}) % k i from {n}dealt",
        f"{n}pick": f"select a.draw, b.* from {n}aimed a join {n}num b on {same} and a.i=b.i",
    }


def medians_sql(by: list[str], value: str, weight: str, name: str = "") -> dict[str, str]:
    """A step ``<name>med`` of each draw's weighted median ``m`` from ``<name>pick``."""
    keys = "".join(f"{b}, " for b in by)
    return {
        f"{name}wsum": f"select {keys}draw, {value} v, sum({weight}) w from {name}pick group by all",
        f"{name}wcum": f"select *, sum(w) over (partition by {keys}draw order by v) c, sum(w) over (partition by {keys}draw) t from {name}wsum",
        f"{name}med": f"select {keys}draw, min(v) m from {name}wcum where c>=t/2.0 group by all",
    }
