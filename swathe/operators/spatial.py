"""Planar geometry of lines and points as column expressions, with grid cells as equi-join keys."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..sources.files import written
from . import ranks
from .resample import draw
from .sampling import hashed

#: Albers conic of EPSG 6579 on GRS80.
LAT0, LON0, PAR1, PAR2, EAST, NORTH = math.radians(18), math.radians(-100), math.radians(27.5), math.radians(35), 1_500_000.0, 6_000_000.0
AXIS, FLAT = 6378137.0, 1 / 298.257222101
ECC2 = FLAT * (2 - FLAT)
ECC = math.sqrt(ECC2)


def _q(sin_lat):
    """Authalic term of a sine of latitude: a number, or a column."""
    log = math.log if isinstance(sin_lat, float) else F.log
    return (1 - ECC2) * (sin_lat / (1 - ECC2 * sin_lat * sin_lat) - log((1 - ECC * sin_lat) / (1 + ECC * sin_lat)) / (2 * ECC))


def _m(lat: float) -> float:
    return math.cos(lat) / math.sqrt(1 - ECC2 * math.sin(lat) ** 2)


CONE = (_m(PAR1) ** 2 - _m(PAR2) ** 2) / (_q(math.sin(PAR2)) - _q(math.sin(PAR1)))
CONST = _m(PAR1) ** 2 + CONE * _q(math.sin(PAR1))
RHO0 = AXIS * math.sqrt(CONST - CONE * _q(math.sin(LAT0))) / CONE


def albers(lon: Column, lat: Column) -> tuple[Column, Column]:
    """G1: metres of a longitude and latitude in degrees (Snyder 1987, equations 14-1 to 14-6)."""
    rho = F.sqrt(CONST - CONE * _q(F.sin(F.radians(lat)))) * (AXIS / CONE)
    theta = CONE * (F.radians(lon) - LON0)
    return EAST + rho * F.sin(theta), NORTH + RHO0 - rho * F.cos(theta)


def lonlat(x: Column, y: Column) -> tuple[Column, Column]:
    """The inverse of ``albers``; three steps of the series for latitude reach 1e-9 degrees."""
    dx, dy = x - EAST, RHO0 - (y - NORTH)
    rho = F.sqrt(dx * dx + dy * dy)
    q = (CONST - (rho * CONE / AXIS) * (rho * CONE / AXIS)) / CONE
    lat = F.asin(q / 2)
    for _ in range(3):
        s = F.sin(lat)
        w = 1 - ECC2 * s * s
        lat = lat + w * w / (2 * F.cos(lat)) * (q / (1 - ECC2) - s / w + F.log((1 - ECC * s) / (1 + ECC * s)) / (2 * ECC))
    return F.degrees(F.atan2(dx, dy) / CONE + LON0), F.degrees(lat)


def edges(vertices: DataFrame) -> DataFrame:
    """Edges of lines with their length and the distance along the line at which they begin."""
    # vertices that share a number stand in the order of their places, so that a line is the same in every run
    w = Window.partitionBy("line_uid").orderBy("seq", "x", "y")
    rows = vertices.withColumns({"x2": F.lead("x").over(w), "y2": F.lead("y").over(w)}).where("x2 is not null").withColumn("len", F.hypot(F.col("x2") - F.col("x"), F.col("y2") - F.col("y")))
    return rows.withColumn("start", F.sum("len").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("len")).select("line_uid", "seq", F.col("x").alias("x1"), F.col("y").alias("y1"), "x2", "y2", "len", "start")


def along(lines: DataFrame, wanted: DataFrame) -> DataFrame:
    """Points at distances ``at`` along their lines."""
    joined = wanted.join(lines, "line_uid").where((F.col("at") >= F.col("start")) & ((F.col("at") < F.col("start") + F.col("len")) | ((F.col("at") == F.col("start") + F.col("len")) & (F.col("seq") == F.col("last")))))
    t = F.coalesce(F.try_divide(F.col("at") - F.col("start"), F.col("len")), F.lit(0.0))
    return joined.withColumns({"x": F.col("x1") + t * (F.col("x2") - F.col("x1")), "y": F.col("y1") + t * (F.col("y2") - F.col("y1"))})


def foot(x: Column, y: Column) -> Column:
    """Share of an edge at which a point's foot lies, unclamped; 0 on an edge of no length, as a repeated vertex makes."""
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    return F.coalesce(F.try_divide((x - F.col("x1")) * dx + (y - F.col("y1")) * dy, dx * dx + dy * dy), F.lit(0.0))


def offset(x: Column, y: Column) -> Column:
    """Distance of a point from an edge."""
    t = F.least(F.greatest(foot(x, y), F.lit(0.0)), F.lit(1.0))
    return F.hypot(x - (F.col("x1") + t * (F.col("x2") - F.col("x1"))), y - (F.col("y1") + t * (F.col("y2") - F.col("y1"))))


def distance(x: Column, y: Column, edge=None) -> Column:
    """The same for an edge (columns, or a struct) that has its step ``dx``, ``dy`` and ``l2``, the step's square or 1: short enough to be compiled where pairs are many."""
    at = lambda k: F.col(k) if edge is None else edge[k]
    t = F.least(F.greatest(((x - at("x1")) * at("dx") + (y - at("y1")) * at("dy")) / at("l2"), F.lit(0.0)), F.lit(1.0))
    return F.hypot(x - (at("x1") + t * at("dx")), y - (at("y1") + t * at("dy")))


def cells(low: Column, high: Column, size: float) -> Column:
    return F.sequence(F.floor(low / size), F.floor(high / size))


def edges_by_cell(lines: DataFrame, reach: float) -> DataFrame:
    """Each edge in every cell of width ``reach`` that a point within that distance of it can lie in.

    A long edge is followed column by column and cell by cell, so its cells grow with its length and not with its box.
    """
    x1, y1, x2, y2 = (F.col(k) for k in ("x1", "y1", "x2", "y2"))
    span = lambda a, b: cells(F.least(a, b) - reach, F.greatest(a, b) + reach, reach)
    share = lambda at: F.least(F.greatest(F.coalesce(F.try_divide(at - x1, x2 - x1), F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    columns = lines.withColumn("cx", F.explode(span(x1, x2)))
    # the part of the edge within reach of the column, a little wider for rounding; all of it where it is upright
    slack = reach * 1.000001
    ends = [y1 + share(at) * (y2 - y1) for at in (F.col("cx") * reach - slack, (F.col("cx") + 1) * reach + slack)]
    low, high = (F.when(x1 == x2, whole).otherwise(part) for whole, part in ((F.least(y1, y2), F.least(*ends)), (F.greatest(y1, y2), F.greatest(*ends))))
    rows = columns.withColumn("cy", F.explode(cells(low - slack, high + slack, reach)))
    far = offset((F.col("cx") + 0.5) * reach, (F.col("cy") + 0.5) * reach)
    return rows.where(far <= reach * (1.000001 + math.sqrt(0.5)))


#: Points of a cell beyond which it is split, and how often it is halved at most.
FULL, HALVINGS = 20_000, 6


def leaves(points: DataFrame, reach: float, full: int | None = None) -> DataFrame:
    """Where points crowd: of every full cell's occupied smallest squares the leaf of a quadtree that holds them, and its parts.

    A square is a leaf as soon as it holds ``full`` points or fewer; one that still holds more after ``HALVINGS`` is dealt in
    parts by a hash, which splits points on one spot too.  (cx, cy, fx, fy) are the cell and the smallest square, (level, parts).
    """
    full = full or FULL
    counts = _squares(points, reach).groupBy("cx", "cy", "fx", "fy").agg(F.count(F.lit(1)).alias("n"))
    cell = Window.partitionBy("cx", "cy")
    crowded = counts.withColumn("held", F.sum("n").over(cell)).where(F.col("held") > full)
    level = F.lit(HALVINGS)
    for k in reversed(range(1, HALVINGS)):
        side = 1 << (HALVINGS - k)
        held = F.sum("n").over(Window.partitionBy("cx", "cy", F.floor(F.col("fx") / side), F.floor(F.col("fy") / side)))
        level = F.when(held <= full, k).otherwise(level)
    return crowded.withColumn("level", level).withColumn("parts", F.when(F.col("level") == HALVINGS, F.ceil(F.col("n") / full)).otherwise(1).cast("int")).select("cx", "cy", "fx", "fy", "level", "parts")


def _squares(points: DataFrame, reach: float) -> DataFrame:
    """Each point's cell of width ``reach`` and its smallest square in it."""
    side = reach / (1 << HALVINGS)
    last = (1 << HALVINGS) - 1
    within = lambda v, cell: F.least(F.greatest(F.floor((v - cell * reach) / side), F.lit(0)), F.lit(last)).cast("int")
    dealt = points.withColumns({"cx": F.floor(F.col("x") / reach), "cy": F.floor(F.col("y") / reach)})
    return dealt.withColumns({"fx": within(F.col("x"), F.col("cx")), "fy": within(F.col("y"), F.col("cy"))})


def deal(points: DataFrame, others: DataFrame, reach: float, full: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Points and others (which have a cell cx, cy) with a common key ``leaf`` beside the cell, such that no key has many more than ``full`` points.

    An empty leaf is a cell that isn't full.  In a full one, others go to every leaf of the cell that their box ``x_low, x_high, y_low, y_high``, widened by ``reach``, meets, and to every part.
    """
    split = written(leaves(points, reach, full), "leaves")
    side = F.pow(F.lit(2), HALVINGS - F.col("level")).cast("int")
    lx, ly = F.floor(F.col("fx") / side).cast("int"), F.floor(F.col("fy") / side).cast("int")
    split = split.withColumns({"lx": lx, "ly": ly})
    name = lambda part: F.struct(F.col("level"), F.col("lx"), F.col("ly"), part.alias("part"))
    marked = _squares(points, reach).join(split, ["cx", "cy", "fx", "fy"], "left")
    own = F.when(F.col("level").isNotNull(), name(F.pmod(F.xxhash64(*points.columns), F.col("parts")).cast("int")))
    cells_ = split.groupBy("cx", "cy", "level", "lx", "ly").agg(F.max("parts").alias("parts"))
    width = F.lit(reach) / F.pow(F.lit(2), F.col("level"))
    low_x, low_y = F.col("cx") * reach + F.col("lx") * width, F.col("cy") * reach + F.col("ly") * width
    meets = (F.col("x_high") + reach >= low_x) & (F.col("x_low") - reach <= low_x + width) & (F.col("y_high") + reach >= low_y) & (F.col("y_low") - reach <= low_y + width)
    joined = others.join(cells_, ["cx", "cy"], "left").where(F.col("level").isNull() | meets)
    parts = F.when(F.col("level").isNotNull(), F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda k: name(k)))
    dealt = joined.withColumn("leaf", F.explode_outer(parts)).drop("level", "lx", "ly", "parts", "x_low", "x_high", "y_low", "y_high")
    return marked.withColumn("leaf", own).drop("fx", "fy", "level", "parts", "lx", "ly"), dealt


def _leaf_join(left: DataFrame, right: DataFrame, close: Column, how: str = "inner") -> DataFrame:
    """Rows of a common cell and leaf that are close; right names its keys by itself."""
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    keyed = right.withColumn("_leaf", text(F.col("leaf"))).drop("leaf").withColumnsRenamed({"cx": "_cx", "cy": "_cy"})
    same = (F.col("cx") == F.col("_cx")) & (F.col("cy") == F.col("_cy")) & (text(F.col("leaf")) == F.col("_leaf"))
    return left.join(keyed, same & close, how).drop("cx", "cy", "leaf", "_cx", "_cy", "_leaf")


def _boxed(lines: DataFrame, reach: float) -> DataFrame:
    """Edges by cell with their boxes and steps."""
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    steps = lines.withColumns({"dx": dx, "dy": dy, "l2": F.when((dx == 0) & (dy == 0), 1.0).otherwise(dx * dx + dy * dy)})
    return edges_by_cell(steps, reach).withColumns({"x_low": F.least("x1", "x2"), "x_high": F.greatest("x1", "x2"), "y_low": F.least("y1", "y2"), "y_high": F.greatest("y1", "y2")})


def near_edges(points: DataFrame, lines: DataFrame, reach: float, full: int | None = None) -> DataFrame:
    """Pairs of a point and an edge at most ``reach`` apart, with the distance."""
    left, right = deal(points, _boxed(lines, reach), reach, full)
    dist = distance(F.col("x"), F.col("y"))
    return _leaf_join(left, right, dist <= reach).withColumn("dist", dist).drop("dx", "dy", "l2")


#: Keys on one spot that go along as one list.
TOGETHER = 100


def near_edges_of_keys(points: DataFrame, key: str, lines: DataFrame, reach: float, full: int | None = None) -> DataFrame:
    """The same where keys share spots: an edge meets a spot once, with ``keys``, a list of structs of about ``TOGETHER`` of them at most."""
    sizes = points.groupBy("x", "y").agg(F.ceil(F.count(F.lit(1)) / TOGETHER).alias("_lists"))
    dealt = points.select(key, "x", "y").join(sizes, ["x", "y"])
    lists = dealt.groupBy("x", "y", F.pmod(F.xxhash64(key), F.col("_lists")).alias("_list")).agg(F.collect_list(F.struct(key)).alias("keys"))
    return near_edges(written(lists.drop("_list"), "spots"), lines, reach, full)


def places(points: DataFrame, key: str, **sums: Column) -> DataFrame:
    """Distinct places of keys, a row a spot: ``place``, x, y, ``alone``, the number ``n`` of keys there and other sums over them.

    Keys on one spot have all distances in common, so each is worked out once.  A key on several spots has the set of them as its place.
    """
    sets = points.groupBy(key).agg(F.array_sort(F.collect_set(F.struct("x", "y"))).alias("spots"))
    held = written(sets.groupBy("spots").agg(F.count(F.lit(1)).alias("n"), *(v.alias(k) for k, v in sums.items())).withColumn("place", F.monotonically_increasing_id()), "places")
    return held.select("place", "n", *sums, (F.size("spots") == 1).alias("alone"), F.explode("spots").alias("spot")).select("place", "spot.x", "spot.y", "alone", "n", *sums)


def near_lines(spots: DataFrame, lines: DataFrame, reach: float, keep=None, full: int | None = None) -> DataFrame:
    """Each place and line at most ``reach`` apart once, with the least distance of those edges that ``keep(x, y, edge)`` lets pass.

    A cell's spots are held, and its edges stream by, line after line, and meet them as arrays; only places of several spots are grouped afterwards.
    """
    left, right = deal(spots, _boxed(lines, reach), reach, full)
    text = F.coalesce(F.col("leaf").cast("string"), F.lit("")).alias("leaf")
    kept = [k for k in spots.columns if k not in ("x", "y", "alone")]
    values = [k for k in ("x1", "y1", "dx", "dy", "l2", "seq", "last") if k in right.columns]
    own = left.select("cx", "cy", text, F.struct("x", "y", "alone", *kept).alias("spot"))
    edge = right.select("cx", "cy", text, "line_uid", F.struct(*values).alias("edge"))
    # the cell's spots, without a line, come before its edges
    rows = own.unionByName(edge, allowMissingColumns=True).repartition("cx", "cy", "leaf").sortWithinPartitions("cx", "cy", "leaf", F.col("spot").isNull(), "line_uid")
    out = spots.select(*kept, "alone").schema.add("line_uid", "string").add("dist", "double")
    found = rows.select("cx", "cy", "leaf", "spot", "line_uid", "edge").mapInArrow(_met(kept, values, reach, keep, to_arrow_schema(out)), out)
    sets = found.where(~F.col("alone")).groupBy(*kept, "line_uid").agg(F.min("dist").alias("dist"))
    return found.where("alone").select(*kept, "line_uid", "dist").unionByName(sets)


#: Pairs of a spot and an edge that are worked out at once.
PAIRS = 400_000


def _met(kept: list[str], values: list[str], reach: float, keep, schema: pa.Schema):
    """Rows of cells, the spots of each before its edges in the order of lines, to pairs of a spot and a line with the least distance of their edges."""

    def pairs(spots: pa.RecordBatch, names: pa.Array, edges: dict[str, np.ndarray], first: np.ndarray) -> Iterator[pa.RecordBatch]:
        most = max(PAIRS // len(edges["x1"]), 1)
        for at in range(0, spots.num_rows, most):
            some = spots.slice(at, most)
            x, y = (some.column(k).to_numpy(zero_copy_only=False)[:, None] for k in ("x", "y"))
            t = np.clip(((x - edges["x1"]) * edges["dx"] + (y - edges["y1"]) * edges["dy"]) / edges["l2"], 0.0, 1.0)
            far = np.hypot(x - (edges["x1"] + t * edges["dx"]), y - (edges["y1"] + t * edges["dy"]))
            if keep is not None:
                far = np.where(keep(x, y, edges), far, np.inf)
            least = np.fmin.reduceat(far, first, axis=1)
            spot, line = np.nonzero(least <= reach)
            if len(spot):
                columns = [some.column(k).take(pa.array(spot)) for k in (*kept, "alone")]
                yield pa.RecordBatch.from_arrays([*columns, names.take(pa.array(first[line])), pa.array(least[spot, line])], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, spots, rest = None, [], None

        def solve(rows: pa.RecordBatch, last: bool) -> Iterator[pa.RecordBatch]:
            """Edges of whole lines meet the cell's spots; what may be a part of a line is left for the next batch."""
            nonlocal rest
            rows = rows if rest is None else pa.concat_batches([rest, rows])
            rest, names = None, rows.column("line_uid")
            codes = names.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
            first = np.flatnonzero(np.diff(codes, prepend=codes[:1] - 1)) if len(codes) else codes
            end = rows.num_rows if last or not len(first) else int(first[-1])
            if end < rows.num_rows:
                rest, rows, first = rows.slice(end), rows.slice(0, end), first[first < end]
            if rows.num_rows and spots:
                struct = rows.column("edge")
                edges = {k: struct.field(k).to_numpy(zero_copy_only=False) for k in values}
                for held in spots:
                    yield from pairs(held, rows.column("line_uid"), edges, first)

        for batch in batches:
            keys = [batch.column(k).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False) for k in ("cx", "cy", "leaf")]
            cut = [0, *(np.flatnonzero(np.any([np.diff(k) != 0 for k in keys], axis=0)) + 1).tolist(), batch.num_rows] if batch.num_rows else []
            for low, high in zip(cut, cut[1:], strict=False):
                part = batch.slice(low, high - low)
                key = [part.column(k)[0].as_py() for k in ("cx", "cy", "leaf")]
                if key != cell:
                    if rest is not None:
                        yield from solve(rest.slice(0, 0), True)
                    cell, spots, rest = key, [], None
                known = part.column("spot").is_valid()
                if known.true_count:
                    spots.append(pa.RecordBatch.from_struct_array(part.filter(known).column("spot")))
                if known.false_count:
                    yield from solve(part.filter(pc.invert(known)), False)
        if rest is not None:
            yield from solve(rest.slice(0, 0), True)

    return run


def nearest_line(points: DataFrame, lines: DataFrame, key: str, cap: float) -> DataFrame:
    """The nearest line within a cap, of equals the first name, and the distance along it.

    Each distinct spot is asked once: first for its least distance, which only keeps a number, then for the edges at that distance;
    within a quarter of the cap, and those that have no line so near within all of it.
    """
    at = F.col("start") + F.least(F.greatest(foot(F.col("x"), F.col("y")), F.lit(0.0)), F.lit(1.0)) * F.col("len")
    edge = written(lines, "edges").repartition("line_uid", "seq")
    rest, best = written(points.select("x", "y").distinct(), "spots"), None
    for reach in (cap / 4, cap):
        least = written(near_edges(rest, edge, reach).groupBy("x", "y").agg(F.min("dist").alias("least")), "least")
        some = near_edges(least, edge, reach).where("dist <= least").select("x", "y", F.struct("dist", "line_uid", "seq", at.alias("at")).alias("b"))
        rest, best = rest.join(least, ["x", "y"], "left_anti"), some if best is None else best.unionByName(some)
    found = points.select(key, "x", "y").join(best.groupBy("x", "y").agg(F.min("b").alias("b")), ["x", "y"])
    return found.groupBy(key).agg(F.min("b").alias("b")).select(key, "b.line_uid", "b.dist", "b.at")


def inside(points: DataFrame, polygon_edges: DataFrame, key: str, band: float) -> DataFrame:
    """The regions a point lies in, by the parity of edges to its right; bands of y are the join key."""
    dealt = polygon_edges.where("y1 <> y2").withColumn("by", F.explode(cells(F.least("y1", "y2"), F.greatest("y1", "y2"), band)))
    y = F.col("y")
    crosses = ((F.col("y1") > y) != (F.col("y2") > y)) & (F.col("x") < (F.col("x2") - F.col("x1")) * (y - F.col("y1")) / (F.col("y2") - F.col("y1")) + F.col("x1"))
    return points.withColumn("by", F.floor(y / band)).join(dealt, "by").where(crosses).groupBy(key, "region").agg(F.count(F.lit(1)).alias("n")).where("n % 2 = 1").select(key, "region")


def pairs_within(a: DataFrame, b: DataFrame, radius: float, full: int | None = None, apart: Column | None = None, how: str = "inner") -> DataFrame:
    """Pairs of points (b's columns x, y named x2, y2) at most ``radius`` apart for which ``apart`` holds too; ``left_semi`` asks only which of a have one."""
    around = b.select("*", F.explode(cells(F.col("x2") - radius, F.col("x2") + radius, radius)).alias("cx")).withColumn("cy", F.explode(cells(F.col("y2") - radius, F.col("y2") + radius, radius)))
    left, right = deal(a, around.withColumns({"x_low": F.col("x2"), "x_high": F.col("x2"), "y_low": F.col("y2"), "y_high": F.col("y2")}), radius, full)
    close = F.hypot(F.col("x") - F.col("x2"), F.col("y") - F.col("y2")) <= radius
    return _leaf_join(left, right, close if apart is None else close & apart, how)


def counts_within(points: DataFrame, key: str, zones: dict[str, tuple[float, float]], unit: float = 1.0) -> DataFrame:
    """A row a key with the number of points of other keys in each zone (name -> least distance, and that beyond it, in units).

    Points on one spot have all distances in common, so spots are paired with their counts; what a key's own points add to them is taken off.
    """
    dist = F.hypot(F.col("x") - F.col("x2"), F.col("y") - F.col("y2")) / unit
    summed = lambda n: [F.sum(F.when((dist >= low) & (dist < high), n).otherwise(0)).alias(z) for z, (low, high) in zones.items()]
    held = written(points.groupBy(key, "x", "y").agg(F.count(F.lit(1)).alias("_k")), "spots")
    spots = written(held.where(F.col(key).isNotNull()).groupBy("x", "y").agg(F.sum("_k").alias("_k")), "spots")
    second = {"x": "x2", "y": "y2", "_k": "_k2"}
    around = pairs_within(spots, spots.withColumnsRenamed(second), unit * max(high for _, high in zones.values())).groupBy("x", "y").agg(*summed(F.col("_k2")))
    whole = held.join(around, ["x", "y"], "left").groupBy(key).agg(*(F.sum(F.col("_k") * F.coalesce(F.col(f"`{z}`"), F.lit(0))).alias(z) for z in zones))
    own = held.join(held.withColumnsRenamed(second), key).groupBy(key).agg(*summed(F.col("_k") * F.col("_k2")))
    both = whole.join(own.withColumnsRenamed({z: f"_own{z}" for z in zones}), key, "left")
    return both.select(key, *(F.when(F.col(key).isNotNull(), F.col(f"`{z}`") - F.coalesce(F.col(f"`_own{z}`"), F.lit(0))).otherwise(0).alias(z) for z in zones))


def set_key(members: Column) -> Column:
    """A key of a set whatever the order of its members: their number and two sums of hashes; equal sets have equal keys, and equal keys are verified."""
    total = lambda seed: F.aggregate(members, F.lit(0).cast("long"), lambda a, m: a.bitwiseXOR(F.xxhash64(F.lit(seed), m)))
    return F.struct(F.size(members).alias("n"), total(1).alias("a"), total(2).alias("b"))


def match_sets(found: DataFrame, recorded: DataFrame) -> DataFrame:
    """Sets that were found beside those on record (both a column ``members`` of distinct values), a row a set: ``found``, ``recorded``."""
    keyed = lambda df, name: df.select(F.array_sort(F.array_distinct("members")).alias("members")).withColumn("_key", set_key(F.col("members"))).dropDuplicates(["_key", "members"]).select("_key", F.col("members").alias(name))
    a, b = keyed(found, "_a"), keyed(recorded, "_b").withColumnRenamed("_key", "_own")
    joined = a.join(b, (F.col("_key") == F.col("_own")) & (F.col("_a") == F.col("_b")), "full")
    return joined.select(F.coalesce("_a", "_b").alias("members"), F.col("_a").isNotNull().alias("found"), F.col("_b").isNotNull().alias("recorded"))


def band(dist: Column, limits: list[float]) -> Column:
    """Name of the distance band, null beyond the last limit."""
    out = None
    for low, high in zip(limits, limits[1:], strict=False):
        test = dist < high
        out = F.when(test, f"{low:g}-{high:g}") if out is None else out.when(test, f"{low:g}-{high:g}")
    return out


def getis_ord(points: DataFrame, key: str, value: str, radius: float) -> DataFrame:
    """Gi* z-scores over neighbours within ``radius``, the point included, and bins of 90, 95 and 99 percent; null where values or neighbours don't differ."""
    # points on one spot have the same neighbours, so spots are paired; a key on several spots adds up theirs
    spots = written(points.groupBy("x", "y").agg(F.sum(value).alias("_v"), F.count(F.lit(1)).alias("_k")), "spots")
    others = spots.select(F.col("x").alias("x2"), F.col("y").alias("y2"), F.col("_v").alias("_v2"), F.col("_k").alias("_k2"))
    around = pairs_within(spots, others, radius).groupBy("x", "y").agg(F.sum("_v2").alias("_s"), F.sum("_k2").alias("_w"))
    sums = points.select(key, "x", "y").join(around, ["x", "y"]).groupBy(key).agg(F.sum("_s").alias("s"), F.sum("_w").alias("w"))
    whole = points.agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"))
    z = F.try_divide(F.col("s") - F.col("mean") * F.col("w"), F.col("sd") * F.sqrt(F.try_divide(F.col("n") * F.col("w") - F.col("w") * F.col("w"), F.col("n") - 1)))
    rows = sums.crossJoin(F.broadcast(whole)).withColumn("z", z)
    size = F.when(F.abs("z") >= 2.576, 3).when(F.abs("z") >= 1.96, 2).when(F.abs("z") >= 1.645, 1).otherwise(0)
    return rows.select(key, "z", (F.signum("z") * size).cast("int").alias("bin"))


def draw_from_group(rows: DataFrame, group: list[str], key: str, most: int, seed: int, pool: DataFrame | None = None) -> DataFrame:
    """For each row up to ``most`` others of its group, (key, other, turn), from the rows themselves or from a pool with the same columns.

    A group's members stand in one hashed order; each row takes those that follow a hashed place of its own, around the end.
    So a row meets the few that it takes and never its whole group.
    """
    members = rows if pool is None else pool
    placed = written(ranks.numbered(members.select(*group, key).withColumn("_h", hashed(seed, key)), group, ["_h", key], "_n"), "pool")
    asking = rows.select(*group, key).join(placed.groupBy(*group).agg(F.max("_n_total").alias("_all")), group)
    start = draw(seed, F.lit("from"), key) % F.col("_all")
    turns = asking.withColumn("turn", F.explode(F.sequence(F.lit(0), F.least(F.lit(most), F.col("_all") - 1).cast("int")))).withColumn("_n", F.pmod(start + F.col("turn"), F.col("_all")) + 1)
    found = turns.select(*group, key, "turn", "_n").join(placed.select(*group, "_n", F.col(key).alias("other")), [*group, "_n"]).where(F.col(key) != F.col("other"))
    order = Window.partitionBy(key).orderBy("turn")
    return found.withColumn("turn", F.row_number().over(order)).where(F.col("turn") <= most).select(key, "other", "turn")
