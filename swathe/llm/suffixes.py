"""Removal of passages that occur twice, found with suffix arrays.

A byte is removed when a string of ``length`` bytes that covers it starts at another place too, in any document.  Every
window of that length picks its least-hashed k-gram, so equal windows share that k-gram at one offset.  Windows of one
document with one k-gram form a span.  Spans are dealt out by k-gram: equal windows meet in one group, whatever the
machine.  Equal spans are counted before anything is exchanged.  Spans of a group that differ are cut into parts whose
windows hold some bytes in common; parts that share those bytes with another are set side by side, and a suffix array over
them shows which of their windows are equal.

The array is built by linear grouping.  Suffixes are grouped by their Lyndon prefix: groups are processed in descending
order, and each extends the prefix of the suffixes that its members' previous-smaller pointers lead to.  One more pass
then emits every group's order, with no renaming and no recursion.

A group of very many parts (a passage at whose edge every copy differs) isn't put into one task: its windows are
hashed and counted, which splits over machines and gives the same answer: where a part is one window, its core is the window
and counting is all that an array of it could tell.

What counts as equal without a look at the bytes has two 64-bit hashes the same, that of the k-gram and that of the span or of
the window with its group; parts of a suffix array are compared byte by byte.

Defined cases: a null text is empty; texts shorter than ``length`` keep all; equal rows are copies of one another, so a
repeated row of ``length`` bytes or more loses all; a very long text is hashed in overlapping chunks; an empty table gives no
rows; other columns are not read, and ``rewrite`` keeps them, whatever their names.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import column, id_and_text, map_rows, materialize

LENGTH = 200
GRAM = 32
NO_ID = -(1 << 63)
#: Bytes of text hashed at once, with ``LENGTH - 1`` of overlap.
CHUNK = 1 << 21
#: Symbols in one suffix array.
BLOCK = 1 << 16
#: A span is compared in so many parts.
PARTS = 8
#: Parts of one group beyond which its windows are counted by hash.
WIDE = 1000


# --- suffix array ----------------------------------------------------------------------------------------------------


def suffix_array(text: bytes | list[int]) -> list[int]:
    """Start positions of all suffixes in order, by linear grouping."""
    return _emit(len(text), *lyndon_groups(text)) if text else []


def lyndon_groups(text: bytes | list[int]) -> tuple[list[list[int]], list[int], list[int], list[int]]:
    """Suffixes grouped by their Lyndon prefix: the groups, the length of each one's prefix, each suffix's group, and the groups in descending order.

    A suffix's Lyndon prefix is the longest Lyndon word that starts there, so ``width[of[i]]`` is the Lyndon array.
    """
    n = len(text)
    members: dict[int, list[int]] = {}
    for i, c in enumerate(text):
        members.setdefault(c, []).append(i)
    groups = [members[c] for c in sorted(members)]
    below = list(range(-1, len(groups) - 1))  # the groups are a linked list
    above = [*range(1, len(groups)), -1]
    width = [1] * len(groups)  # length of the group's Lyndon prefix
    of = [0] * n
    for g, ms in enumerate(groups):
        for i in ms:
            of[i] = g
    done = [False] * len(groups)
    smaller = [-1] * n  # previous-smaller pointers of the suffixes in processed groups
    final: list[int] = []
    g = len(groups) - 1
    while g >= 0:
        ms = [i for i in groups[g] if of[i] == g]
        ms.sort()
        done[g] = True
        # of every suffix that is led to: how many members lead there, one behind another
        led: dict[int, int] = {}
        for i in ms:
            p = i - 1
            while p >= 0 and done[of[p]]:
                if of[p] == g:
                    p = smaller[p]
                    break
                p = smaller[p]
            smaller[i] = p
            if p >= 0:
                led[p] = led.get(p, 0) + 1
        # each old group splits by that number; the larger stand higher, all above what is left
        split: dict[tuple[int, int], list[int]] = {}
        for p, k in led.items():
            split.setdefault((-k, of[p]), []).append(p)
        for (k, old), ps in sorted(split.items()):
            new, upper = len(groups), above[old]
            groups.append(ps)
            done.append(False)
            width.append(width[old] - k * width[g])
            below.append(old)
            above.append(upper)
            above[old] = new
            if upper >= 0:
                below[upper] = new
            for p in ps:
                of[p] = new
        if ms:
            final.append(g)
        groups[g] = ms
        g = below[g]
    return groups, width, of, final


def _emit(n: int, groups: list[list[int]], width: list[int], of: list[int], final: list[int]) -> list[int]:
    """Each group's suffixes in the order of the suffixes that follow their Lyndon prefixes."""
    at: dict[int, int] = {}
    total = 0
    for g in reversed(final):
        at[g] = total
        total += len(groups[g])
    waiting: list[list[int] | None] = [None] * (n + 1)
    for i in range(n):
        follower = i + width[of[i]]
        if waiting[follower] is None:
            waiting[follower] = [i]
        else:
            waiting[follower].append(i)
    order = [-1] * n
    for k in range(-1, n):
        for i in waiting[order[k] if k >= 0 else n] or ():
            g = of[i]
            order[at[g]] = i
            at[g] += 1
    return order


def share_prefix(text: list[int], order: list[int], length: int) -> list[bool]:
    """Whether each suffix shares its first ``length`` bytes with the one before it in order."""
    last = len(text) - length
    out, before = [], None
    for i in order:
        own = text[i : i + length] if i <= last else None
        out.append(own is not None and own == before)
        before = own
    return out


def repeated_windows(spans: list[bytes | list[int]], length: int = LENGTH) -> list[list[tuple[int, int]]]:
    """For each span, the runs [from, to) of its window starts whose ``length`` symbols start elsewhere in the spans too."""
    text = [x for s in spans for x in s]
    first, owner = [], []
    for k, s in enumerate(spans):
        first.append(len(owner))
        owner.extend([k] * len(s))
    order = suffix_array(text)
    alike = share_prefix(text, order, length)
    marked: list[list[int]] = [[] for _ in spans]
    run: list[int] = []

    def close() -> None:
        if len(run) > 1:
            for i in run:
                k = owner[i]
                marked[k].append(i - first[k])

    for k, i in enumerate(order):
        if not alike[k]:
            close()
            run = []
        s = owner[i]
        if i - first[s] + length <= len(spans[s]):  # a window of its own span
            run.append(i)
    close()
    return [_runs(sorted(m)) for m in marked]


def _runs(starts: list[int]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for x in starts:
        if out and out[-1][1] == x:
            out[-1] = (out[-1][0], x + 1)
        else:
            out.append((x, x + 1))
    return out


# --- spans -----------------------------------------------------------------------------------------------------------


def spans_of(data: bytes, length: int = LENGTH, gram: int = GRAM) -> Iterator[tuple[int, int, int, int]]:
    """(first window, number of windows, place of their k-gram after the first window, its hash); in order, every window once."""
    reach = length - gram + 1
    for base in range(0, max(len(data) - length + 1, 0), CHUNK):
        part = data[base : base + CHUNK + length - 1]
        raw = np.frombuffer(part + b"\0" * 8, np.uint8)
        eight = np.ndarray(len(part), "<u8", raw, strides=(1,))
        n = len(part) - gram + 1
        h = np.zeros(n, np.uint64)
        for k in range(0, gram, 8):
            h = (h ^ eight[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        # the least hash of each reach, the leftmost of equals: places in the low bits break ties
        bits = np.uint64(CHUNK.bit_length())
        low = ((h * np.uint64(0xFF51AFD7ED558CCD)) >> bits << bits) | np.arange(n, dtype=np.uint64)
        width = 1
        while 2 * width <= reach:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        if reach > width:
            low = np.minimum(low[: len(low) - (reach - width)], low[reach - width :])
        where = (low & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
        cuts = np.flatnonzero(np.diff(where)) + 1
        starts = np.concatenate([[0], cuts])
        ends = np.concatenate([cuts, [len(where)]])
        for s, e, p, a in zip(starts.tolist(), ends.tolist(), where[starts].tolist(), h.view(np.int64)[where[starts]].tolist(), strict=True):
            yield base + s, e - s, p - s, a


def reach_of(length: int, gram: int) -> int:
    """Window starts that a part spans at most."""
    return max(1, (length - gram) // PARTS)


def parts_of(data: bytes, start: int, count: int, place: int, anchor: int, length: int, reach: int) -> Iterator[tuple[int, int, int, bytes]]:
    """(first window, number of windows, place of the core in it, group and core) of a span's parts; all windows of a part hold its core.

    Parts are cut at fixed distances before the k-gram, so windows that are equal are in parts of the same bytes.
    """
    at = start + place
    for k in range((place - count + 1) // reach, place // reach + 1):
        low, high = max(place - count + 1, k * reach), min(place, k * reach + reach - 1)
        yield at - high, high - low + 1, high - k * reach, b"%d %d " % (anchor, k) + data[at - k * reach : at - k * reach - reach + 1 + length]


def _spans(docs: DataFrame, length: int, gram: int) -> DataFrame:
    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        from xxhash import xxh3_64_intdigest, xxh32_intdigest

        for doc_id, text in rows:
            data = text.encode()
            own = xxh32_intdigest(data) - (1 << 31)
            for start, count, place, anchor in spans_of(data, length, gram):
                yield doc_id, own, start, count, place, anchor, xxh3_64_intdigest(data[start : start + count + length - 1]) - (1 << 63)

    return map_rows(docs, ["doc_id", "text"], run, "doc long, own int, start int, count int, place int, anchor long, span long")


def _packed(docs: DataFrame, others: tuple[str, ...] = ()) -> DataFrame:
    """Texts compressed for the exchange, with other columns of ``docs`` as they are."""

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        import zstandard
        from xxhash import xxh32_intdigest

        squeeze = zstandard.ZstdCompressor(level=1)
        for doc_id, text, *kept in rows:
            data = text.encode()
            yield doc_id, xxh32_intdigest(data) - (1 << 31), squeeze.compress(data), *kept

    return map_rows(docs, ["doc_id", "text", *others], run, _and("doc long, own int, packed binary", docs, others))


def _and(ddl: str, df: DataFrame, names: tuple[str, ...]) -> T.StructType:
    """A schema with columns of ``df`` behind it, whatever their kinds."""
    return T.StructType(T.StructType.fromDDL(ddl).fields + [T.StructField(x, df.schema[x].dataType) for x in names])


def _with_text(wanted: DataFrame, docs: DataFrame, columns: list[str]) -> DataFrame:
    """The wanted rows of a document as a list beside its compressed text."""
    lists = wanted.groupBy("doc", "own").agg(F.collect_list(F.struct(*columns)).alias("wanted"))
    return _packed(docs).join(lists, ["doc", "own"])


def _parts(spans: DataFrame, docs: DataFrame, length: int, gram: int) -> DataFrame:
    """Parts of the spans, with a hash of the bytes that a part's windows all hold."""
    reach = reach_of(length, gram)

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        import zstandard
        from xxhash import xxh3_64_intdigest

        open_up = zstandard.ZstdDecompressor()
        for doc, own, packed, spans in rows:
            data = open_up.decompress(packed)
            for s in spans:
                for first, windows, lead, core in parts_of(data, s["start"], s["count"], s["place"], s["anchor"], length, reach):
                    yield doc, own, first, windows, lead, xxh3_64_intdigest(core) - (1 << 63), s["n"]

    return map_rows(_with_text(spans, docs, ["start", "count", "place", "anchor", "n"]), ["doc", "own", "packed", "wanted"], run, "doc long, own int, first int, windows int, lead int, core long, n long")


def _cut(parts: DataFrame, docs: DataFrame, length: int) -> DataFrame:
    """The bytes of the parts."""

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        import zstandard

        open_up = zstandard.ZstdDecompressor()
        for doc, own, packed, parts in rows:
            data = open_up.decompress(packed)
            for p in parts:
                yield doc, own, p["first"], p["lead"], p["core"], p["wide"], p["n"], data[p["first"] : p["first"] + p["windows"] + length - 1]

    return map_rows(_with_text(parts, docs, ["first", "windows", "lead", "core", "wide", "n"]), ["doc", "own", "packed", "wanted"], run, "doc long, own int, first int, lead int, core long, wide boolean, n long, bytes binary")


def _by_suffix_array(cut: DataFrame, length: int, reach: int) -> DataFrame:
    """Window runs of single spans' parts that also occur in another part of their group.

    The core that a group shares stands as one symbol of its own in the suffix array, so a window is ``reach`` symbols there.
    """
    dealt = cut.repartition("core").sortWithinPartitions("core")
    held_by_all = length - reach + 1

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        groups: list[list[list[tuple]]] = []
        size = 0

        def found(same: list[tuple], runs: list[tuple[int, int]]) -> Iterator[tuple]:
            for doc, own, first, _, _, n, data in same:
                if n == 1:
                    for a, b in [(0, len(data) - length + 1)] if len(same) > 1 else runs:
                        yield doc, own, first + a, first + b - 1 + length

        def solve() -> Iterator[tuple]:
            alike = [same for group in groups for same in group]
            symbols = [[*same[0][6][: same[0][3]], 256 + k, *same[0][6][same[0][3] + held_by_all :]] for k, group in enumerate(groups) for same in group]
            for same, runs in zip(alike, repeated_windows(symbols, reach), strict=True):
                yield from found(same, runs)

        for _, members in itertools.groupby(rows, key=lambda row: row[4]):
            by_core: dict[bytes, dict[tuple, list[tuple]]] = {}
            for row in members:
                by_core.setdefault(row[6][row[3] : row[3] + held_by_all], {}).setdefault((row[3], row[6]), []).append(row)
            for group in by_core.values():
                if len(group) == 1:  # the same bytes throughout
                    yield from found(*group.values(), [])
                    continue
                groups.append([*group.values()])
                size += sum(len(data) - held_by_all + 1 for _, data in group)
            if size >= BLOCK:
                yield from solve()
                groups, size = [], 0
        yield from solve()

    return map_rows(dealt, ["doc", "own", "first", "lead", "core", "n", "bytes"], run, "doc long, own int, begin int, end int")


def _by_counting(cut: DataFrame, length: int) -> DataFrame:
    """The same for wide groups: windows are hashed and counted."""

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        from xxhash import xxh3_64_intdigest

        for doc, own, first, core, n, data in rows:
            for k in range(len(data) - length + 1):
                yield doc, own, first + k, n, xxh3_64_intdigest(data[k : k + length], core & 0xFFFFFFFF) - (1 << 63)

    windows = materialize(map_rows(cut, ["doc", "own", "first", "core", "n", "bytes"], run, "doc long, own int, first int, n long, hash long"), "windows")
    often = windows.groupBy("hash").agg(F.sum("n").alias("all")).where("all > 1").drop("all")
    return windows.where("n = 1").join(often, "hash", "left_semi").select("doc", "own", F.col("first").alias("begin"), (F.col("first") + length).alias("end"))


def repeated_ranges(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(doc, own, begin, end): byte ranges that repeated strings cover, of rows with ``doc_id`` and ``text``; they may overlap.

    ``own`` is a short hash of the text, so that a repeated id with another text is another document.
    """
    spans = materialize(_spans(docs, length, gram), "spans")
    shared = spans.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.min("span").alias("least"), F.max("span").alias("most")).where("n > 1")
    # written first: a join of two tables, and not of a table and its own sums, can split the partition of a hot k-gram
    shared = materialize(shared.select("anchor", (F.col("least") == F.col("most")).alias("same")), "anchors")
    known = materialize(spans.join(shared.hint("merge"), "anchor"), "shared")
    covered = lambda df: df.select("doc", "own", F.col("start").alias("begin"), (F.col("start") + F.col("count") + length - 1).alias("end"))
    mixed = known.where("not same")
    kinds = materialize(mixed.groupBy("anchor", "span").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc", "own", "start", "count", "place")).alias("at")).select("anchor", "span", "n", "at.*"), "kinds")
    often = kinds.where("n > 1").select("anchor", "span")
    parts = materialize(_parts(kinds, docs, length, gram), "parts")
    groups = parts.groupBy("core").agg(F.count(F.lit(1)).alias("size"), F.min("n").alias("least")).where("size > 1 and least = 1")
    cut = materialize(_cut(parts.join(groups.select("core", (F.col("size") > WIDE).alias("wide")), "core"), docs, length), "cut")
    singles = _by_suffix_array(cut.where("not wide"), length, reach_of(length, gram)).unionByName(_by_counting(cut.where("wide"), length))
    return covered(known.where("same")).unionByName(covered(mixed.join(often.hint("merge"), ["anchor", "span"], "left_semi"))).unionByName(singles)


def kept_bytes(data: bytes, ranges: list) -> tuple[bytes, int, int]:
    """What is left outside the ranges, how many bytes go and in how many maximal runs."""
    left, at, removed, runs = [], 0, 0, 0
    begin = end = -1
    for a, b in sorted((r["begin"], r["end"]) for r in ranges):
        if a > end:
            if end > begin:
                left.append(data[at:begin])
                at, removed, runs = end, removed + end - begin, runs + 1
            begin, end = a, b
        else:
            end = max(end, b)
    if end > begin:
        left.append(data[at:begin])
        at, removed, runs = end, removed + end - begin, runs + 1
    left.append(data[at:])
    return b"".join(left), removed, runs


def remove_repeated(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, columns: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans``, the bytes ``kept`` and the named ``columns`` of every row."""
    others = tuple(f"_{k}" for k in range(len(columns)))
    named = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *(column(c).alias(o) for c, o in zip(columns, others, strict=True)))
    ranges = repeated_ranges(named.select("doc_id", "text"), length, gram).groupBy("doc", "own").agg(F.collect_list(F.struct("begin", "end")).alias("ranges"))
    joined = _packed(named, others).join(ranges, ["doc", "own"], "left")

    def run(parts: Iterator[tuple]) -> Iterator[tuple]:
        import zstandard

        open_up = zstandard.ZstdDecompressor()
        for doc, packed, ranges, *others in parts:
            data = open_up.decompress(packed)
            kept, removed, runs = kept_bytes(data, ranges or [])
            yield None if doc == NO_ID else doc, len(data), removed, runs, kept, *others

    schema = _and("doc_id long, n_bytes long, n_removed long, n_spans long, kept binary", named, others)
    return map_rows(joined, ["doc", "packed", "ranges", *others], run, schema)


def digest(removed: DataFrame) -> DataFrame:
    return removed.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def rewrite(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """All columns of the rows that keep something, ``text`` without its repeated bytes and ``n_chars`` to match.

    A character of which only a part repeats goes as a whole.  Rows that were empty before stay.
    """
    columns = tuple(c for c in docs.columns if c != "text")
    found = remove_repeated(docs, length, gram, columns).where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_bytes")))
    text = F.try_validate_utf8(F.col("kept").cast("string"))
    whole = found.withColumn("_text", F.coalesce(text, _valid(F.col("kept"))))
    named = {c: F.col(f"_{k}") for k, c in enumerate(columns)} | {"text": F.col("_text")}
    if "n_chars" in named:
        named["n_chars"] = F.char_length("_text").cast(docs.schema["n_chars"].dataType)
    return whole.select(*(named[c].alias(c) for c in docs.columns))


def _valid(data: F.Column) -> F.Column:
    """The bytes as text, without parts of characters."""
    return F.replace(F.make_valid_utf8(data.cast("string")), F.lit("\ufffd"), F.lit(""))
