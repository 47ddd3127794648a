"""Documents linked by the Jaccard likeness of their word n-grams, and the components of those links.

Equal sets are one set from the start.  A set's n-grams are dealt by hash into parts, as many for all sets of a size step, so
many that a link leaves some of them equal whatever n-grams differ; those parts that say most of a text, by a sketch of fixed
size that counts n-grams over all texts, are its signatures.  Two linked sets share one, and sets that aren't alike hardly
ever do, as all n-grams of a part must be the same, even where the table is so large that the sketch can't tell rare n-grams.
Sizes of linked sets are of one step or of neighbours.  A task keeps one row for each signature it has met and turns the others
into edges at once, so a hot group reaches the exchange as one row a task.  What signatures connect is only a candidate group;
inside, a prefix tree decides.  It holds the sets in the order of the sketch and of hashes, frequent n-grams first, so sets
with much in common share a path.  A set is looked up by walking the tree with the overlap so far, and a subtree is left as
soon as the n-grams that remain on either side can't reach the overlap that a link needs.

A large candidate group is cut by size into steps so wide that linked sets are of one step or of neighbours, and a step into
blocks; every two blocks that can be linked are joined in a task of their own.

Defined cases: a null or empty text, or one without words, has the empty set and is linked with nothing; a text with fewer
words than an n-gram is one n-gram; equal rows are linked if they have an n-gram; a very long text is read whole by one task;
an empty table gives no rows; other columns are not read, and ``one_of_each`` keeps them, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.files import drop
from .common import column, free_name, id_and_text, map_rows, materialize, written
from .fingerprints import WordHashes, mix, shingle_hashes

GRAM_WORDS = 3
#: A link needs 100 * intersection >= PERCENT * union.
PERCENT = 90
#: Counters of the sketch, a byte each: about so many a document, within limits, as the sketch goes to every task.  It only says which parts are
#: better signatures; with 190 n-grams a counter candidate groups were as with 3.
COUNTERS_PER_DOC, LEAST_BITS, MOST_BITS = 128, 16, 22
#: Levels that a doubling of a count is.
STEEP = 6
#: Counters that one row of the sketch has.
CHUNK_BITS = 16
#: Sets, and n-grams of all of them, in a block of a large candidate group.
BLOCK_SETS, BLOCK_GRAMS = 1500, 750_000
#: Signatures, and pairs of sets, that a task remembers; it forgets all when there are more and begins anew.
SEEN, TOLD = 120_000, 60_000


# --- the global order ------------------------------------------------------------------------------------------------


class Order:
    """N-grams by level, a logarithm of how often the sketch has counted what shares their counter, then by hash."""

    def __init__(self, levels: np.ndarray, n_texts: int = 0):
        self.levels, self.shift, self.top = levels, np.uint64(65 - len(levels).bit_length()), int(STEEP * np.log2(1 + n_texts))

    def level(self, grams: np.ndarray) -> np.ndarray:
        return self.levels[(grams >> self.shift).astype(np.int64)]

    def sorted(self, grams: np.ndarray) -> np.ndarray:
        """The n-grams, rare ones first."""
        return grams[np.lexsort((grams, self.level(grams)))]

    def weights(self, grams: np.ndarray) -> np.ndarray:
        """How much each n-gram says of a text: the logarithm of how few texts have it."""
        return np.maximum(self.top - self.level(grams).astype(np.int64), 1)


def learn_order(rows: DataFrame, k: int) -> Order:
    """Counts of all n-grams of all texts in a sketch: each task sums its own, then the tasks' sketches are summed chunk by chunk."""
    n_texts = rows.count()
    bits = min(max(LEAST_BITS, (COUNTERS_PER_DOC * n_texts).bit_length()), MOST_BITS)
    chunk = 1 << min(bits, CHUNK_BITS)

    def count(parts: Iterator[tuple]) -> Iterator[tuple]:
        import zstandard

        hashes, squeeze, counts, held, size = WordHashes(), zstandard.ZstdCompressor(level=1), np.zeros(1 << bits, np.uint8), [], 0

        def add() -> None:
            if held:
                at, n = np.unique((np.concatenate(held) >> np.uint64(64 - bits)).astype(np.int64), return_counts=True)
                # what is counted more often in one task is frequent, however much
                counts[at] = np.minimum(counts[at] + n, 255)

        for (text,) in parts:
            held.append(shingle_hashes(hashes(text), k))
            size += len(held[-1])
            if size >= 1 << 19:
                add()
                held, size = [], 0
        add()
        if counts.any():
            for at in range(0, 1 << bits, chunk):
                yield at // chunk, squeeze.compress(counts[at : at + chunk].tobytes())

    def total(parts: Iterator[tuple]) -> Iterator[tuple]:
        import zstandard

        open_up, now, counts = zstandard.ZstdDecompressor(), None, None
        for at, packed in parts:
            if at != now:
                if now is not None:
                    yield now, _levels(counts)
                now, counts = at, np.zeros(chunk, np.int64)
            counts += np.frombuffer(open_up.decompress(packed), np.uint8)
        if now is not None:
            yield now, _levels(counts)

    found = map_rows(rows, ["text"], count, "chunk int, counts binary").repartition("chunk").sortWithinPartitions("chunk")
    levels = np.zeros(1 << bits, np.uint8)
    for at, own in map_rows(found, ["chunk", "counts"], total, "chunk int, levels binary").collect():
        levels[at * chunk : (at + 1) * chunk] = np.frombuffer(own, np.uint8)
    return Order(levels, n_texts)


def _levels(counts: np.ndarray) -> bytes:
    return np.minimum(STEEP * np.log2(1 + counts), 255).astype(np.uint8).tobytes()


# --- signatures ------------------------------------------------------------------------------------------------------


#: Growth of the size steps of signatures: the wider, the fewer sets have signatures for two.
WIDE = 1.6


def size_steps(percent: int, growth: float = 1.1) -> np.ndarray:
    """Least size of each step: a set is at least ``percent`` of a linked larger one, which so reaches no further than the next step."""
    out = [1]
    while out[-1] < 1 << 40:
        out.append(max(out[-1] + 1, 100 * (out[-1] - 1) // percent + 1, int(out[-1] * growth)))
    return np.array(out)


#: A set has so many parts that have n-grams, for each that a link may change.
SPARE = 1.15


def n_parts(most: int, percent: int) -> int:
    """Parts for sets of at most ``most`` n-grams: so many that more have n-grams than differ between linked sets, and no more, as long parts tell more."""
    share = min(SPARE * (100 - percent) / percent, 0.9)
    low, high = 0.1, 100.0  # n-grams a part; the share of n-grams that are the first of their part falls with it
    while high - low > 1e-3:
        middle = (low + high) / 2
        low, high = (middle, high) if -math.expm1(-middle) / middle > share else (low, middle)
    return max(int(most / low) + 1, 2)


def signatures(grams: np.ndarray, percent: int, steps: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
    """Hashes of a set's heaviest parts with its size step, and with the step before it if a linked set can be of that.

    The n-grams are dealt by hash into parts, as many for all sets of a step; ``weights`` are whole numbers, one for each.  An
    n-gram that only one of two linked sets has changes one part, so with at most d of those at most d parts differ.  All
    contents of parts stand in one order, by weight: of the parts that are equal take the heaviest; at most d parts of either
    set are heavier, so it is among the first d + 1 of both.  A set with d parts or fewer has one more signature for what is empty.
    """
    n = len(grams)
    step = int(np.searchsorted(steps, n, side="right"))
    spread, weights = mix(grams), np.ones(n) if weights is None else weights
    place = (spread >> np.uint64(32)).astype(np.uint64)

    def heaviest(at: int, other: int) -> np.ndarray:
        """Signatures for links of which the smaller set is of step ``at``; ``other`` is the most that a linked set then has."""
        need = (n + other) * (100 - percent) // (100 + percent) + 1
        part = (place * np.uint64(n_parts(int(steps[at]) - 1, percent)) >> np.uint64(32)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        first = np.flatnonzero(np.diff(part[order], prepend=-1))
        contents = mix(np.add.reduceat(spread[order], first) + np.uint64(at))
        if need < len(first):
            return contents[np.lexsort((contents, np.add.reduceat(weights[order], first)))[-need:]]
        return contents if need == len(first) else np.append(contents, mix(np.array([at], np.uint64)))

    out = [heaviest(step, 100 * n // percent)]
    if -(-percent * n // 100) < steps[step - 1]:
        out.append(heaviest(step - 1, int(steps[step - 1]) - 1))
    return np.concatenate(out)


# --- prefix tree -----------------------------------------------------------------------------------------------------


class Node:
    __slots__ = ("children", "edge", "ends", "longest", "mixed", "one", "shortest")

    def __init__(self, edge: tuple):
        self.edge: tuple = edge
        self.children: dict[int, Node] = {}
        self.ends: list[tuple[int, int]] = []  # (size, set) of the sets that end here
        self.shortest, self.longest = 1 << 60, 0
        self.one, self.mixed = -1, False  # a set below, and whether they may be of several components


class PrefixTree:
    """Sets in one global order, with path compression; ``linked`` finds the stored sets a new one is linked to."""

    def __init__(self, percent: int, find):
        self.percent, self.find = percent, find
        self.root = Node(())

    def add(self, grams: tuple, name: int) -> None:
        node, at, size = self.root, 0, len(grams)
        while True:
            node.shortest, node.longest = min(node.shortest, size), max(node.longest, size)
            if node.one < 0:
                node.one = name
            elif not node.mixed and self.find(node.one) != self.find(name):
                node.mixed = True
            if at == size:
                node.ends.append((size, name))
                return
            child = node.children.get(grams[at])
            if child is None:
                child = node.children[grams[at]] = Node(grams[at:])
                child.shortest = child.longest = size
                child.one = name
                child.ends.append((size, name))
                return
            edge = child.edge
            same = 1
            while same < len(edge) and at + same < size and edge[same] == grams[at + same]:
                same += 1
            if same < len(edge):  # the edge splits
                upper = Node(edge[:same])
                upper.shortest, upper.longest, upper.one, upper.mixed = child.shortest, child.longest, child.one, child.mixed
                child.edge = edge[same:]
                upper.children[child.edge[0]] = child
                node.children[grams[at]] = upper
                child = upper
            node, at = child, at + same

    def needed(self, a: int, b: int) -> int:
        """The least overlap of linked sets of sizes a and b."""
        return -(-self.percent * (a + b) // (100 + self.percent))

    def linked(self, grams: frozenset, known: int | None = None) -> Iterator[int]:
        """Names of linked sets; with ``known``, sets that are already of that one's component need no answer, nor do subtrees of such sets."""
        n, percent, find = len(grams), self.percent, self.find
        stack = [(self.root, 0, 0)]  # node, depth before its edge, overlap before its edge
        while stack:
            node, depth, overlap = stack.pop()
            if known is not None and not node.mixed and node.one >= 0 and find(node.one) == find(known):
                continue
            depth += len(node.edge)
            if node.edge:
                overlap += len(grams.intersection(node.edge)) if len(node.edge) > 1 else node.edge[0] in grams
            for size, name in node.ends:
                if 100 * overlap >= percent * (n + size - overlap) and (known is None or find(name) != find(known)):
                    yield name
            for child in node.children.values():
                # the overlap can grow by what is left of the set or of the longest path, and the shortest path needs the least
                short, long = max(child.shortest, -(-percent * n // 100)), min(child.longest, 100 * n // percent)
                if short <= long and overlap + min(n - overlap, long - depth) >= self.needed(n, short):
                    stack.append((child, depth, overlap))


def join(sets: list[tuple[int, np.ndarray]], blocks: list[int], pair: tuple[int, int], percent: int, order: Order, rows: list[int] | None = None) -> list[tuple]:
    """A forest of links among sets (name, n-grams): of one block (pair of equal numbers), or between two blocks.

    With ``rows``, how many rows each set has, every link is found, and (name, None, rows it is linked to) tells of all sets.
    """
    everything = np.unique(np.concatenate([g for _, g in sets]))
    # places in the global order, frequent ones first, so that sets with much in common share long paths
    place = np.empty(len(everything), np.int64)
    place[np.searchsorted(everything, order.sorted(everything)[::-1])] = np.arange(len(everything))
    places = list(range(len(everything)))  # one object for each, however many sets have it
    parent = list(range(len(sets)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out, met = [], [0] * len(sets)
    trees = {b: PrefixTree(percent, find) for b in pair}
    for k in sorted(range(len(sets)), key=lambda k: len(sets[k][1])):
        grams = tuple(map(places.__getitem__, np.sort(place[np.searchsorted(everything, sets[k][1])]).tolist()))
        other = pair[0] if blocks[k] == pair[1] else pair[1]
        for found in trees[other].linked(frozenset(grams), k if rows is None else None):
            if rows is not None:
                met[k] += rows[found]
                met[found] += rows[k]
            a, b = find(found), find(k)
            if a != b:
                parent[a] = b
                out.append((sets[k][0], sets[found][0], None))
        trees[blocks[k]].add(grams, k)
    return out + [(name, None, n) for (name, _), n in zip(sets, met, strict=True) if n]


# --- components ------------------------------------------------------------------------------------------------------


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node that each node of the edges (a, b) is connected to.

    Rounds of two steps until nothing changes: every node tells its larger neighbours, then its smaller ones, of the least.
    Their number grows with the logarithm of the longest path; a round's table goes when the next one is written.
    """
    edges, path = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before, now = None, ()
    while now != before:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = F.least("a", F.min("b").over(Window.partitionBy("a")))
        large = both.withColumn("m", least).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = F.min("b").over(Window.partitionBy("a"))
        step = large.withColumn("m", least)
        small = step.select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        edges, own = written(small, "edges")
        drop(edges.sparkSession, path)
        path, before = own, now
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


# --- the operator ----------------------------------------------------------------------------------------------------


def _grams(hashes: WordHashes, text: str, k: int) -> np.ndarray:
    return np.unique(shingle_hashes(hashes(text), k))


def _name(grams: np.ndarray) -> int:
    from xxhash import xxh3_64_intdigest

    return xxh3_64_intdigest(grams.tobytes()) - (1 << 63)


def _read(rows: DataFrame, k: int, percent: int, order: Order) -> DataFrame:
    """Size, name and step of each document's set, its signatures that are new in the task, the sets that had another of them first, and the text, packed, if the task has not given that set's yet."""
    steps, wide = size_steps(percent), size_steps(percent, WIDE)

    def run(parts: Iterator[tuple]) -> Iterator[tuple]:
        import zstandard

        hashes, seen, told, sent, squeeze = WordHashes(), {}, set(), set(), zstandard.ZstdCompressor(level=1)
        for doc_id, text in parts:
            grams = _grams(hashes, text, k)
            if not len(grams):
                yield doc_id, 0, None, None, [], [], None
                continue
            name, new, others = _name(grams), [], []
            for s in signatures(grams, percent, wide, order.weights(grams)).view(np.int64).tolist():
                first = seen.get(s)
                if first is None:
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen[s] = name
                    new.append(s)
                elif first != name and (first, name) not in told:
                    if len(told) >= TOLD:
                        told.clear()
                    told.add((first, name))
                    others.append(first)
            yield doc_id, len(grams), name, int(np.searchsorted(steps, len(grams), side="right")), new, others, None if name in sent else squeeze.compress(text.encode())
            if len(sent) >= SEEN:
                sent.clear()
            sent.add(name)

    return map_rows(rows, ["doc_id", "text"], run, "doc_id long, n_shingles long, name long, step int, signatures array<long>, others array<long>, packed binary")


def _links(members: DataFrame, k: int, percent: int, order: Order, every: bool) -> DataFrame:
    """Links (a, b) between the sets of each candidate group; ``members`` has root, blocks (a map by step), step, name, rows and packed.

    ``every`` adds (a, null, n): rows of other sets that a unit links to the set a, so no table has a row for each pair.
    """
    step, own = F.col("step"), F.pmod(F.xxhash64("name"), F.col("blocks")[F.col("step")])

    def met(other: Column, pair) -> Column:
        """What ``pair`` makes of each block of a step, if the group has that step."""
        return F.transform(F.sequence(F.lit(1).cast("long"), F.coalesce(F.col("blocks")[other], F.lit(0).cast("long"))), lambda x: F.when(F.col("blocks")[other].isNotNull(), pair(x - 1)))

    def two(low_step: Column, low: Column, high_step: Column, high: Column, at: Column) -> Column:
        return F.struct(low_step.alias("low_step"), low.alias("low"), high_step.alias("high_step"), high.alias("high"), at.alias("at"))

    first, second = F.lit(0), F.lit(1)
    pairs = F.concat(
        met(step, lambda x: two(step, F.least(x, own), step, F.greatest(x, own), F.when(own > x, second).otherwise(first))),
        met(step + 1, lambda x: two(step, own, step + 1, x, first)),
        met(step - 1, lambda x: two(step - 1, x, step, own, second)),
    )
    unit = ["root", "low_step", "low", "high_step", "high"]
    dealt = members.withColumn("pair", F.explode(pairs)).where("pair is not null").select("root", "pair.*", "name", "rows", "packed")
    dealt = dealt.repartition(*unit).sortWithinPartitions(*unit, "name")

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        import zstandard

        hashes, open_up = WordHashes(), zstandard.ZstdDecompressor()
        key, sets, where, counts = None, [], [], []

        def solve() -> Iterator[tuple]:
            if len(sets) > 1:
                yield from join(sets, where, (0, int(key[1:3] != key[3:])), percent, order, counts if every else None)

        for *now, at, name, n, packed in rows:
            if now != key:
                yield from solve()
                key, sets, where, counts = now, [], [], []
            if not sets or sets[-1][0] != name:
                sets.append((name, _grams(hashes, open_up.decompress(packed).decode(), k)))
                where.append(at)
                counts.append(n)
        yield from solve()

    return map_rows(dealt, [*unit, "at", "name", "rows", "packed"], run, "a long, b long, n long")


def linked_components(docs: DataFrame, k: int = GRAM_WORDS, percent: int = PERCENT, links: bool = False) -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``component_id`` of every row; ``links`` adds ``n_links``, to how many other rows it is linked."""
    rows = id_and_text(docs)
    order = learn_order(rows, k)
    read = materialize(_read(rows, k, percent, order), "sets")
    sets = read.select("doc_id", "n_shingles", "name")
    least = F.min("name").over(Window.partitionBy("signature"))
    edges = read.select("name", F.explode("signatures").alias("signature")).select(F.col("name").alias("a"), least.alias("b")).unionByName(read.select(F.col("name").alias("a"), F.explode("others").alias("b")))
    groups = components(edges)
    # a small group is one unit, as its sets all have step 0
    steps = read.where("name is not null").select("name", "step", "n_shingles").distinct().join(groups.hint("merge"), F.col("name") == F.col("node")).groupBy("root", "step").agg(F.count(F.lit(1)).alias("size"), F.sum("n_shingles").alias("grams"))
    blocks = F.ceil(F.greatest(F.col("size") / BLOCK_SETS, F.col("grams") / BLOCK_GRAMS))
    sizes = steps.groupBy("root").agg(F.sum("size").alias("size"), F.sum("grams").alias("grams"), F.map_from_entries(F.collect_list(F.struct("step", blocks.alias("blocks")))).alias("blocks"))
    small = (F.col("size") <= BLOCK_SETS) & (F.col("grams") <= BLOCK_GRAMS)
    sizes = sizes.select(F.col("root").alias("of"), small.alias("small"), F.when(small, F.create_map(F.lit(0), F.lit(1).cast("long"))).otherwise(F.col("blocks")).alias("blocks"))
    # sorted on both sides at every size: the groups have no size bound that would let them be broadcast
    # each task gives a set's text once, so copies are counted apart and their texts stay where they are
    given = read.where("packed is not null").select("name", "step", "packed").join(groups.hint("merge"), F.col("name") == F.col("node")).groupBy("name", "root").agg(F.min("step").alias("step"), F.min("packed").alias("packed"))
    packed = given.join(read.where("name is not null").groupBy("name").agg(F.count(F.lit(1)).alias("rows")).hint("merge"), "name")
    members = packed.join(sizes, F.col("root") == F.col("of")).select("root", "blocks", F.when(F.col("small"), 0).otherwise(F.col("step")).alias("step"), "name", "rows", "packed")
    found = _links(members, k, percent, order, links)
    found = materialize(found, "links") if links else found
    linked = components(found.select("a", "b"))
    classes = sets.where("name is not null").groupBy("name").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("rows"))
    joined = classes.join(linked, F.col("name") == F.col("node"), "left").select("name", "first", F.coalesce("root", "name").alias("root"))
    least = joined.groupBy("root").agg(F.min("first").alias("component_id"))
    ids = joined.select("name", "root").join(least, "root").select("name", "component_id")
    columns = ["doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")]
    if links:
        other = found.where("b is null").groupBy(F.col("a").alias("name")).agg(F.sum("n").alias("n"))
        own = classes.join(other, "name", "left").select("name", (F.col("rows") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"))
        ids = ids.join(own, "name")
        columns.append(F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))
    return sets.join(ids, "name", "left").select(*columns)


#: Bits that ids which go set, by hash: a table of fixed size that every task has, in rows of ``ROW_BITS``.
MARK_BITS, ROW_BITS = 25, 15


def without(docs: DataFrame, id_col: str, lost: DataFrame) -> DataFrame:
    """The rows whose id isn't in ``lost`` (one column of longs, a null among them goes too).

    A row whose bit no lost id has set stays where it is, so whole texts are not exchanged; only the others meet the lost ids.
    """
    own, (gone,) = column(id_col).cast("long"), lost.columns
    mark = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << MARK_BITS))
    row, bits = free_name(docs, "mark_row"), free_name(docs, "mark_bits")
    at = mark(F.col(gone))
    marks = lost.groupBy(F.shiftright(at, ROW_BITS).alias(row)).agg(F.bitmap_construct_agg(at % (1 << ROW_BITS)).alias(bits))
    place = mark(own) % (1 << ROW_BITS)
    byte = F.conv(F.hex(F.substr(F.col(bits), (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    may = F.coalesce(F.getbit(byte, (place % 8).cast("int")) == 1, F.lit(False))
    marked = docs.join(F.broadcast(marks), F.shiftright(mark(own), ROW_BITS) == F.col(row), "left")
    named = [column(c) for c in docs.columns]
    stay, rest = marked.where(~may).select(*named), marked.where(may).select(*named)
    return stay.union(rest.join(lost.hint("merge"), own.eqNullSafe(F.col(gone)), "left_anti"))


def one_of_each(docs: DataFrame, k: int = GRAM_WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows whose id is its component's; where rows share an id, all of them stay if one does."""
    gone, stays = free_name(docs, "gone"), F.coalesce(F.expr("component_id is null or doc_id = component_id"), F.lit(False))
    ids = linked_components(docs, k, percent).groupBy(F.col("doc_id").alias(gone)).agg(F.max(stays).alias("stays")).where("not stays")
    return without(docs, "doc_id", materialize(ids.select(gone), "gone"))
