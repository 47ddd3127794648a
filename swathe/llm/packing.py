"""Best-fit decreasing packing of tokenised documents into sequences of a fixed length.

Documents are tokenised once; only a row of counts per piece moves on, written with its rank among its task's pieces of the
same length.  Best-fit decreasing looks at nothing but lengths, and there are at most ``limit`` different ones, so one row a
length reaches the driver, however large the corpus.  There a segment tree over remaining capacities finds the tightest open
sequences for a run of equal lengths in a logarithmic number of steps; the outcome is that of putting the pieces one by one.
Ranks of a length over all tasks then say which slot a piece has.  No piece is held in one place with others.

Defined cases: a null or empty text is the end id alone; repeated rows are packed as often as they occur; a very long text is
cut into pieces while one task holds its ids; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import array
import itertools
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import held_model, id_and_text, map_rows, materialize

CACHE_WORDS = 250_000
#: Texts whose words are looked up at once hold so many characters, or are one text.
BLOCK_CHARS = 2_000_000
#: Words of printable ASCII and of letters that Latin-1 adds: they are their own normal form, and lower case is as plain.
PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")
#: The first byte of a character from U+0300 on.
MARKED = re.compile(b"[\xcc-\xff]")
#: What the vocabulary's pre-tokeniser makes of such a word in lower case.
PARTS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")
#: The characters that stand for bytes in a byte-level vocabulary: itself where a byte is a visible character of Latin-1, else the next from 256.
SEEN = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
BYTES = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in SEEN)}


class WordCache:
    """Ids of a text as those of its words: this vocabulary's pre-tokeniser drops white space, so no token spans two words."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merges = self.tokenizer.model
        self.known: dict[bytes, bytes] = {}

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        """Little-endian unsigned 32-bit ids of each text."""
        if not texts:
            return []
        # the vocabulary is lower case, so words that differ in case are one; the special tokens' strings are not lowered, nor is a text
        # with letters from U+0300 on: the tokeniser composes before it lowers, and a mark may compose with the lower letter alone
        split = pc.ascii_split_whitespace(pa.array([data if b"<|" in data or MARKED.search(data) else data.lower() for data in map(str.encode, texts)], pa.string()))
        words = split.flatten().dictionary_encode()
        spelled = words.dictionary.cast(pa.binary()).to_pylist()
        missing = [w for w in spelled if w not in self.known]
        if len(self.known) + len(missing) > CACHE_WORDS:
            self.known.clear()
            missing = spelled
        self._learn(missing)
        found = [self.known[w] for w in spelled]
        flat = np.frombuffer(b"".join(found), "<u4")
        size = np.fromiter(map(len, found), np.int64, len(found)) // 4
        first = np.cumsum(size) - size
        # each word's ids, one behind another: where a word's ids begin, and how far in
        at = words.indices.to_numpy(zero_copy_only=False)
        sizes = size[at]
        ends = np.cumsum(sizes)
        place = np.repeat(first[at] - (ends - sizes), sizes)
        place += np.arange(len(place))
        ids = flat[place]
        limits = np.concatenate([[0], ends])[split.offsets.to_numpy() - split.offsets[0].as_py()]
        return [ids[a:b] for a, b in itertools.pairwise(limits.tolist())]

    def _part(self, part: str) -> bytes:
        own = part.encode()
        if (got := self.known.get(own)) is None:
            text = part if part.isascii() else own.decode("latin-1").translate(BYTES)
            got = self.known[own] = array.array("I", [t.id for t in self.merges.tokenize(text)]).tobytes()
        return got

    def _learn(self, words: list[bytes]) -> None:
        """Plain words go part by part to the merges at once; others through the whole tokeniser."""
        known, part, others = self.known, self._part, []
        for w in words:
            text = w.decode()
            if not PLAIN.fullmatch(text) or "<|" in text:
                others.append(text)
                continue
            text = text.lower()
            if text.isalpha():
                known[w] = part(text)
            elif text[:-1].isalpha():  # then the last one is no letter
                known[w] = part(text[:-1]) + part(text[-1])
            else:
                known[w] = b"".join(map(part, PARTS.findall(text)))
        for low in range(0, len(others), 20_000):
            some = others[low : low + 20_000]
            for w, e in zip(some, self.tokenizer.encode_batch_fast(some, add_special_tokens=False), strict=True):
                known[w.encode()] = array.array("I", e.ids).tobytes()


class Capacities:
    """Open sequences by remaining capacity.  A segment tree over capacities 0..limit counts them; each capacity has runs of sequence numbers."""

    def __init__(self, limit: int):
        self.size = 1 << limit.bit_length()
        self.count = [0] * (2 * self.size)
        self.runs: list[list[tuple[int, int]]] = [[] for _ in range(limit + 1)]  # (first sequence, how many)

    def _add(self, capacity: int, by: int) -> None:
        at = capacity + self.size
        while at:
            self.count[at] += by
            at >>= 1

    def put(self, capacity: int, first: int, n: int) -> None:
        self.runs[capacity].append((first, n))
        self._add(capacity, n)

    def tightest(self, need: int) -> int | None:
        """The least capacity of at least ``need`` that an open sequence has."""
        count, at = self.count, need + self.size
        if not count[at]:
            while at > 1 and (at & 1 or not count[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.size:
                at = 2 * at if count[2 * at] else 2 * at + 1
        return at - self.size

    def take(self, capacity: int, most: int) -> tuple[int, int]:
        """A run of at most ``most`` sequences of that capacity, removed from the tree."""
        first, n = self.runs[capacity].pop()
        if n > most:
            self.runs[capacity].append((first + most, n - most))
            n = most
        self._add(capacity, -n)
        return first, n


def best_fit_decreasing(counts: dict[int, int], limit: int) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, pieces a sequence, first sequence, offset) for runs of equal lengths, ranks and sequences numbered from 0.

    Of the tightest sequences, one takes pieces until it has no room for another, before the next is as tight; so a run of
    sequences of one capacity takes that many pieces each.
    """
    out, tree, opened = [], Capacities(limit), 0
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            if (capacity := tree.tightest(length)) is None:
                capacity, each = limit, limit // length
                first, n = opened, -(-left // each)
                opened += n
            else:
                each = capacity // length
                first, n = tree.take(capacity, -(-left // each))
            out.append((length, rank, each, first, limit - capacity))
            full = n if n * each <= left else n - 1
            if full:
                tree.put(capacity - each * length, first, full)
            if full < n:
                tree.put(capacity - (left - full * each) * length, first + full, 1)
            taken = min(left, n * each)
            rank, left = rank + taken, left - taken
    return out


def pieces(docs: DataFrame, tokenizer_path: str, end_id: int, limit: int) -> DataFrame:
    """A row for each piece of each document: where it starts, its length, the CRC-32 of its ids, its task and its rank there among equal lengths."""

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        from pyspark import TaskContext

        cache, end, task, met = held_model(("words", tokenizer_path), lambda: WordCache(tokenizer_path)), np.array([end_id], "<u4"), TaskContext.get().partitionId(), Counter()
        for held in blocks(rows):
            for (doc_id, _), ids in zip(held, cache.ids([r[1] for r in held]), strict=True):
                ids = np.concatenate([ids, end])
                for k, at in enumerate(range(0, len(ids), limit)):
                    part = ids[at : at + limit]
                    yield doc_id, k, at, len(part), zlib.crc32(part), task, met[len(part)]
                    met[len(part)] += 1

    return map_rows(id_and_text(docs), ["doc_id", "text"], run, "doc_id long, piece int, start long, length long, ids_crc32 long, task int, place long")


def blocks(rows: Iterator[tuple]) -> Iterator[list[tuple]]:
    """Rows whose texts (the second value) add up to ``BLOCK_CHARS``, 2000 at most."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[1])
        if size >= BLOCK_CHARS or len(held) >= 2000:
            yield held
            held, size = [], 0
    if held:
        yield held


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 1, limit: int = 4096) -> DataFrame:
    """Pieces with ``sequence_id`` and the gapless ``offset`` of each piece in its sequence."""
    # written once: a rank holds only for the very rows that were counted
    found = materialize(pieces(docs, tokenizer_path, end_id, limit), "pieces")
    per_task = found.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = materialize(per_task.withColumn("base", before), "bases")
    counts = {r["length"]: r["n"] for r in bases.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = best_fit_decreasing(counts, limit)
    lengths, ranks, each, first, offset = (np.array(c, np.int64) for c in zip(*plan, strict=True)) if plan else [np.zeros(0, np.int64)] * 5
    # runs in order of length, then rank: the last that begins no later holds the piece
    order = np.lexsort((ranks, lengths))
    lengths, ranks, each, first, offset = (c[order] for c in (lengths, ranks, each, first, offset))
    starts = np.searchsorted(lengths, np.arange(limit + 2))

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        while held := list(itertools.islice(rows, 2000)):
            for *row, length, crc, rank in held:
                low, high = starts[length], starts[length + 1]
                k = low + int(np.searchsorted(ranks[low:high], rank, side="right")) - 1
                within = rank - ranks[k]
                yield *row, length, crc, int(first[k] + within // each[k]), int(offset[k] + within % each[k] * length)

    placed = found.join(bases.drop("n").hint("merge"), ["length", "task"]).withColumn("rank", F.col("base") + F.col("place"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return map_rows(placed, ["doc_id", "piece", "start", "length", "ids_crc32", "rank"], run, schema)
