"""Threshold-scaled sketches of documents.

A fingerprint keeps every hash of a word shingle that lies below a fixed fraction of the hash range.  The same fraction for
all documents makes sketches mergeable (a union of sets) and makes the share of the smaller sketch found in the larger an
estimate of containment, however unequal the documents.  The least hash is always kept, so that only a text without a word
has an empty fingerprint.

Defined cases: a null text is empty; words are runs of non-white-space, ASCII letters lower-cased; a text with fewer words than a
shingle is one shingle; a text without words has the empty fingerprint, alike (1.0) to itself and unlike (0.0) all others; a null
id comes after all others, rows of one id go by text; a very long text is read whole by the task that has it; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, map_rows

SHINGLE_WORDS = 5
FRACTION = 0.25
CACHE_WORDS = 60_000
#: Runs of neighbouring ids, as their limits go to every task; a run is sorted on disk and streamed, so its rows need no bound.
MAX_RUNS = 100_000


class WordHashes:
    """64-bit hashes of words, kept for their next occurrence (a bounded memory)."""

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}

    def __call__(self, text: str) -> np.ndarray:
        from xxhash import xxh3_64_intdigest

        words = text.encode().lower().split()
        known = self.known
        if len(known) > CACHE_WORDS:
            known.clear()
        for w in words:
            if w not in known:
                known[w] = xxh3_64_intdigest(w)
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def mix(h: np.ndarray) -> np.ndarray:
    """Spread each 64-bit value over the whole range."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k-word shingles in order; of the whole sequence when it is shorter; none without words."""
    k = min(k, len(words))
    if not k:
        return words
    n = len(words) - k + 1
    h = np.full(n, k, np.uint64)
    for j in range(k):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + words[j : j + n])
    return h


def sketch(hashes: np.ndarray, fraction: float = FRACTION) -> np.ndarray:
    """The distinct hashes below the threshold, ascending, and the least one in any case."""
    if not len(hashes):
        return hashes
    kept = np.unique(hashes[hashes < np.uint64(int(fraction * 2**64))])
    return kept if len(kept) else hashes.min(keepdims=True)


def merge(a: np.ndarray, b: np.ndarray, fraction: float = FRACTION) -> np.ndarray:
    """The sketch of the union of two documents' shingles."""
    return sketch(np.union1d(a, b), fraction)


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """The share of the smaller sketch that the larger holds."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    return len(np.intersect1d(a, b, assume_unique=True)) / min(len(a), len(b))


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def spelled(sketch_: np.ndarray) -> str:
    return base64.b64encode(sketch_.astype("<u8").tobytes()).decode()


def read(fingerprint: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(fingerprint), "<u8")


def fingerprint(docs: DataFrame, k: int = SHINGLE_WORDS, fraction: float = FRACTION) -> DataFrame:
    """``doc_id`` and ``fingerprint`` of every whole text."""

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        hashes = WordHashes()
        for doc_id, text in rows:
            yield doc_id, spelled(sketch(shingle_hashes(hashes(text), k), fraction))

    return map_rows(id_and_text(docs), ["doc_id", "text"], run, "doc_id long, fingerprint string")


def with_next(docs: DataFrame, rows_per_run: int = 2000) -> DataFrame:
    """Rows in runs of neighbouring ids, descending; each run ends with a copy (``tail``) of the row that begins the next.

    Run limits are ids that occur, the largest of each range of ids, so a run's first row is known without looking at other
    runs: no task sees more than its run.  The last run ends with the very first row.
    """
    rows = id_and_text(docs).select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("key"), "doc_id", "text")
    n = rows.count()
    if not n:
        return rows.select(F.lit(0).alias("run"), "key", "doc_id", "text", F.lit(False).alias("tail"))
    ranges = rows.select("key").repartitionByRange(max(1, min(MAX_RUNS, n // rows_per_run)), "key").groupBy(F.spark_partition_id().alias("range")).agg(F.max("key").alias("limit"))
    limits = sorted((r["limit"] for r in ranges.collect()), reverse=True)
    # a row's run is how many limits are at least its id, less one; found among every so many limits first, then among those between
    width = math.isqrt(len(limits) - 1) + 1
    at_least = lambda xs: F.size(F.filter(xs, lambda x: x >= F.col("key")))
    dealt = rows.withColumn("block", at_least(F.lit(limits[::width])) - 1).withColumn("within", F.get(F.array(*(F.lit(limits[k : k + width]) for k in range(0, len(limits), width))), F.col("block")))
    dealt = dealt.withColumn("place", at_least(F.col("within")) - 1).withColumn("run", F.col("block") * width + F.col("place"))
    own = F.struct(F.col("run"), F.lit(False).alias("tail"))
    before = F.struct(F.pmod(F.col("run") - 1, F.lit(len(limits))).alias("run"), F.lit(True).alias("tail"))
    ends = F.when(F.get("within", F.col("place")) == F.col("key"), F.array(own, before)).otherwise(F.array(own))
    return dealt.withColumn("at", F.explode(ends)).select("at.run", "key", "doc_id", "text", "at.tail")


def fingerprint_edited(docs: DataFrame, k: int = SHINGLE_WORDS, fraction: float = FRACTION) -> DataFrame:
    """Fingerprints of every whole text and of the text whose second half is replaced by the next document's first half.

    The next document is the one that follows in descending order of id (rows of one id: by text), after the last the first.
    """
    schema = (
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, "
        "jaccard_edited double, jaccard_next double"
    )
    rows = with_next(docs)
    sorted_rows = rows.repartition("run").sortWithinPartitions("run", "tail", F.desc("key"), "text")

    def run(parts: Iterator[tuple]) -> Iterator[tuple]:
        hashes = WordHashes()
        make = lambda text: sketch(shingle_hashes(hashes(text), k), fraction)
        held = None
        for run_id, tail, doc_id, text in parts:
            if held and held[0] == run_id:
                own, own_text, following = held[3], held[2], make(text)
                half = len(own_text) // 2
                edited = own_text[: len(own_text) - half] + text[:half]
                changed = make(edited)
                yield (
                    held[1], len(own_text), hashlib.sha256(edited.encode()).hexdigest(), spelled(own), spelled(changed),
                    containment(own, changed), containment(own, following), jaccard(own, changed), jaccard(own, following),
                )
                held = None if tail else (run_id, doc_id, text, following)
            elif not tail:
                held = (run_id, doc_id, text, make(text))

    return map_rows(sorted_rows, ["run", "tail", "doc_id", "text"], run, schema)
