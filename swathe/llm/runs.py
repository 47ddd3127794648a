"""Detection of periodic runs of words, and texts with their repetitions collapsed.

A run is a stretch whose smallest period is at most half its length and that no neighbouring word extends.  Every run has a
Lyndon root under one of two opposite orders of the words, and that root is the longest Lyndon word at its place.  The first
phase of grouping suffixes by their Lyndon prefix yields that longest word for every place (``suffixes.lyndon_groups``), once
under each order; each root is then extended to both sides by the longest common extension of its place and the next
(compared word by word, in doubling steps), and is a run when both together are as long as the root.

A run of at least ``least`` words and ``times`` periods consists of n-grams of words that each start again elsewhere in the text,
for an n that follows from the two numbers.  So roots are sought in the stretches of such n-grams; elsewhere there is no such run.

Defined cases: a null or empty text, or one of white space, has no words and no runs; repeated rows give repeated rows; of the
runs of one text none is left out or cut, however long; runs may overlap, and a word that any of them repeats goes; an
empty table gives no rows; other columns are not read.  A text is in one task with its words, nothing else is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, map_rows
from .repair import crc32_sql
from .suffixes import lyndon_groups

#: The shortest run in words, and in periods.
LEAST, TIMES = 6, 4
#: Odd numbers that n-grams are hashed with; equal hashes only add places to look at.
ODD = np.uint64(0x9E3779B97F4A7C15)


def gram_of(least: int, times: int) -> int:
    """The largest n for which all n-grams of such a run start twice in it."""
    return max(1, min(max(least, times * q) - 2 * q + 1 for q in range(1, max(2, least))))


def stretches(words: np.ndarray, gram: int) -> list[tuple[int, int]]:
    """Maximal stretches [from, to) of words all of whose n-grams start at another place too."""
    n = len(words) - gram + 1
    if n < 2:
        return []
    h = np.zeros(n, np.uint64)
    for k in range(gram):
        h = (h ^ words[k : k + n].astype(np.uint64)) * ODD
        h ^= h >> np.uint64(29)
    order = np.argsort(h)
    same = h[order[1:]] == h[order[:-1]]
    if not same.any():
        return []
    twice = np.zeros(n + 2, np.int8)
    twice[order[1:][same] + 1] = 1
    twice[order[:-1][same] + 1] = 1
    edges = np.diff(twice)
    return [(s, e + gram - 1) for s, e in zip(np.flatnonzero(edges == 1).tolist(), np.flatnonzero(edges == -1).tolist(), strict=True)]


def extension(data: bytes, i: int, j: int, most: int, step: int) -> int:
    """How many 4-byte words from ``i`` and from ``j`` on are equal, forward (``step`` 1) or backward from the word before (-1)."""
    got, k = 0, 1
    while got < most:
        k = min(k, most - got)
        a, b = (i + got, j + got) if step > 0 else (i - got - k, j - got - k)
        if data[4 * a : 4 * (a + k)] == data[4 * b : 4 * (b + k)]:
            got += k
            k *= 2
        elif k == 1:
            break
        else:
            k //= 2
            most = min(most, got + 2 * k)
    return got


def runs_of(words: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, smallest period) of every run of the numbered words, by start, then period."""
    if times < 2:
        raise ValueError("a run has two periods at least")
    n, data = len(words), np.ascontiguousarray(words, np.int32).tobytes()
    found: set[tuple[int, int, int]] = set()
    for first, last in stretches(words, gram_of(least, times)):
        own = words[first:last].tolist()
        for text in (own, [-w for w in own]):
            _, width, of, _ = lyndon_groups(text)
            until: dict[int, int] = {}  # where the last run of a period ends
            for at, g in enumerate(of):
                p, i = width[g], first + at
                j = i + p
                if j <= until.get(p, 0):
                    continue
                right = extension(data, i, j, n - j, 1)
                left = extension(data, i, j, i, -1)
                if left + right >= p:
                    until[p] = j + right
                    if left + p + right >= max(least, times * p):
                        found.add((i - left, left + p + right, p))
    return sorted(found, key=lambda r: (r[0], r[2]))


def number(words: list[bytes]) -> np.ndarray:
    """Words as numbers, equal ones alike."""
    seen: dict[bytes, int] = {}
    return np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int32, len(words))


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run repeats, joined by one space."""
    if runs:
        keep = np.ones(len(words), bool)
        for start, length, period in runs:
            keep[start + period : start + length] = False
        words = [words[i] for i in np.flatnonzero(keep).tolist()]
    return b" ".join(words)


def find_runs(docs: DataFrame, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """``doc_id``, ``n_words``, the ``runs`` of every whole text by start, then period, and its ``collapsed`` text."""

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        for doc_id, text in rows:
            words = text.encode().split()  # of bytes: at white space of ASCII alone
            runs = runs_of(number(words), least, times)
            yield doc_id, len(words), runs, collapsed(words, runs).decode()

    return map_rows(id_and_text(docs), ["doc_id", "text"], run, "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def digest(found: DataFrame) -> DataFrame:
    """Number of runs, the run of the greatest exponent, and digests of all runs and of the collapsed text."""
    # exact: a.length / a.period against b.length / b.period
    better = lambda a, b: F.when(a.isNull() | (b["length"] * a["period"] > a["length"] * b["period"]), b).otherwise(a)
    best = F.aggregate("runs", F.lit(None).cast("struct<start:long,length:long,period:long>"), better)
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.concat(lines, F.when(F.size("runs") > 0, "\n").otherwise("")), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def with_repetition(docs: DataFrame) -> DataFrame:
    """Texts of which every tenth document, by a checksum of its id, repeats a passage of its own from some word on."""
    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    held = docs.select("doc_id", "text", h.alias("h"), F.when(h % 10 == 0, words).alias("words"))
    held = held.withColumns({"n": F.size("words").cast("long"), "g": F.floor(F.col("h") / 10)})
    held = held.withColumn("a", F.expr("if(n > 0, g % n, 0)")).withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    built = F.expr("array_join(concat(slice(words, 1, int(a)), transform(sequence(a, n - 1), i -> words[int(a + (i - a) % p)])), ' ')")
    return held.select("doc_id", F.when(F.col("n") > 0, built).otherwise(F.col("text")).alias("text"))


#: Words that are equal at a distance, in unbroken stretches; of stretches of one extent the smallest distance is the period.
DIGEST_SQL = rf"""
with texts as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as said, {crc32_sql("doc_id::varchar")} as h from documents),
sized as (select *, length(said) as n, h // 10 as g from texts),
placed as (select *, case when n > 0 then g % n end as a, case when n > 0 then 1 + (n - g % n) // (3 + g % 8) end as p from sized),
docs as (
  select doc_id, n, case when h % 10 = 0 and n > 0 then list_concat(said[1:a], list_transform(range(a, n), lambda i: said[a + (i - a) % p + 1])) else said end as said from placed
),
words as (select doc_id, n, unnest(said) as word, generate_subscripts(said, 1) - 1 as i from docs),
pairs as (
  select x.doc_id, x.i, y.i - x.i as q from words x join words y on x.doc_id = y.doc_id and x.word = y.word and y.i > x.i and (y.i - x.i) * {TIMES} <= x.n
),
islands as (select doc_id, q, i, i - row_number() over (partition by doc_id, q order by i) as island from pairs),
stretches as (select doc_id, q, min(i) as start, count(*) + q as length from islands group by doc_id, q, island having count(*) + q >= greatest({LEAST}, {TIMES} * q)),
runs as (select doc_id, start, length, min(q) as period from stretches group by all),
gone as (select distinct doc_id, unnest(range(start + period, start + length)) as i from runs),
kept as (
  select doc_id, string_agg(word, ' ' order by i) as whole from words w anti join gone g on w.doc_id = g.doc_id and w.i = g.i group by doc_id
),
best as (
  select r.* from runs r where not exists (select 1 from runs o where o.doc_id = r.doc_id and (o.length * r.period > r.length * o.period
    or o.length * r.period = r.length * o.period and (o.start < r.start or o.start = r.start and o.period < r.period)))
),
lines as (select doc_id, count(*) as n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' order by start, period) as said from runs group by doc_id)
select d.doc_id, coalesce(n_runs, 0) as n_runs, b.start, b.length, b.period, 1000 * b.length // b.period as exponent_milli, sha256(coalesce(l.said, '')) as runs_sha256, sha256(coalesce(k.whole, '')) as collapsed_sha256
from docs d left join lines l on l.doc_id = d.doc_id left join best b on b.doc_id = d.doc_id left join kept k on k.doc_id = d.doc_id
"""
