"""Quality rules as a short-circuit cascade.

Rules are ordered by the rejections they bring per unit of cost, both estimated on a hashed sample of about ``SAMPLE_ROWS``
documents, and a document that one rule rejects is not put to the next.  ``keep`` is the cascade as a filter: each rule makes
its own columns for the documents that are left, so what an early rule rejects costs nothing more.  ``judge`` reports the
statistics and the base rule of every document, which takes work that no rule can save, and puts only those that pass the base
rule to the others.  The order changes the cost, never the verdict.

A rule's cost is what the sample takes with it beyond what it takes with a rule that looks at nothing, over enough
repetitions to tell; costs within a factor of two count as equal, and so do those too small to tell.  Equals keep the order given.

Defined cases: a null or empty text has no words and fails the base rule; repeated rows are judged alike; a very long text is
one row; ``columns`` names what else is kept; on an empty table the rules stay in the order given.
"""

from __future__ import annotations

import math
import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, free_name, materialize

SAMPLE_ROWS = 1500
#: How often a rule looks at the sample to be timed, and the seconds below which a difference tells nothing.
REPEATS, LEAST_SECONDS = 6, 0.05
WINDOW = 5
SPACE = r"\x20\x09-\x0D"


def _n(c: Column | str) -> Column:
    return F.size(c).cast("long")


def statistics(docs: DataFrame, columns: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """Word, symbol, repeated-line and repeated-word counts of every whole text."""
    step = docs.select(*map(column, columns), F.coalesce(column(text_col).cast("string"), F.lit("")).alias("_text"))
    step = step.withColumn("_words", F.filter(F.split("_text", f"[{SPACE}]+"), lambda w: w != ""))
    step = step.withColumns({"n_words": _n("_words"), "_hashes": F.transform("_words", lambda w: F.xxhash64(w)), "_lines": F.filter(F.split("_text", "\n"), lambda x: x.rlike(f"[^{SPACE}]"))})
    window = lambda i: F.xxhash64(*(F.get("_hashes", i + k) for k in range(WINDOW)))
    step = step.withColumn("_windows", F.when(F.col("n_words") >= WINDOW, F.transform(F.sequence(F.lit(0), F.col("n_words").cast("int") - WINDOW), window)).otherwise(F.array().cast("array<bigint>")))
    repeats = F.size(F.array_distinct("_windows")) < F.size("_windows")
    step = step.withColumn("_sorted", F.when(repeats, F.array_sort(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    hash_at = lambda j: F.get("_sorted", j)["h"]
    twice = F.filter(F.sequence(F.lit(0), F.size("_sorted") - 1), lambda j: hash_at(j).eqNullSafe(hash_at(j - 1)) | hash_at(j).eqNullSafe(hash_at(j + 1)))
    starts = F.array_sort(F.transform(twice, lambda j: F.get("_sorted", j)["i"]))
    covered = F.aggregate(
        starts, F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("n")), lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n")), lambda a: a["n"]
    )
    return step.select(
        *map(column, columns), "_text", "_words", "_lines", "n_words",
        F.char_length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        (F.char_length("_text") - F.char_length(F.regexp_replace("_text", r"[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        (_n("_lines") - _n(F.array_distinct("_lines"))).alias("n_dup_lines"),
        F.when(F.col("_sorted").isNull(), F.lit(0)).otherwise(covered).cast("long").alias("n_repeat_words"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def rules() -> dict[str, Column]:
    """Name and condition of rejection, over the columns of ``statistics``."""
    letters = F.char_length(F.regexp_replace("_text", r"\P{L}+", ""))
    return {
        "symbols": F.col("n_symbols") > F.col("n_words"),
        "repeated_lines": 2 * F.col("n_dup_lines") > F.size("_lines"),
        "word_length": (F.col("word_chars") < 2 * F.col("n_words")) | (F.col("word_chars") > 20 * F.col("n_words")),
        "few_letters": 2 * letters < F.col("word_chars"),
        "few_different_words": (F.col("n_words") >= 50) & (20 * F.size(F.array_distinct("_words")) < F.col("n_words")),
    }


def ordered(docs: DataFrame, of: dict[str, Column], text_col: str = "text") -> list[tuple[str, float, float]]:
    """(rule, seconds for a row, share rejected) by rejections per cost, from the sample."""
    n = docs.count()
    if not n:
        return [(k, 0.0, 0.0) for k in of]
    kept = F.pmod(F.xxhash64(column(text_col), F.lit(7)), F.lit(1 << 20)) < int(min(1.0, SAMPLE_ROWS / n) * (1 << 20))
    sample = materialize(statistics(docs.where(kept), (), text_col), "quality")
    again = sample.withColumn("_again", F.explode(F.sequence(F.lit(1), F.lit(REPEATS))))

    def timed(condition: Column) -> float:
        # the repetition is part of the condition, so it is evaluated for each
        looked = again.agg(F.count_if(condition & (F.col("_again") > 0)))
        seconds = []
        for _ in range(2):  # the first run compiles
            began = time.perf_counter()
            looked.first()
            seconds.append(time.perf_counter() - began)
        return min(seconds)

    hits = sample.agg(F.count(F.lit(1)), *(F.count_if(c) for c in of.values())).first()
    rows, nothing = max(hits[0], 1), timed(F.col("n_words") < 0)
    found = []
    for (name, condition), hit in zip(of.items(), hits[1:], strict=True):
        found.append((name, max(timed(condition) - nothing, LEAST_SECONDS) / (rows * REPEATS), hit / rows))
    return sorted(found, key=lambda x: -x[2] / 2 ** round(math.log2(x[1])))


def judge(docs: DataFrame, columns: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """Statistics, ``base_failed`` and ``kept`` for every row."""
    of = rules()
    order = [name for name, _, _ in ordered(docs, of, text_col)]
    verdict = F.when(F.col("base_failed"), False)
    for name in order:
        verdict = verdict.when(of[name], False)
    rows = statistics(docs, columns, text_col).withColumn("base_failed", base_failed())
    return rows.select(*map(column, columns), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", verdict.otherwise(True).alias("kept"))


def keep(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, that neither the base rule nor any other rejects; rows without a verdict don't exist.

    The cheap half of the base rule, the number of words, comes first; then the rules in their order; then repeated words.
    """
    own = free_name(docs, "statistics_")
    whole = F.struct(*(column(c).alias(f"c{k}") for k, c in enumerate(docs.columns)))
    rows = docs.select(whole.alias(own), column(text_col).cast("string").alias("text_"))
    for name, _, _ in [("few_words", 0, 0), *ordered(docs, rules(), text_col), ("repeated_words", 0, 0)]:
        reject = {"few_words": F.col("n_words") < 10, "repeated_words": 100 * F.col("n_repeat_words") > 20 * F.col("n_words")} | rules()
        # only the statistics that the rule looks at are left after pruning, and only for rows that are left
        rows = statistics(rows, (own, "text_"), "text_").where(~F.coalesce(reject[name], F.lit(False))).select(own, "text_")
    return rows.select(*(F.col(own)[f"c{k}"].alias(c) for k, c in enumerate(docs.columns)))


OP7_SQL = r"""
with w as (select doc_id, coalesce(text, '') as t from documents),
a as (select doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as ls from w),
i as (select doc_id, any_value(ws) as ws, unnest(range(1, any_value(len(ws)) - 3)) as p from a group by doc_id),
g as (select doc_id, p, array_to_string(ws[p:p+4], ' ') as s from i),
d as (select doc_id, p from (select *, count(*) over (partition by doc_id, s) as n from g) where n > 1),
r as (select doc_id, count(distinct p + k) as n from d, range(0, 5) as o(k) group by doc_id),
b as (select a.doc_id, len(ws) as n_words, length(array_to_string(ws, '')) as word_chars,
  length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as n_symbols, len(ls) - len(list_distinct(ls)) as n_dup_lines,
  coalesce(r.n, 0) as n_repeat_words, len(ls) as n_lines, length(regexp_replace(t, '\P{L}+', '', 'g')) as letters, len(list_distinct(ws)) as different
  from a left join r using (doc_id))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed,
  not (n_words < 10 or 100 * n_repeat_words > 20 * n_words or n_symbols > n_words or 2 * n_dup_lines > n_lines or word_chars < 2 * n_words
    or word_chars > 20 * n_words or 2 * letters < word_chars or (n_words >= 50 and 20 * different < n_words)) as kept
from b
"""
