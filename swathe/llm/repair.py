"""Repair of conversations whose turns are blank, repeated, cut off or out of order.

The cheapest edits that give role initials ``(s?(ua)+)?`` are found by depth-first branch-and-bound over (turns read, last
role written).  The stack is explicit.  A suffix bound says what the turns still to be read cost at least from each last
role, so branches are opened in the order of cost so far plus bound, equal ones in the order of their letters.  The
incumbent is the cheapest (cost, audit) so far, and a branch that can't end below it is cut.  A table for each node keeps the best
way to it; a worse one is cut.  When the stack is empty, the incumbent is proved best.

Turns are numbered over ranges of rows, so no task needs a conversation's texts.  The search reads two letters a turn, initial
and fault, gathered in blocks; the one row that holds them is as long as the audit that the result holds itself.

Defined cases: a null role or text is one space; null turn numbers come first; rows of one turn number go by a digest of role and
text, so repeated rows are neighbours; a null ``conv_id`` is one conversation; a role that doesn't begin with s, u or a fits
nowhere; a turn's text may be of any length; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import ranks
from .common import map_rows, materialize

KEEP, REROLE, DELETE, INSERT, CUT_OFF = 0, 2, 3, 2, 1
#: Turns whose letters are put together before a conversation's blocks are.
BLOCK_TURNS = 4096
FIRST, SYSTEM, USER, ASSISTANT = range(4)
#: What may follow the last role written, and the role that can be made or inserted there.
NEXT = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
MADE = ("u", "u", "a", "u")
NAMES = {"u": "user", "a": "assistant"}
FAR = 1 << 60
SPACE = r"\x20\x09-\x0D"


# --- search ----------------------------------------------------------------------------------------------------------


def suffix_bounds(turns: list[tuple[str, str]]) -> list[tuple[int, int, int, int]]:
    """For each number of turns read, what the rest costs at least from each last role."""

    def with_inserts(cost: list[int]) -> tuple[int, ...]:
        for _ in range(2):  # two in a row at most: a pair more would write what it needn't
            cost = [min(c, INSERT + cost[NEXT[q][MADE[q]]]) for q, c in enumerate(cost)]
        return tuple(cost)

    bounds = [with_inserts([0, FAR, FAR, 0])]
    for role, fault in reversed(turns):
        after, cost = bounds[-1], []
        for q in range(4):
            best = DELETE + after[q]
            if fault not in "bd":
                cut = CUT_OFF if fault == "t" else 0
                best = min(best, REROLE + cut + after[NEXT[q][MADE[q]]])
                if role in NEXT[q]:
                    best = min(best, KEEP + cut + after[NEXT[q][role]])
            cost.append(best)
        bounds.append(with_inserts(cost))
    return bounds[::-1]


class Way:
    """Edits from the root to a node, as a chain."""

    __slots__ = ("letter", "before", "depth")

    def __init__(self, letter: str, before: Way | None):
        self.letter, self.before, self.depth = letter, before, before.depth + 1 if before else 0

    def text(self) -> str:
        out, way = [], self
        while way.before:
            out.append(way.letter)
            way = way.before
        return "".join(reversed(out))

    def less(self, other: Way) -> bool:
        """Whether its letters sort before the other's: by where the two chains part."""
        a, b, x, y = self, other, "", ""
        while a is not b:
            if a.depth >= b.depth:
                x, a, down = a.letter, a.before, a.depth
                if b.depth < down:
                    continue
            y, b = b.letter, b.before
        return x < y


def search(turns: list[tuple[str, str]], bounds: list[tuple[int, int, int, int]] | None = None) -> tuple[int, str]:
    """Least cost and the ASCII-least audit of it for (role initial, fault) of each turn; faults are b, d and t."""
    n = len(turns)
    bounds = bounds or suffix_bounds(turns)
    best_cost, best_way, best_letters, on_best = FAR, None, "", set()
    table: dict[tuple[int, int], tuple[int, Way]] = {}
    stack = [(0, 0, FIRST, Way("", None))]

    def beaten(cost: int, way: Way) -> bool:
        """Whether a branch whose cost is at least ``cost`` can't come before the incumbent."""
        if cost != best_cost:
            return cost > best_cost
        last = way
        while id(way) not in on_best:
            last, way = way, way.before
        # the incumbent leaves the shared part with a letter of its own
        return last is not way and not last.letter < best_letters[way.depth : way.depth + 1]

    while stack:
        cost, i, q, way = stack.pop()
        if beaten(cost + bounds[i][q], way):
            continue
        known = table.get((i, q))
        if known and (known[0] < cost or known[0] == cost and known[1] is not way and not way.less(known[1])):
            continue
        table[i, q] = (cost, way)
        if i == n and q in (FIRST, ASSISTANT) and not beaten(cost, way):
            best_cost, best_way, best_letters = cost, way, way.text()
            on_best, step = set(), way
            while step:
                on_best.add(id(step))
                step = step.before
        made = NEXT[q][MADE[q]]
        open_ = [(cost + INSERT, i, made, "I")]
        if i < n:
            role, fault = turns[i]
            open_.append((cost + DELETE, i + 1, q, "D"))
            if fault not in "bd":
                cut = CUT_OFF if fault == "t" else 0
                open_.append((cost + REROLE + cut, i + 1, made, "R"))
                if role in NEXT[q]:
                    open_.append((cost + KEEP + cut, i + 1, NEXT[q][role], "K"))
        # the last one put there is looked at first
        open_.sort(key=lambda x: (x[0] + bounds[x[1]][x[2]], x[3]), reverse=True)
        stack.extend((c, at, to, Way(letter, way)) for c, at, to, letter in open_ if c + bounds[at][to] <= best_cost)
    return best_cost, best_way.text()


def written_turns(turns: list[tuple[str, str]], audit: str) -> Iterator[tuple[int | None, str | None]]:
    """Of every turn of the repaired conversation: the number of the turn it was, and its role where that is new."""
    n, q = 0, FIRST
    for letter in audit:
        n += letter != "I"
        if letter == "K":
            q = NEXT[q][turns[n - 1][0]]
            yield n, None
        elif letter != "D":
            role = MADE[q]
            q = NEXT[q][role]
            yield (None if letter == "I" else n), NAMES[role]


# --- tables ----------------------------------------------------------------------------------------------------------


def fault(text: Column, first: Column) -> Column:
    """The first fault of a turn: b blank, d seen before, t cut off, else a dash."""
    return F.when(~text.rlike(f"[^{SPACE}]"), "b").when(~first, "d").when(~text.rlike(rf"[.!?][{SPACE}]*\z"), "t").otherwise("-")


def _numbered(conversations: DataFrame) -> DataFrame:
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    turns = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), said("role").alias("role"), said("text").alias("text"))
    turns = turns.withColumn("same", F.sha2(F.concat_ws("\0", "role", "text"), 256))
    return materialize(ranks.running(turns, ["conv_id"], ["turn", "same"], {"n": F.lit(1).cast("long")}).drop("n_total"), "turns")


def repair(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two tables: what was found and done in each conversation, and the turns of the repaired ones.

    The first has ``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit``, the second ``conv_id, at, role, text``.
    """
    turns = _numbered(conversations)
    # of the rows of one role and text, which are counted before the exchange, the first
    firsts = turns.groupBy("conv_id", "same").agg(F.min("n").alias("first")).select(F.col("conv_id").alias("of"), "first")
    marked = turns.join(firsts, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("n") == F.col("first")), "left")
    initial = F.substring("role", 1, 1)
    letters = F.concat(F.when(initial.isin("s", "u", "a"), initial).otherwise("-"), fault(F.col("text"), F.col("first").isNotNull()))
    joined = lambda name: F.array_join(F.transform(F.sort_array(F.collect_list(name)), lambda x: x["letters"]), "")
    blocks = marked.groupBy("conv_id", F.floor((F.col("n") - 1) / BLOCK_TURNS).alias("block")).agg(joined(F.struct("n", letters.alias("letters"))).alias("letters"))
    whole = blocks.groupBy("conv_id").agg(joined(F.struct("block", "letters")).alias("letters"))

    def look(rows: Iterator[tuple]) -> Iterator[tuple]:
        for conv_id, text in rows:
            roles, faults = text[::2], text[1::2]
            cost, audit = search(list(zip(roles, faults, strict=True)))
            illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(roles, roles[1:], strict=False))
            yield conv_id, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit, text

    kind = conversations.schema["conv_id"].dataType.simpleString()
    found = materialize(map_rows(whole, ["conv_id", "letters"], look, f"conv_id {kind}, blank long, duplicate long, truncated long, illegal long, cost long, audit string, letters string"), "audits")
    spans = turns.groupBy("conv_id", "turn").agg(F.count(F.lit(1)).alias("_k")).groupBy("conv_id").agg((F.max("turn") - F.min("turn") + 1 - F.count("turn")).alias("gap")).select(F.col("conv_id").alias("of"), "gap")
    report = found.join(spans, F.col("conv_id").eqNullSafe(F.col("of")), "left")
    report = report.select("conv_id", F.coalesce("gap", F.lit(0)).cast("long").alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit")

    def place(rows: Iterator[tuple]) -> Iterator[tuple]:
        for conv_id, audit, text in rows:
            for at, (n, role) in enumerate(written_turns(list(zip(text[::2], text[1::2], strict=True)), audit)):
                yield conv_id, at, n, role

    places = map_rows(found, ["conv_id", "audit", "letters"], place, f"of {kind}, at long, was long, becomes string")
    held = places.join(turns, F.col("of").eqNullSafe(F.col("conv_id")) & (F.col("was") == F.col("n")), "left")
    repaired = held.select(F.col("of").alias("conv_id"), "at", F.coalesce("becomes", "role").alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return report, repaired


def digests(repaired: DataFrame) -> DataFrame:
    """``conv_id`` and the digest of its turns, ``role:text`` on a line each.  Turns stream through in order; none waits for others."""

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        own, sha = None, None
        for conv_id, role, text in rows:
            if sha is None or conv_id != own:
                if sha is not None:
                    yield own, sha.hexdigest()
                own, sha = conv_id, hashlib.sha256()
            else:
                sha.update(b"\n")
            sha.update(f"{role}:{text}".encode())
        if sha is not None:
            yield own, sha.hexdigest()

    kind = repaired.schema["conv_id"].dataType.simpleString()
    ordered = repaired.repartition("conv_id").sortWithinPartitions("conv_id", "at")
    return map_rows(ordered, ["conv_id", "role", "text"], run, f"conv_id {kind}, repaired_sha256 string")


def report(conversations: DataFrame, every: DataFrame) -> DataFrame:
    """What was found in each conversation of ``every``, one without turns included, with the digest of its repaired turns."""
    found, turns = repair(conversations)
    digest = digests(turns).withColumnRenamed("conv_id", "of")
    rows = found.join(digest, F.col("conv_id").eqNullSafe(F.col("of")), "left").drop("of")
    names = rows.columns[1:]
    ids = every.select(F.col("conv_id").alias("of")).distinct()
    nothing = {"audit": F.lit(""), "repaired_sha256": F.lit(hashlib.sha256().hexdigest())}
    whole = ids.join(rows, F.col("of").eqNullSafe(F.col("conv_id")), "left")
    return whole.select(F.col("of").alias("conv_id"), *(F.coalesce(F.col(c), nothing.get(c, F.lit(0).cast("long"))).alias(c) for c in names))


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows with faults by a checksum of conversation and turn: gone, emptied, without ends of sentences, twice there, or the user's."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat_ws(":", said("conv_id"), said("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", kind.alias("kind"), said("role").alias("role"), said("text").alias("text")).where("kind != 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return rows.select(
        "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
        F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")


def crc32_sql(text: str) -> str:
    """The unsigned checksum of ASCII text: each byte is mixed in, then eight bits are shifted out."""
    steps = f"flatten(list_transform(range(1, length({text}) + 1), lambda i: list_concat([ascii(({text})[i])::bigint], list_transform(range(8), lambda k: -1::bigint))))"
    return f"xor(4294967295::bigint, list_reduce(list_concat([4294967295::bigint], {steps}), lambda c, b: case when b >= 0 then xor(c, b) else xor(c >> 1, 3988292384::bigint * (c & 1)) end))"


#: A fold over the rows from the last to the first: of each last role, the least (cost, audit) of what is left.
REPORT_SQL = rf"""
with rows_in as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as name from conversations),
kinds as (select *, ({crc32_sql("name")}) % 20 as kind from rows_in),
after as (
  select conv_id, turn, case when kind = 4 then 'user' else role end as role,
    case kind when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text, unnest(case when kind = 3 then [0, 1] else [0] end) as copy
  from kinds where kind <> 0
),
ordered as (
  select *, row_number() over (partition by conv_id order by turn nulls first, role, text, copy) as n, row_number() over (partition by conv_id, role, text order by turn nulls first, copy) as seen,
    case when left(role, 1) in ('s', 'u', 'a') then left(role, 1) else '-' end as initial
  from after
),
faults as (
  select *, case when not regexp_matches(text, '[^ 	-
]') then 'b' when seen > 1 then 'd' when not regexp_matches(text, '[.!?][ 	-
]*$') then 't' else '-' end as fault,
    lag(initial) over (partition by conv_id order by n) || initial as pair
  from ordered
),
found as (
  select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0)::bigint as gaps, count(*) filter (fault = 'b') as blank, count(*) filter (fault = 'd') as duplicate,
    count(*) filter (fault = 't') as truncated, count(*) filter (pair not in ('su', 'ua', 'au')) as illegal,
    list_reduce(
      list_concat([{{'step': 'i', 'acc': [{{'c': 0, 'a': ''}}, {{'c': 1000000000, 'a': ''}}, {{'c': 1000000000, 'a': ''}}, {{'c': 0, 'a': ''}}]}}],
        flatten([[{{'step': 'i', 'acc': null}}, {{'step': 'i', 'acc': null}}], flatten(list(list_transform([initial || fault, 'i', 'i'], lambda x: {{'step': x, 'acc': null}}) order by n desc))])),
      lambda s, e: {{'step': e.step, 'acc': list_transform([1, 2, 3, 4], lambda q: list_min(
        case when e.step = 'i' then [s.acc[q], {{'c': 2 + s.acc[[3, 3, 4, 3][q]].c, 'a': 'I' || s.acc[[3, 3, 4, 3][q]].a}}]
        when e.step[2] in ('b', 'd') then [{{'c': 3 + s.acc[q].c, 'a': 'D' || s.acc[q].a}}]
        else [{{'c': 3 + s.acc[q].c, 'a': 'D' || s.acc[q].a}},
          {{'c': 2 + (e.step[2] = 't')::int + s.acc[[3, 3, 4, 3][q]].c, 'a': 'R' || s.acc[[3, 3, 4, 3][q]].a}},
          case when e.step[1] = 's' and q = 1 then {{'c': (e.step[2] = 't')::int + s.acc[2].c, 'a': 'K' || s.acc[2].a}}
          when e.step[1] = case when q = 3 then 'a' else 'u' end then {{'c': (e.step[2] = 't')::int + s.acc[[3, 3, 4, 3][q]].c, 'a': 'K' || s.acc[[3, 3, 4, 3][q]].a}}
          else {{'c': 2000000000, 'a': ''}} end] end))}}).acc[1] as best
  from faults group by conv_id
),
letters as (select conv_id, unnest(range(1, length(best.a) + 1)) as k, best.a[k] as letter from found),
placed as (
  select *, sum((letter <> 'I')::int) over (partition by conv_id order by k) as n, sum((letter <> 'D')::int) over (partition by conv_id order by k) as m from letters
),
said as (
  select p.conv_id, p.m, p.letter, f.role, f.text, max((p.m = 1 and p.letter = 'K' and f.initial = 's')::int) over (partition by p.conv_id) as led
  from placed p left join faults f on p.conv_id is not distinct from f.conv_id and p.n = f.n and p.letter <> 'I' where p.letter <> 'D'
),
turns as (
  select conv_id, string_agg(case when letter = 'K' then role when (m - led) % 2 = 1 then 'user' else 'assistant' end || ':' || coalesce(text, ''), chr(10) order by m) as whole from said group by conv_id
)
select c.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal,
  coalesce(best.c, 0)::bigint as cost, coalesce(best.a, '') as audit, sha256(coalesce(whole, '')) as repaired_sha256
from (select distinct conv_id from conversations) c left join found f on c.conv_id is not distinct from f.conv_id left join turns t on c.conv_id is not distinct from t.conv_id
"""
