"""Chat formatting in budgeted windows.

Prefix sums of turn tokens choose the windows: each takes whole turns from where the last one ended for as long as the sum stays
within the room that the system turn and the history leave.  A window repeats the conversation's first system turn and a
limited number of tokens of the turns before it; what is repeated is never a target.  The loss mask holds the text of each
assistant turn once.  Turns are numbered over ranges of rows and cut into blocks of so many turns, the last ones of a block going
along to the next as history, so no task needs a whole conversation; a window ends where its block does.

A turn is written ``### role:``, line feed, text, line feed, ``</turn>``, line feed.  In roles and texts, a backslash is written as
``\\s``, ``#`` as ``\\h``, ``<`` as ``\\l`` and a role's line feed as ``\\n``, so neither marker can occur in them.

Defined cases: a null text or role is empty; null turn numbers come first; rows of one turn number go by role, then text;
a null ``conv_id`` is one conversation; a repeated row is a turn of its own; a turn longer than the room has a window to itself,
however long; a conversation without an assistant has an empty mask; an empty table gives no windows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators import ranks
from .common import materialize

BUDGET = 1024
HISTORY = 192
BLOCK_TURNS = 256
#: Characters of a role and a text that limits of ranges hold; a task orders by the whole of them.
KEY_CHARS = 32
#: Tokens that a turn's markers take.
MARKERS = 6
END = "\n</turn>\n"


def escape(text: Column) -> Column:
    for plain, code in (("\\", "\\s"), ("#", "\\h"), ("<", "\\l")):
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    for code, plain in (("\\l", "<"), ("\\h", "#"), ("\\s", "\\")):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def tokens(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"\w+|[^\w\s]")) + MARKERS


def _parts(turns: Column) -> Column:
    """Template text of each turn, and where its own text starts in it."""
    head = lambda t: F.concat(F.lit("### "), F.replace(escape(t["role"]), F.lit("\n"), F.lit("\\n")), F.lit(":\n"))
    return F.transform(turns, lambda t: F.struct(t["role"].alias("role"), F.char_length(head(t)).alias("head"), F.concat(head(t), escape(t["text"]), F.lit(END)).alias("part")))


def windows(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """``conv_id``, the window's place, ``formatted``, ``n_repeated`` leading turns and ``loss_spans`` (start from 0, length) in code points."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    turns = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), said("role").alias("role"), said("text").alias("text")).withColumn("size", tokens(F.col("text")).cast("long"))
    # number and prefix sum of each turn in its conversation; nulls sort first
    first = lambda c: F.substring(c, 1, KEY_CHARS)
    placed = ranks.running(turns, ["conv_id"], ["turn", "role", "text"], {"n": F.lit(1).cast("long"), "until": F.col("size")}, ["turn", first("role"), first("text")])
    placed = materialize(placed.select("conv_id", "n", "until", "size", "role", "text", F.floor((F.col("n") - 1) / block_turns).alias("block")), "turns")
    system = materialize(placed.where("role = 'system'").groupBy(F.col("conv_id").alias("of")).agg(F.min(F.struct("n", "size", "role", "text")).alias("system")), "system")
    # the last turns of a block are history to the next one
    end = F.max("until").over(Window.partitionBy("conv_id", "block"))
    left = placed.withColumn("left", end - F.col("until") + F.col("size"))
    dealt = left.withColumn("at", F.explode(F.when(F.col("left") <= history, F.array("block", F.col("block") + 1)).otherwise(F.array("block")))).withColumn("own", F.col("at") == F.col("block"))
    turn = F.struct("n", "until", "size", "role", "text", "own")
    blocks = dealt.groupBy("conv_id", F.col("at").alias("block")).agg(F.sort_array(F.collect_list(turn)).alias("turns")).withColumn("mine", F.filter("turns", lambda t: t["own"])).where(F.size("mine") > 0)
    blocks = blocks.join(system.hint("merge"), F.col("conv_id").eqNullSafe(F.col("of")), "left").drop("of")
    room = F.greatest(F.lit(budget // 4), F.lit(budget - history) - F.coalesce(F.col("system.size"), F.lit(0)))
    first = F.get("mine", F.lit(0))
    # a new window where the sum since the last one's start is more than the room, unless the turn is its first
    step = lambda a, t: F.when((t["until"] - a["base"] > a["room"]) & (t["until"] - t["size"] > a["base"]), F.struct(F.concat(a["starts"], F.array(t["n"])).alias("starts"), (t["until"] - t["size"]).alias("base"), a["room"].alias("room"))).otherwise(a)
    starts = F.aggregate("mine", F.struct(F.array(first["n"]).alias("starts"), (first["until"] - first["size"]).alias("base"), room.cast("long").alias("room")), step, lambda a: a["starts"])
    cut = blocks.withColumn("starts", starts).select("*", F.posexplode("starts").alias("span", "start")).withColumn("stop", F.coalesce(F.get("starts", F.col("span") + 1), F.lit((1 << 62))))
    chosen = cut.withColumn("targets", F.filter("mine", lambda t: (t["n"] >= F.col("start")) & (t["n"] < F.col("stop"))))
    begin = F.get("targets", F.lit(0))
    chosen = chosen.withColumn("base", begin["until"] - begin["size"]).withColumn("before", F.filter("turns", lambda t: (t["n"] < F.col("start")) & (F.col("base") - (t["until"] - t["size"]) <= history)))
    plain = lambda turns: F.transform(turns, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    shown = F.exists(F.concat("before", "targets"), lambda t: t["n"] == F.col("system.n"))
    lead = F.when(F.col("system").isNotNull() & ~shown, F.array(F.struct(F.col("system.role").alias("role"), F.col("system.text").alias("text")))).otherwise(F.array().cast("array<struct<role:string,text:string>>"))
    built = (
        chosen.withColumn("repeated", F.concat(lead, plain(F.col("before"))))
        .withColumn("n_repeated", F.size("repeated"))
        .withColumn("parts", _parts(F.concat("repeated", plain(F.col("targets")))))
        .withColumn("lengths", F.transform("parts", lambda p: F.char_length(p["part"])))
    )
    span = lambda p, i: F.struct((F.aggregate(F.slice("lengths", F.lit(1), i), F.lit(0), lambda a, b: a + b) + p["head"]).alias("start"), (F.char_length(p["part"]) - p["head"] - len(END)).alias("length"), ((i >= F.col("n_repeated")) & (p["role"] == "assistant")).alias("target"))
    return built.select(
        "conv_id", "block", "span",
        F.array_join(F.transform("parts", lambda p: p["part"]), "").alias("formatted"),
        "n_repeated",
        F.transform(F.filter(F.transform("parts", span), lambda s: s["target"]), lambda s: F.struct(s["start"].alias("start"), s["length"].alias("length"))).alias("loss_spans"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """Turns and loss text of every window, from its formatted text and mask alone."""
    parts = F.split("formatted", END)
    own = F.slice(parts, F.col("n_repeated") + 1, F.size(parts) - 1 - F.col("n_repeated"))
    body = F.transform(own, lambda p: F.substring(p, F.lit(5), F.char_length(p)))
    role = lambda b: F.substring_index(b, ":\n", 1)
    turns = F.transform(body, lambda b: F.concat(unescape(F.replace(role(b), F.lit("\\n"), F.lit("\n"))), F.lit("\n"), unescape(F.substring(b, F.char_length(role(b)) + 3, F.char_length(b))), F.lit("\n")))
    loss = F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["length"])))
    return formatted.select("*", turns.alias("turns"), F.array_join(loss, "").alias("loss_text"))


def digests(formatted: DataFrame) -> DataFrame:
    """A row for each conversation.  A digest of a whole conversation needs its text in one place; nothing else here does."""
    place = F.struct("block", "span", F.array_join("turns", "").alias("text"), F.col("loss_text").alias("loss"))
    rows = read_back(formatted).groupBy("conv_id").agg(F.sum(F.size("turns")).cast("long").alias("n_turns"), F.sort_array(F.collect_list(place)).alias("all"), F.sum(F.char_length("formatted")).cast("long").alias("formatted_chars"))
    joined = lambda name: F.array_join(F.transform("all", lambda w: w[name]), "")
    return rows.select(
        "conv_id", "n_turns", F.sha2(joined("text"), 256).alias("turns_sha256"), F.char_length(joined("loss")).cast("long").alias("loss_chars"),
        F.sha2(joined("loss"), 256).alias("loss_sha256"), "formatted_chars",
    )
