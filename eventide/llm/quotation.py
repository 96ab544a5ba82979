"""Chat formatting by quotation linking, in DataFrame functions only.

A line's quote level is the number of ``>`` marks it begins with. Lines are normalised (ends
stripped, white space collapsed, A-Z lower-cased). A passage is a run of lines of one level
without a blank line between them. Quoted passages are hashed whole, and by line if they have
several, and joined by hash to the messages whose own text has such a passage or line first: in
the same conversation, else anywhere before. A passage that is known whole counts once for each
of its lines; only if it isn't, each of its known lines counts once. For each message and level
the original with the highest count wins (then one of the same conversation, then the latest); the
winner of the lowest level is the message replied to. A message that quotes nothing known
replies to the previous turn.

Messages are named by (conv_id, turn). A reply's parent is always smaller in that order, so
there are no cycles. Each message gets its thread's first message, its depth and its place in
the thread by (depth, conv_id, turn), and its own text without quotes and without the
attribution line (one that ends in a colon) above a quote.

A conversation or thread of any size is spread over tasks: previous turns and places come from
range shuffles (``ranked``), and ``conversations`` gives a thread in parts of ``PART`` messages.

Null text counts as empty. A row without conv_id or turn is a thread of its own. Rows that
repeat a name share parent, depth, place and thread, and keep their own texts. Blank quoted lines
link nothing. A message that only quotes has an empty own text. Lines and texts of any length
are read in linear time. An empty table gives an empty result; extra columns travel with their
row, those named like the results are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ranking import ranked
from .common import SPACE, ascii_lower, let, stored

_MARK = r"^[ \t]*(>[> \t]*)"
#: Messages of a thread that are gathered in one row at most.
PART = 200
_NEW = ("parent_conv", "parent_turn", "thread_conv", "thread_turn", "depth", "place", "quote_levels", "n_quoted", "own_text")


def _normal(line: Column) -> Column:
    return let(lambda v: ascii_lower(v["x"]), x=F.trim(F.regexp_replace(line, r"[\x20\x09-\x0D]+", " ")))


def parse(text: Column) -> Column:
    """The lines of a text as (level, body, normal)."""
    marks = lambda x: F.regexp_extract(x, _MARK, 1)
    return F.transform(
        F.split(F.coalesce(text, F.lit("")), "\n"),
        lambda x: F.struct(F.length(F.translate(marks(x), " \t", "")).alias("level"), F.regexp_replace(x, _MARK, "").alias("body"), _normal(F.regexp_replace(x, _MARK, "")).alias("normal")),
    )


def own_lines(lines: str = "_lines") -> Column:
    """Lines outside quotes, but no attribution lines."""
    above = lambda k: F.coalesce(F.get(lines, k + 1)["level"], F.lit(0)) > 0
    return F.filter(lines, lambda x, k: (x["level"] == 0) & ~(above(k) & x["normal"].endswith(":")))


def _sha(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


def passages(lines: str = "_lines", quoted: bool = True) -> Column:
    """The passages of a parsed text as (level, lines): of its quotes, or of its own lines.

    Lines are joined again, with a blank line wherever a passage ends, and split at those."""
    if quoted:
        shown = lambda x: F.when((x["level"] > 0) & (x["normal"] != ""), F.concat(x["level"].cast("string"), F.lit(">"), x["normal"])).otherwise("")
    else:
        above = lambda k: F.coalesce(F.get(lines, k + 1)["level"], F.lit(0)) > 0
        shown = lambda x, k: F.when((x["level"] == 0) & ~(above(k) & x["normal"].endswith(":")), F.concat(F.lit("0>"), x["normal"])).otherwise("")
    breaks = lambda x, k: F.when(F.get(lines, k - 1)["level"] != x["level"], F.lit("\n")).otherwise("")
    flat = F.array_join(F.transform(lines, lambda x, k: F.concat(breaks(x, k), shown(x) if quoted else F.when(x["normal"] != "", shown(x, k)).otherwise(""))), "\n")
    runs = F.filter(F.split(flat, "\n\n+"), lambda p: F.length(p) > 0)
    cut = lambda line: F.regexp_replace(line, "^[0-9]+>", "")
    body = lambda p: F.transform(F.filter(F.split(p, "\n"), lambda x: F.length(x) > 0), cut)
    return F.transform(runs, lambda p: F.struct(F.regexp_extract(p, "([0-9]+)>", 1).cast("int").alias("level"), body(p).alias("lines")))


def _units(p: Column) -> Column:
    """What of a passage is looked up: (hash, weight), whole first and then by line if it has several."""
    whole = F.array(F.struct(_sha(F.array_join(p["lines"], "\n")).alias("h"), F.size(p["lines"]).alias("weight"), F.lit(True).alias("whole")))
    by_line = F.transform(p["lines"], lambda x: F.struct(_sha(x).alias("h"), F.lit(1).alias("weight"), F.lit(False).alias("whole")))
    return F.concat(whole, F.when(F.size(p["lines"]) > 1, by_line).otherwise(F.slice(by_line, 1, 0)))


def link(parsed: DataFrame) -> DataFrame:
    """conv_id, turn, parent: the message that quotes point to, for messages whose quotes are known."""
    me = F.struct(F.col("conv_id").alias("c"), F.col("turn").alias("t"))
    named = parsed.where("conv_id is not null and turn is not null")
    known = F.array_distinct(F.flatten(F.transform(passages(quoted=False), lambda p: F.transform(_units(p), lambda u: u["h"]))))
    own = named.select("conv_id", "turn", F.explode(known).alias("h"))
    here = own.groupBy("conv_id", "h").agg(F.min("turn").alias("first_turn"))
    anywhere = here.groupBy("h").agg(F.min(F.struct(F.col("conv_id").alias("c"), F.col("first_turn").alias("t"))).alias("first"))
    quoted = named.where(F.exists("_lines", lambda x: x["level"] > 0)).select("conv_id", "turn", F.posexplode(passages()).alias("pos", "p"), F.xxhash64("_lines").alias("copy"))
    quoted = quoted.select("conv_id", "turn", "copy", "pos", "p.level", F.explode(_units(F.col("p"))).alias("u")).select("conv_id", "turn", "copy", "pos", "level", "u.*")
    found = quoted.join(here, ["conv_id", "h"], "left").join(anywhere, "h", "left")
    same = F.when(F.col("first_turn") < F.col("turn"), F.struct(F.col("conv_id").alias("c"), F.col("first_turn").alias("t")))
    before = F.when(F.col("first") < me, F.col("first"))
    hits = found.select("conv_id", "turn", "copy", "pos", "level", "weight", "whole", F.coalesce(same, before).alias("of")).where("of is not null")
    settled = F.bool_or("whole").over(Window.partitionBy("conv_id", "turn", "copy", "pos"))
    votes = hits.withColumn("settled", settled).where("whole or not settled").groupBy("conv_id", "turn", "level", "of").agg(F.sum("weight").alias("n"))
    best = F.max(F.struct((-F.col("level")).alias("nearest"), F.col("n"), (F.col("of")["c"] == F.col("conv_id")).alias("same"), F.col("of"))).alias("best")
    return votes.groupBy("conv_id", "turn").agg(best).select("conv_id", "turn", F.col("best")["of"].alias("parent"))


def threads(parents: DataFrame, rounds: int = 64) -> DataFrame:
    """me, up (the thread's first message) and depth, by pointer jumping: each round doubles the
    distance for messages that haven't reached their start, and is written to the shared folder.
    ``parents``: me, parent (null at a start)."""
    start = F.col("parent").isNull()
    now = stored(parents.select("me", F.coalesce("parent", "me").alias("up"), F.when(start, 0).otherwise(1).alias("depth"), start.alias("done")), "threads")
    for _ in range(rounds):
        going = now.where("not done")
        if going.isEmpty():
            return now.drop("done")
        above = now.select(F.col("me").alias("_me"), F.col("up").alias("_up"), F.col("depth").alias("_depth"), F.col("done").alias("_done"))
        moved = going.join(above, F.col("up") == F.col("_me")).select("me", F.col("_up").alias("up"), (F.col("depth") + F.col("_depth")).alias("depth"), F.col("_done").alias("done"))
        now = stored(now.where("done").unionByName(moved), "threads")
    raise RuntimeError(f"the threads did not settle in {rounds} rounds")


def previous_turns(names: DataFrame) -> DataFrame:
    """conv_id, turn and _prev, the turn before it: rows are numbered in one order over the whole
    table and meet the row of the number before."""
    at = stored(ranked(names, [], [F.asc("conv_id"), F.asc("turn")], "_n"), "turns")
    before = at.select(F.col("conv_id").alias("_c"), F.col("turn").alias("_before"), (F.col("_n") + 1).alias("_n"))
    prev = F.when(F.col("_c") == F.col("conv_id"), F.struct(F.col("conv_id").alias("c"), F.col("_before").alias("t")))
    return at.join(before, "_n", "left").select("conv_id", "turn", prev.alias("_prev"))


def format_chats(messages: DataFrame, text: str = "text") -> DataFrame:
    """The rows with parent_conv, parent_turn, thread_conv, thread_turn, depth, place (in the
    thread, from 0), quote_levels (the deepest), n_quoted (lines) and own_text."""
    kept = [c for c in messages.columns if c not in _NEW]
    parsed = messages.select(F.struct(*kept).alias("_own"), "conv_id", "turn", parse(F.col(text)).alias("_lines"))
    name = F.struct(F.col("conv_id").alias("c"), F.col("turn").alias("t"))
    names = messages.where("conv_id is not null and turn is not null").select("conv_id", "turn").distinct()
    chain = previous_turns(names)
    parents = stored(chain.join(link(parsed), ["conv_id", "turn"], "left").select(name.alias("me"), F.coalesce("parent", "_prev").alias("parent")), "parents")
    placed = ranked(threads(parents), ["up"], [F.asc("depth"), F.asc("me")]).join(parents, "me")
    table = placed.select(F.col("me.c").alias("_c"), F.col("me.t").alias("_t"), F.col("parent.c").alias("parent_conv"), F.col("parent.t").alias("parent_turn"), F.col("up.c").alias("thread_conv"), F.col("up.t").alias("thread_turn"), F.col("depth").cast("bigint").alias("depth"), (F.col("place") - 1).alias("place"))
    out = parsed.join(table, (F.col("conv_id") == F.col("_c")) & (F.col("turn") == F.col("_t")), "left").drop("_c", "_t")
    levels = F.coalesce(F.array_max(F.transform("_lines", lambda x: x["level"])), F.lit(0)).cast("bigint")
    n = F.size(F.filter("_lines", lambda x: x["level"] > 0)).cast("bigint")
    own = F.trim(F.array_join(F.transform(own_lines(), lambda x: x["body"]), "\n"), F.lit(SPACE))
    lone = {"thread_conv": F.coalesce("thread_conv", "conv_id"), "thread_turn": F.coalesce("thread_turn", "turn"), "depth": F.coalesce("depth", F.lit(0).cast("bigint")), "place": F.coalesce("place", F.lit(0).cast("bigint"))}
    return out.withColumns(lone | {"quote_levels": levels, "n_quoted": n, "own_text": own}).select("_own.*", *_NEW)


def parts(formatted: DataFrame) -> DataFrame:
    """Adds ``part``: a thread's rows in reply order, ``PART`` at a time (null without conv_id or turn)."""
    named = formatted.where("conv_id is not null and turn is not null")
    order = [F.asc(c) for c in ("place", "conv_id", "turn", "role", "own_text")]
    at = ranked(named, ["thread_conv", "thread_turn"], order, "part").withColumn("part", F.expr(f"(part - 1) div {PART}"))
    return at.unionByName(formatted.where("conv_id is null or turn is null").withColumn("part", F.lit(None).cast("bigint")))


def conversations(parted: DataFrame) -> DataFrame:
    """A thread's messages in reply order, as (role, text): rows of ``parts``, gathered by part. A row
    without conv_id or turn is a conversation by itself."""
    turn = F.struct("place", "conv_id", "turn", "role", "own_text")
    ordered = F.transform(F.array_sort(F.collect_list(turn)), lambda x: F.struct(x["role"].alias("role"), x["own_text"].alias("text")))
    long = parted.where("part is not null").groupBy("thread_conv", "thread_turn", "part").agg(ordered.alias("messages"))
    lone = F.array(F.struct("role", F.col("own_text").alias("text"))).alias("messages")
    return long.unionByName(parted.where("part is null").select("thread_conv", "thread_turn", "part", lone))
