"""Chat formatting by quotation linking, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut

_LEVEL = r"^[ \t]*((?:>[ \t]?)+)"


def _normal(text: Column) -> Column:
    """A passage as it is compared: lower case, white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(text), r"[\x20\x09-\x0D]+", " "))


def _key(text: Column) -> Column:
    """The hash of a passage; null for one without words."""
    return F.when(_normal(text) != "", F.sha2(_normal(text), 256))


def passages(messages: DataFrame) -> DataFrame:
    """The passages of messages (conv, turn, uid, text): level (quote marks) and said (their lines without marks).

    A passage is a run of lines of one level. Each step is a column of its own,
    so none is computed once for every use, and no line becomes a row.
    """
    rows = messages.select("conv", "turn", "uid", F.split("text", r"\r\n|\r|\n").alias("lines"))
    marks = F.transform("lines", lambda x: F.when(F.contains(x, F.lit(">")), F.length(F.regexp_replace(F.regexp_extract(x, _LEVEL, 1), "[^>]", ""))).otherwise(F.lit(0)))
    rows = rows.withColumn("levels", marks)
    said = F.zip_with("lines", "levels", lambda x, n: F.when(n > 0, F.regexp_replace(x, _LEVEL, "")).otherwise(x))
    before = F.concat(F.array(F.lit(-1)), F.slice("levels", F.lit(1), F.size("levels") - 1))
    starts = F.filter(F.transform(F.zip_with("levels", before, lambda n, m: n != m), lambda new, i: F.when(new, i)), lambda i: i.isNotNull())
    rows = rows.withColumns({"said": said, "starts": starts})
    ends = F.concat(F.slice("starts", F.lit(2), F.size("starts")), F.array(F.size("lines")))
    rows = rows.withColumn("spans", F.arrays_zip(F.col("starts").alias("start"), ends.alias("end")))
    runs = F.transform("spans", lambda s: F.struct(F.get("levels", s["start"]).alias("level"), F.array_join(F.slice("said", s["start"] + 1, s["end"] - s["start"]), "\n").alias("said")))
    return rows.select("conv", "turn", "uid", F.posexplode(runs).alias("passage", "run")).select("conv", "turn", "uid", "passage", "run.level", "run.said")


def _originals(asked: DataFrame, own: DataFrame) -> DataFrame:
    """Quotes (conv, turn, uid, passage, level, key) with own_turn, where their own conversation says the key first, and orig, where any does.

    Only keys that somebody quotes are looked for; each has one original in a
    conversation and one in all, so no passage multiplies. Keys that hold a
    large part of a table are dealt by (key, salt).
    """
    firsts = cut(own.join(asked.select("key").distinct(), "key", "left_semi").groupBy("key", "conv").agg(F.min("turn").alias("own_turn")))
    here = firsts.select(F.col("key").alias("__key"), F.col("conv").alias("__conv"), "own_turn")
    first = firsts.groupBy("key").agg(F.min(F.struct("conv", F.col("own_turn").alias("turn"))).alias("orig"))
    near = asked.join(here, (F.col("key") == F.col("__key")) & F.col("conv").eqNullSafe(F.col("__conv")), "left").drop("__key", "__conv")
    return near.join(asked.select("key", "salt").distinct().join(first, "key"), ["key", "salt"], "left")


def _linked(base: DataFrame, salts: int) -> DataFrame:
    """The quoted passages of all messages with their originals: whole passages, or else what their single lines have."""
    # Repeated rows have one uid and quote the same.
    quoting = base.where(F.col("text").contains(">")).dropDuplicates(["uid"])
    own = cut(passages(base).where("level = 0").withColumn("key", _key(F.col("said"))).where("key is not null").select("conv", "turn", "key", "said"))
    salt = F.pmod(F.xxhash64("uid"), F.lit(salts))
    asked = cut(passages(quoting).where("level > 0").withColumn("key", _key(F.col("said"))).where("key is not null").withColumn("salt", salt))
    found = cut(_originals(asked.drop("said"), own.drop("said")).drop("salt"))
    part = cut(asked.join(found.where("orig is null").select("uid", "passage"), ["uid", "passage"], "left_semi"))
    if part.isEmpty():
        return found

    def each(rows: DataFrame) -> DataFrame:
        return rows.withColumn("said", F.explode(F.split("said", "\n"))).withColumn("key", _key(F.col("said"))).where("key is not null").drop("said")

    lines = _originals(each(part).distinct(), each(own).distinct()).groupBy("uid", "passage").agg(F.min("orig").alias("line_orig"), F.min("own_turn").alias("line_turn"))
    return found.join(lines, ["uid", "passage"], "left").withColumns({"orig": F.coalesce("orig", "line_orig"), "own_turn": F.coalesce("own_turn", "line_turn")}).drop("line_orig", "line_turn")


def link_quotes(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", salts: int = 32) -> DataFrame:
    """One row per message: conv, turn, role, content, quote_levels, quoted, linked, reply_conv, reply_turn, position, thread_conv, thread_turn, depth.

    A line's quote level is its number of leading ``>``; lines of one level that
    follow one another are a passage, which is hashed after normalising case
    and white space. A quoted passage is linked with the first message (by
    conversation, then turn) that has it as a passage of its own; one that nobody
    says as a whole, with the first that says one of its lines.
    A message replies to the latest message that its passages of level 1 are
    linked with and that comes before it, in its own conversation if there is
    one; without such a quote to the turn before it, if any (reply_turn of the
    first one is null). content is the text without quoted lines, position the
    message's place in its conversation by (turn, text), from 0.

    The conversations in order of replies: following them leads to the message
    that a thread begins with (thread_conv, thread_turn) in ``depth`` steps, so
    rows of a thread in order of depth come after what they reply to.

    quoted counts quoted passages with words, linked those with an original. Null
    texts are empty, null conversations are one conversation, repeated rows are
    messages of their own (in an order that equal rows may swap), long texts and
    long quotes count whole; other columns of ``messages`` are not used, whatever
    their names; an empty table gives an empty table. Passages that hold a large
    part of a table are dealt by (hash, salt), and so are conversations.
    """
    base = messages.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("uid", F.xxhash64("conv", "turn", "role", "text"))
    top = F.col("level") == 1
    own = F.when(top & (F.col("own_turn") < F.col("turn")), F.struct("conv", F.col("own_turn").alias("turn")))
    other = F.when(top & (F.col("orig") < F.struct("conv", "turn")), F.col("orig"))
    per = _linked(base, salts).groupBy("uid").agg(F.max("level").alias("quote_levels"), F.count(F.lit(1)).alias("quoted"), F.count("orig").alias("linked"), F.max(own).alias("own"), F.max(other).alias("any"))
    clean = F.trim(F.regexp_replace(F.regexp_replace("text", r"(?m)^[ \t]*>[^\r\n]*(?:\r\n|\r|\n)?", ""), r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", ""))

    # Positions without one task for one conversation: turns are counted first, equal turns are few.
    turns = cut(base.groupBy("conv", "turn").agg(F.count(F.lit(1)).alias("n")))
    reply_conv = F.coalesce("own.conv", "any.conv", F.when(F.col("previous").isNotNull(), F.col("conv")))
    reply_turn = F.when(F.col("own").isNotNull(), F.col("own.turn")).when(F.col("any").isNotNull(), F.col("any.turn")).otherwise(F.col("previous"))
    counts = {c: F.coalesce(c, F.lit(0)) for c in ("quote_levels", "quoted", "linked")}
    placed = cut(_place(base.join(per, "uid", "left"), turns).select("conv", "turn", "role", clean.alias("content"), *[v.alias(c) for c, v in counts.items()], reply_conv.alias("reply_conv"), reply_turn.alias("reply_turn"), "position", F.xxhash64("conv", "turn").alias("node")))
    threaded = placed.join(_threads(placed), "node").drop("node")
    return threaded.withColumnsRenamed({"conv": conv_col, "turn": turn_col, "role": role_col})


def _threads(replies: DataFrame) -> DataFrame:
    """node, thread_conv, thread_turn, depth of each (conv, turn), by pointer jumping along the replies.

    A reply goes to a turn before it, so there are no rings; rounds grow with the
    logarithm of the longest chain, and a round joins only what has not arrived.
    """
    up = F.when(F.col("reply_turn").isNotNull(), F.struct(F.col("reply_conv").alias("conv"), F.col("reply_turn").alias("turn")))
    nodes = cut(replies.groupBy("node", "conv", "turn").agg(F.max(up).alias("up")).select("node", "conv", "turn", F.when(F.col("up").isNotNull(), F.xxhash64("up.conv", "up.turn")).alias("up")))
    open_ = cut(nodes.select("node", F.col("up").alias("to"), F.lit(1).cast("long").alias("steps")).where("to is not null"))
    arrived = nodes.where("up is null").select("node", F.col("node").alias("root"), F.lit(0).cast("long").alias("depth"))
    while not open_.isEmpty():
        ends = arrived.select(F.col("node").alias("to"), "root", "depth")
        further = open_.select(F.col("node").alias("to"), F.col("to").alias("next"), F.col("steps").alias("more"))
        step = cut(open_.join(ends, "to", "left").join(further, "to", "left"))
        arrived = cut(arrived.unionByName(step.where("root is not null").select("node", "root", (F.col("steps") + F.col("depth")).alias("depth"))))
        open_ = cut(step.where("root is null and next is not null").select("node", F.col("next").alias("to"), (F.col("steps") + F.col("more")).alias("steps")))
    named = nodes.select(F.col("node").alias("root"), F.col("conv").alias("thread_conv"), F.col("turn").alias("thread_turn"))
    return arrived.join(named, "root").select("node", "thread_conv", "thread_turn", "depth")


def _place(rows: DataFrame, turns: DataFrame, block: int = 4096) -> DataFrame:
    """``rows`` with position and previous turn; long conversations are counted in blocks of turns."""
    blocks = turns.withColumn("block", F.floor(F.coalesce(F.col("turn"), F.lit(-1)) / block))
    sums = blocks.groupBy("conv", "block").agg(F.sum("n").alias("in_block"), F.max("turn").alias("last"))
    over = W.partitionBy("conv").orderBy("block")
    sums = sums.select("conv", "block", F.coalesce(F.sum("in_block").over(over.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("ahead"), F.lag("last").over(over).alias("last_ahead"))
    within = W.partitionBy("conv", "block").orderBy("turn")
    sums = sums.withColumnsRenamed({"conv": "__c", "block": "__b"})
    placed = blocks.join(sums, F.col("conv").eqNullSafe(F.col("__c")) & (F.col("block") == F.col("__b"))).drop("__c", "__b")
    placed = placed.select("conv", "turn", (F.col("ahead") + F.coalesce(F.sum("n").over(within.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).alias("first_at"), F.coalesce(F.lag("turn").over(within), F.col("last_ahead")).alias("previous"))
    named = placed.select(F.col("conv").alias("__c"), F.col("turn").alias("__t"), "first_at", "previous")
    joined = rows.join(named, F.col("conv").eqNullSafe(F.col("__c")) & F.col("turn").eqNullSafe(F.col("__t")))
    same = W.partitionBy("conv", "turn").orderBy("text", "role")
    return joined.withColumn("position", F.col("first_at") + F.row_number().over(same) - 1).drop("__c", "__t", "first_at")
