"""Mixing sources to target weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut

#: Words are runs of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: Parts that a class of equally long documents is counted in, by their draws.
PARTS = 256


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """source, source_size, target: one row per source of ``sizes`` (source, size).

    Sources in order of code points, null last, weigh ``weights`` in turn. They
    share the total by weight, but none gets more than ``most`` times its size;
    what is left over goes to the others by weight until none is above. In
    order of size per weight this is one running sum: a source is at its limit
    if the rest, shared by the weights not yet at theirs, would lift it above.
    The table has a row per source, which is what makes its windows small.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = W.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    per = per.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
    by_limit = W.partitionBy(F.lit(0)).orderBy((F.col("source_size") / F.col("weight")), F.col("source").asc_nulls_last())
    everything = W.partitionBy(F.lit(0))
    before = by_limit.rowsBetween(W.unboundedPreceding, -1)
    limit = most * F.col("source_size")
    per = (
        per.withColumn("rest", F.sum("source_size").over(everything) - most * F.coalesce(F.sum("source_size").over(before), F.lit(0)))
        .withColumn("open", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("full", F.col("weight") * F.col("rest") >= limit * F.col("open"))
    )
    # Once one source stays below its limit, so do all after it, at one level a weight.
    first = F.min(F.when(~F.col("full"), F.struct(F.col("source_size") / F.col("weight"), F.col("rest"), F.col("open")))).over(everything)
    level = first["rest"].cast("double") / first["open"]
    below = F.col("weight") * level
    return per.withColumn("target", F.when(F.col("full"), limit.cast("double")).otherwise(F.least(limit.cast("double"), below))).select("source", "source_size", "target")


def _uniform(*parts: Column | str) -> Column:
    """A number from 0 to 1 from 48 bits of a SHA-256."""
    return F.conv(F.substring(F.sha2(F.concat_ws(":", *parts), 256), 1, 12), 16, 10).cast("double") / float(1 << 48)


def _class(size: Column) -> Column:
    """Sizes with the same number of digits and the same first two, as one number that rises with the size."""
    digits = size.cast("string")
    return (F.length(digits) * 100 + F.substring(digits, 1, 2).cast("int")).cast("int")


def _with_draws(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: str) -> DataFrame:
    """``docs`` with __source, __size, __class and __draw, which all follow from the row alone."""
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    draw = _uniform(F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.col(text_col).cast("string"), F.lit("")))
    return docs.withColumns({"__source": F.col(source_col), "__size": size, "__draw": draw}).withColumn("__class", _class(F.col("__size")))


def _attach(rows: DataFrame, table: DataFrame, keys: list[str], small: bool, salts: int = 64) -> DataFrame:
    """``rows`` with the columns of ``table``, which has one row for each of the keys; null meets null.

    The table is broadcast while it is small; beyond that, rows of one key are dealt over ``salts``.
    """
    other = table.withColumnsRenamed({k: f"{k}2" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"{k}2"))
    if small:
        return rows.join(F.broadcast(other), same).drop(*[f"{k}2" for k in keys])
    other = other.withColumn("__salt2", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64("__draw"), F.lit(salts)).cast("int"))
    return salted.join(other, same & (F.col("__salt") == F.col("__salt2"))).drop("__salt", "__salt2", *[f"{k}2" for k in keys])


def _plan(drawn: DataFrame, seed: str, max_small: int) -> tuple[DataFrame, bool]:
    """__source, __class, source_size, target, base, bound, share: a row for each source and class of sizes; and whether they are few.

    Of the documents of a source, taken in order of size, every one out of
    1 / fraction gets one copy more: with one offset drawn for the source, class
    c of n(c) documents gets floor(offset + fraction * n(1..c)) - floor(offset +
    fraction * n(1..c-1)) of them, those with the smallest draws. So each
    document's probability is the fraction, and what a source takes is off its
    target by about one document. ``bound`` is the last draw taken, ``share`` what
    part of the rows with this draw is: all, unless rows share an id, or a text without one.

    The draws of a class are first counted in ``PARTS``; only the part that its
    bound falls into is ranked, and there rows of one draw are counted first, so
    no task ranks a whole class or a crowd of equal rows.
    """
    narrow = cut(drawn.select("__source", "__size", "__class", "__draw"))
    wanted = cut(targets(narrow.select(F.col("__source").alias("source"), F.col("__size").alias("size"))))
    part = F.least(F.floor(F.col("__draw") * PARTS), F.lit(PARTS - 1))
    parts = cut(narrow.groupBy("__source", "__class", part.alias("part")).agg(F.count(F.lit(1)).alias("n")))
    classes = parts.groupBy("__source", "__class").agg(F.sum("n").alias("n"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rates = wanted.withColumnRenamed("source", "__source2").withColumns({"base": F.floor(rate), "fraction": rate - F.floor(rate), "offset": _uniform(F.lit(seed), F.lit("source"), F.coalesce(F.col("__source2").cast("string"), F.lit("")))})
    up_to = W.partitionBy("__source").orderBy("__class")
    counted = classes.join(rates, F.col("__source").eqNullSafe(F.col("__source2"))).drop("__source2").withColumn("upto", F.sum("n").over(up_to))
    more = F.floor(F.col("offset") + F.col("fraction") * F.col("upto")) - F.floor(F.col("offset") + F.col("fraction") * (F.col("upto") - F.col("n")))
    counted = cut(counted.withColumn("more", more).select("__source", "__class", "source_size", "target", "base", "more"))
    small = counted.count() <= max_small

    within = W.partitionBy("__source", "__class").orderBy("part")
    reached = parts.withColumn("upto", F.sum("n").over(within)).join(counted.select(F.col("__source").alias("s"), F.col("__class").alias("c"), "more"), F.col("__source").eqNullSafe(F.col("s")) & (F.col("__class") == F.col("c"))).drop("s", "c")
    last = reached.where("more > upto - n and more <= upto").select("__source", "__class", "part", (F.col("more") - F.col("upto") + F.col("n")).alias("nth"))
    inside = _attach(narrow.withColumn("part", part), last, ["__source", "__class", "part"], small)
    draws = inside.groupBy("__source", "__class", "nth", "__draw").agg(F.count(F.lit(1)).alias("same"))
    reached = draws.withColumn("upto", F.sum("same").over(W.partitionBy("__source", "__class").orderBy("__draw"))).where("nth > upto - same and nth <= upto")
    bounds = reached.select(F.col("__source").alias("s"), F.col("__class").alias("c"), F.col("__draw").alias("bound"), ((F.col("nth") - F.col("upto") + F.col("same")) / F.col("same")).alias("share"))
    plan = counted.join(bounds, F.col("__source").eqNullSafe(F.col("s")) & (F.col("__class") == F.col("c")), "left")
    return cut(plan.select("__source", "__class", "source_size", "target", "base", "bound", "share")), small


def _place() -> Column:
    """A number from 0 to 1 by a row's place in its task: multiples of the golden ratio, of which any run is spread evenly."""
    return F.pmod(F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) * 0.6180339887498949, F.lit(1.0))


def _copies() -> Column:
    """floor(rate), and one more for draws before the bound; of the rows at it their share, by their places."""
    at_bound = (F.col("__draw") == F.col("bound")) & ((F.col("share") >= 1) | (F.col("__place") < F.col("share")))
    return F.col("base") + F.coalesce(((F.col("__draw") < F.col("bound")) | at_bound).cast("long"), F.lit(0))


def mixture(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "mix", max_small: int = 50_000) -> DataFrame:
    """One row per document: id, source, size, source_size, target, copies, taken.

    The repetition rate of a source is its target divided by its size. Each of
    its documents is taken floor(rate) times, and once more with a probability
    equal to the fraction, by a draw from a hash of ``seed`` and its id (its text,
    if it has none). Draws of one source are not independent: see ``_plan``.
    Rows that share a draw are taken together, but for those at the bound, of
    which as many as are wanted are taken by their places in the input.

    Size is the number of words; null and empty texts have size 0 and are drawn
    like others, long ones count whole. Null is a source of its own. A source of size 0 has target 0 and copies 0.
    Other columns of ``docs`` are not used, whatever their names; an empty table
    gives an empty table. Reruns agree.
    """
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(source_col).alias("source"))
    drawn = _with_draws(own, "id", "text", "source", seed)
    plan, small = _plan(drawn, seed, max_small)
    out = _attach(drawn.drop("text").withColumn("__place", _place()), plan, ["__source", "__class"], small).withColumn("copies", _copies())
    return out.select(F.col("id").alias(id_col), F.col("source").alias(source_col), F.col("__size").alias("size"), "source_size", "target", "copies", (F.col("copies") * F.col("__size")).alias("taken"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "mix", max_small: int = 50_000) -> DataFrame:
    """The documents of the mixture, in their own columns, each as often as ``mixture`` takes it.

    A row's copies follow from the row and its source's plan, so whole texts are
    not shuffled (while the plan is small), and rows that share an id or have
    none are taken each for itself. Null and empty texts, long texts, ties, columns
    of any name and an empty table are treated as ``mixture`` says.
    """
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(source_col).alias("source"))
    drawn = _with_draws(whole, "id", "text", "source", seed)
    plan, small = _plan(drawn, seed, max_small)
    taken = _attach(drawn.select("__row", "__source", "__class", "__draw", _place().alias("__place")), plan, ["__source", "__class"], small)
    times = F.array_repeat(F.lit(0), _copies().cast("int"))
    return taken.select("__row", F.explode(times)).select("__row.*")
