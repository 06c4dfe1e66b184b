"""Column helpers for text."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A token: a run of ASCII word characters, or one unified ideograph.
TOKEN = r"[A-Za-z0-9_]+|[\x{4e00}-\x{9fff}]"

#: Line ends of plain text, CR LF as one.
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"


def strip(text: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def padded(number: Column, width: int = 6) -> Column:
    """A number with zeros before it up to ``width`` digits; longer ones stay whole, which ``lpad`` alone would cut."""
    digits = number.cast("string")
    return F.lpad(digits, F.greatest(F.lit(width), F.length(digits)), "0")


def tokens(text: Column) -> Column:
    """The tokens of a text in lower case, all else dropped; null has none."""
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0)), F.lower)


def split_lines(text: Column) -> Column:
    """Lines without their ends; a line end at the end of the text opens no line."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(text, f"(?:{LINE_END})$", ""), LINE_END))


def contains_any(text: Column, words: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words], F.lit(False))


def mentions(text: Column, names: Sequence[str], aliases: dict[str, str] | None = None) -> Column:
    """The names found in a text, in the order of ``names``; then those of found aliases that are not yet there.

    Every name costs a scan of the text; ``dictionary.find_names`` has the same
    result for thousands of them.
    """
    found = F.filter(F.array(*[F.lit(n) for n in names]).cast("array<string>"), lambda n: F.contains(text, n))
    other = [F.when(F.contains(text, F.lit(a)), F.lit(n)) for a, n in (aliases or {}).items()]
    return F.array_union(found, F.array_compact(F.array(*other).cast("array<string>")))


def piped(names: Column) -> Column:
    """A list of names with a pipe before, between and after them; empty for none."""
    return F.when(F.size(names) > 0, F.concat(F.lit("|"), F.array_join(names, "|"), F.lit("|"))).otherwise("")


def join_present(items: Column, by: str = "；") -> Column:
    """The items that are neither null nor empty, joined; null counts as no items."""
    return F.coalesce(F.array_join(F.filter(items, lambda x: x.isNotNull() & (x != "")), by), F.lit(""))


