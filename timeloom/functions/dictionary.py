"""Names of a large dictionary found in texts."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import ahocorasick
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def find_names(text: Column, names: Sequence[str], aliases: dict[str, str] | None = None) -> Column:
    """What ``mentions`` says, for thousands of names: one pass over a text whatever their number.

    Each task builds one automaton of names and aliases, in memory that follows
    their total length. A null text has no names; an empty name is in every
    other text.
    """
    names, aliases = list(dict.fromkeys(names)), dict(aliases or {})

    @F.pandas_udf("array<string>")
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        words = [w for w in {*names, *aliases} if w]
        automaton = ahocorasick.Automaton()
        for w in words:
            automaton.add_word(w, w)
        if words:
            automaton.make_automaton()
        place = {n: i for i, n in enumerate(names)}
        rank = {a: i for i, a in enumerate(aliases)}

        def found(t: str | None) -> list[str]:
            if t is None:
                return []
            seen = {w for _, w in automaton.iter(t)} if words else set()
            seen.add("")
            direct = sorted((w for w in seen if w in place), key=place.__getitem__)
            other = (aliases[a] for a in sorted((w for w in seen if w in rank), key=rank.__getitem__))
            return list(dict.fromkeys([*direct, *other]))

        for texts in batches:
            yield texts.map(found)

    return find(text)
