"""Replacement by a table of thousands of entries: the leftmost, then longest match wins, in one pass over a text."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import fixed

#: The entries a session without a table of its own has: the 38 fixed pairs of characters.
CHARACTERS = dict(zip(fixed.SIMPLIFIED, fixed.TRADITIONAL, strict=True))


def mapping_of(table: DataFrame, key: str, value: str, most: int = 1_000_000) -> dict[str, str]:
    """A mapping table as a dictionary, refused above ``most`` entries: it is sent to every task.

    Of several values for a key the smallest counts; empty and null keys and null values are left out.
    """
    rows = table.filter((F.length(key) > 0) & F.col(value).isNotNull()).groupBy(F.col(key).alias("k")).agg(F.min(value).alias("v"))
    found = rows.limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"more than {most} entries")
    return {r.k: r.v for r in found}


def _rewriter(mapping: dict[str, str]) -> Callable[[str], str]:
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for key, value in mapping.items():
        automaton.add_word(key, (len(key), value))
    automaton.make_automaton()

    def rewrite(text: str) -> str:
        out, at = [], 0
        for end, (length, value) in automaton.iter_long(text):
            out += [text[at : end + 1 - length], value]
            at = end + 1
        return text if not at else "".join([*out, text[at:]])

    return rewrite


def replace_longest(text: Column, mapping: dict[str, str] | None = None) -> Column:
    """The text with every key of the mapping replaced; where keys overlap the one that begins first wins, then the longest.

    What has been put in is not read again.  A null text stays null; an empty mapping changes nothing.
    """
    entries = CHARACTERS if mapping is None else {k: v for k, v in mapping.items() if k}
    if not entries:
        return text
    if all(len(k) == len(v) == 1 for k, v in entries.items()):  # single characters need no automaton
        return F.translate(text, "".join(entries), "".join(entries.values()))
    kept: list[Callable[[str], str]] = []

    @F.pandas_udf("string")
    def rewrite(texts: pd.Series) -> pd.Series:
        if not kept:
            kept.append(_rewriter(entries))
        return texts.map(kept[0], na_action="ignore")

    return rewrite(text)


def spellings(text: Column, *mappings: dict[str, str]) -> Column:
    """The distinct spellings of a query: as it is, and as each mapping and its inverse write it (of equal values the first key counts)."""
    every = [m for mapping in mappings or (CHARACTERS,) for m in (mapping, {v: k for k, v in reversed(mapping.items())})]
    return F.array_distinct(F.array(text, *[replace_longest(text, m) for m in every]))
