"""Fuzzy containment: the one string function that has no built-in form."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _common(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bit-parallel rows."""
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    row, full = (1 << len(a)) - 1, (1 << len(a)) - 1
    for c in b:
        hit = row & masks.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def partial_ratio(a: str, b: str) -> float:
    """Likeness, 0 to 100, of the shorter string to the window of the longer that is most like it."""
    short, long = sorted((a, b), key=len)
    if not short:
        return 100.0 if not long else 0.0
    if short in long:
        return 100.0
    n, best = len(short), 0.0
    letters = set(short)
    for i in range(1 - n, len(long)):
        window = long[max(0, i) : i + n]
        if window[-1] in letters or window[0] in letters:  # windows that end and begin in foreign letters are never best
            best = max(best, 200.0 * _common(short, window) / (n + len(window)))
    return best


def pieces(alias: str, least: float) -> list[str]:
    """Parts of an alias, one of which any text of its length or more holds unchanged if it is `least` alike to it.

    Likeness of `least` leaves room for so many insertions and deletions, and each breaks one part at most.
    """
    edits = int(2 * len(alias) * (1 - least / 100) + 1e-9)
    cuts = [round(i * len(alias) / (edits + 1)) for i in range(edits + 2)]
    return [alias[i:j] for i, j in zip(cuts, cuts[1:], strict=False)]


def near_aliases(text: str, aliases: list[tuple[str, list[str]]], least: float) -> list[str]:
    """The aliases, each with its pieces, that nearly occur in a text but do not occur."""
    some = [a for a, parts in aliases if len(text) < len(a) or any(p in text for p in parts)]
    return [a for a in some if a not in text and partial_ratio(a, text) >= least]


def fuzzy_aliases(texts: Column, aliases: list[str], least: float = 92.0) -> Column:
    """Which aliases (eight characters at least) nearly occur in each normalized text; exact ones are left to contains."""
    of = _finder(aliases, least)

    @F.pandas_udf("array<string>")
    def near(batch: pd.Series) -> pd.Series:
        memo: dict[str, list[str]] = {}
        return batch.map(lambda text: of(text, memo))

    return near(texts)


def fuzzy_aliases_of_each(texts: Column, aliases: list[str], least: float = 92.0) -> Column:
    """fuzzy_aliases of each text of an array."""
    of = _finder(aliases, least)

    @F.pandas_udf("array<array<string>>")
    def near(batch: pd.Series) -> pd.Series:
        memo: dict[str, list[str]] = {}
        return batch.map(lambda own: None if own is None else [of(text, memo) for text in own])

    return near(texts)


def _finder(aliases: list[str], least: float) -> Callable[[str | None, dict], list[str]]:
    wanted = [(a, pieces(a, least)) for a in aliases if len(a) >= 8]

    def of(text: str | None, memo: dict[str, list[str]]) -> list[str]:
        if not text:
            return []
        if text not in memo:
            memo[text] = near_aliases(text, wanted, least)
        return memo[text]

    return of
