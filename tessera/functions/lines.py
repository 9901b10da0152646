"""Line breaking: the cheapest breaks of a text into few lines, by dynamic programming over boundary costs."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters and digits of scripts that put spaces between words; a run of them is one word
_WORD = r"[^\W_぀-ヿ㐀-鿿]+"
_KATAKANA = r"[゠-ヿ]+"


@dataclass(frozen=True)
class BreakRules:
    """What breaks cost. Runs of `unbreakable` (regular expressions) and `phrases` aren't cut without `cut`; no line begins with `no_start`.

    A line of fewer than `least` characters costs `short` for each it lacks, as far as the text has that many for each line. A break behind one of `good_end` gains
    `gain`. Squared differences from an even width cost `balance` each, in units of a line's share.
    """

    no_start: str = "、。，．,.!！?？」』）)・…:：;；ぁぃぅぇぉっゃゅょァィゥェォッャュョー"
    good_end: str = " 、。，．,.!！?？"
    unbreakable: tuple[str, ...] = (_WORD, _KATAKANA)
    phrases: tuple[str, ...] = ()
    cut: int = 9_000_000
    least: int = 4
    short: int = 8_000
    gain: int = 8_000
    balance: int = 10


def widths(text: str) -> np.ndarray:
    """1 for each character, 2 for those of East Asian full width."""
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    wide = np.zeros(len(codes), bool)
    for low, high in ((0x1100, 0x115F), (0x2E80, 0xA4CF), (0xAC00, 0xD7A3), (0xF900, 0xFAFF), (0xFE30, 0xFE6F), (0xFF00, 0xFF60), (0xFFE0, 0xFFE6), (0x1F300, 0x1FAFF), (0x20000, 0x3FFFD)):
        wide |= (codes >= low) & (codes <= high)
    return 1 + wide.astype(np.int64)


def unbreakable_spans(text: str, rules: BreakRules) -> list[tuple[int, int]]:
    """(begin, end) of what isn't to be cut: runs of two characters or more, phrases wherever they stand; overlapping ones as one."""
    found = [m.span() for p in rules.unbreakable for m in re.finditer(p, text) if m.end() - m.start() > 1]
    found += [(m.start(), m.start() + len(p)) for p in rules.phrases for m in re.finditer(f"(?={re.escape(p)})", text)]
    merged: list[tuple[int, int]] = []
    for begin, end in sorted(found):
        if merged and begin < merged[-1][1]:
            merged[-1] = (merged[-1][0], max(merged[-1][1], end))
        else:
            merged.append((begin, end))
    return merged


def _boundaries(text: str, rules: BreakRules) -> np.ndarray:
    """Cost of a break ahead of each character; -1 where there can't be one."""
    cost = np.zeros(len(text) + 1, np.int64)
    for begin, end in unbreakable_spans(text, rules):
        cost[begin + 1 : end] += rules.cut
    for i in range(1, len(text)):
        if text[i - 1] in rules.good_end:
            cost[i] -= rules.gain
    # costs of a few good ends are below 0; the shift by `gain` at every break doesn't change which breaks are cheapest
    cost += rules.gain
    for i in range(1, len(text)):
        if text[i] in rules.no_start:
            cost[i] = -1
    return cost


def cheapest_breaks(text: str, width: int, lines: int, rules: BreakRules) -> list[int] | None:
    """Where lines 2 to `lines` begin; None if no breaks keep all lines within the width. Ties: the earliest last break, then the one before it."""
    n, own = len(text), widths(text)
    if n < lines:
        return None
    total = int(own.sum())
    blank = np.array([c.isspace() for c in text])
    upto = np.concatenate(([0], np.cumsum(own)))
    # a line from i to j is measured from its first to its last character that isn't white space
    first = np.append(np.where(blank, n, np.arange(n)), n)
    first = np.minimum.accumulate(first[::-1])[::-1]
    last = np.maximum.accumulate(np.concatenate(([0], np.where(blank, 0, np.arange(1, n + 1)))))
    begin, end = np.minimum(first[:, None], n), last[None, :]
    wide, chars = upto[end] - upto[begin], end - begin
    there = (np.arange(n + 1)[:, None] < np.arange(n + 1)[None, :]) & (chars > 0) & (wide <= width)
    lack = np.maximum(0, rules.least - chars) * rules.short if n >= rules.least * lines else 0
    far = np.int64(1) << 60
    line = np.where(there, rules.balance * (wide * lines - total) ** 2 + lack, far)
    boundary = _boundaries(text, rules)
    best, back = np.full(n + 1, far), []
    best[0] = 0
    for k in range(lines):
        whole = best[:, None] + line
        back.append(np.argmin(whole, axis=0))
        best = np.minimum(whole.min(axis=0), far)
        if k < lines - 1:
            best = np.where(boundary < 0, far, np.minimum(best + boundary, far))
            best[[0, n]] = far
    if best[n] >= far:
        return None
    breaks, at = [], n
    for k in range(lines - 1, 0, -1):
        at = int(back[k][at])
        breaks.append(at)
    return breaks[::-1]


def broken(text: str, width: int, most: int, rules: BreakRules) -> list[str] | None:
    """The text on as few lines as it fits, at most `most`; None if it doesn't."""
    text = text.strip()
    size = int(widths(text).sum()) if text else 0
    if size <= width:
        return [text]
    for lines in range(2, most + 1):
        if size - sum(c.isspace() for c in text) > lines * width:
            continue
        breaks = cheapest_breaks(text, width, lines, rules)
        if breaks is not None:
            return [text[a:b].strip() for a, b in zip([0, *breaks], [*breaks, len(text)], strict=True)]
    return None


def break_lines(x: Column, width: int, *, most: int = 3, rules: BreakRules | None = None) -> Column:
    """Array of lines: the fewest, at most `most`, and of those the cheapest breaks by `rules`; null for null and for what doesn't fit.

    Width counts 1 a character, 2 for full-width ones; white space at the ends of lines goes. A text too wide for `most` lines is
    refused before it is looked at, so that work and memory a row stay within (most * width) squared and long texts cost nothing.
    """
    used = rules or BreakRules()

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([None if t is None else broken(t, width, most, used) for t in texts], dtype="object")

    return F.pandas_udf(run, "array<string>")(x)


def script_spans(x: Column, rules: BreakRules | None = None) -> Column:
    """Array of (s, e): unbreakable spans, from 0, e exclusive; null for null."""
    used = rules or BreakRules()

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([None if t is None else [{"s": a, "e": b} for a, b in unbreakable_spans(t, used)] for t in texts], dtype="object")

    return F.pandas_udf(run, "array<struct<s: int, e: int>>")(x)
