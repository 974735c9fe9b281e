"""Cutting oversized texts into overlapping pieces at natural boundaries, by dynamic programming over boundary positions."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lawloom.plans import spread_out

# What a cut costs by the boundary it falls on, best first; a position has the cost of the best boundary that ends there.
_BOUNDARIES = (
    (10.0, regex.compile(r"\s+")),
    (6.0, regex.compile(r",\s+")),
    (4.0, regex.compile(r"[;:]\s+")),
    (2.0, regex.compile(r"""[.!?…]+["'”’»)\]]*\s+""")),
    (1.0, regex.compile(r"[ \t]*\r?\n\s*")),
    (0.0, regex.compile(r"[ \t]*(?:\r?\n[ \t]*){2,}\s*")),
)
_INSIDE_WORD, _INSIDE_LETTER = 40.0, 1000.0
_JOINED = regex.compile("[\\p{M}\u200d\ufe0e\ufe0f]|\\r\\n")  # what continues the letter before it
_BALANCE = 30.0


@dataclass(frozen=True)
class Limits:
    """size: the most characters (code points) of a piece; low, high: the fewest and most that a piece repeats of the one before."""

    size: int = 1200
    low: int = 100
    high: int = 150

    def __post_init__(self) -> None:
        if not 0 <= self.low <= self.high or self.size < 3 * self.high + 3:
            raise ValueError("pieces must be more than three times as long as what they repeat")


def cut_costs(text: str) -> np.ndarray:
    """The cost of a cut before each position from 0 to the text's length."""
    costs = np.full(len(text) + 1, _INSIDE_WORD)
    for m in _JOINED.finditer(text):
        costs[m.start() + (m.group() == "\r\n")] = _INSIDE_LETTER
        if m.group() == "\u200d":
            costs[m.end()] = _INSIDE_LETTER
    for cost, boundary in _BOUNDARIES:
        for m in boundary.finditer(text):
            costs[m.end()] = min(cost, costs[m.end()])
    costs[0] = costs[len(text)] = 0.0
    return costs


def cut(text: str, limits: Limits = Limits()) -> list[tuple[int, int]]:
    """Begin and end of each piece, in order; one piece if the text isn't over the limit.

    Every piece has at most limits.size characters, the first begins at 0, the last ends at the end, and each next one
    begins limits.low to limits.high characters before its predecessor's end. Among all such sequences whose ends lie on
    boundaries (or, where there's none for limits.high characters, anywhere inside the word), the one with the smallest sum
    is taken: the cost of each end and each beginning, and the squared deviation of each size from the even share. Time is
    linear in the text, as an end looks back over one piece's size.
    """
    n = len(text)
    if n <= limits.size:
        return [(0, n)]
    costs = cut_costs(text)
    begin = np.zeros(n + 1, np.int64)  # where the next piece begins if one ends here: the best of the window, the longest overlap of equals
    if limits.high:
        windows = np.lib.stride_tricks.sliding_window_view(costs, limits.high - limits.low + 1)
        ends = np.arange(limits.high, n + 1)
        begin[ends] = ends - limits.high + np.argmin(windows[ends - limits.high], axis=1)
    else:
        begin = np.arange(n + 1)
    offered = costs < _INSIDE_WORD
    at = np.flatnonzero(offered)
    for a, b in zip(at[:-1][np.diff(at) > limits.high], at[1:][np.diff(at) > limits.high], strict=True):
        offered[a:b] = True  # no boundary for long: every position inside the word
    offered[1 : limits.high + 1] = False
    at = np.flatnonzero(offered)
    count = int(np.ceil((n - limits.high) / (limits.size - limits.high)))
    even = (n + (count - 1) * (limits.low + limits.high) / 2) / count
    begin[0] = 0
    starts, price = begin[at], costs[at] + costs[begin[at]]
    # Beginnings never go back, so the ends that may come before one lie side by side; the squared deviation of a size
    # from the even share, w (at_j - start_i - even)^2, is taken apart into a part of i, a part of j and a product.
    first = np.searchsorted(starts, at - limits.size)
    last = np.minimum(np.searchsorted(starts, at - limits.high), np.arange(len(at)))
    w = _BALANCE / even**2
    goal, slope = at - even, -2 * w * starts
    own = w * starts.astype(np.float64) ** 2
    reached = np.full(len(at), np.inf)  # the best sum of an end, and its own part as a predecessor
    reached[0], came = own[0], [-1] * len(at)
    bounds = zip(first[1:].tolist(), last[1:].tolist(), goal[1:].tolist(), (w * goal[1:] ** 2 + price[1:] + own[1:]).tolist(), strict=True)
    for j, (low, high, aim, fixed) in enumerate(bounds, 1):
        if low < high:
            total = slope[low:high] * aim
            total += reached[low:high]
            k = int(total.argmin())
            came[j], reached[j] = low + k, total[k] + fixed
    if not np.isfinite(reached[-1]):
        raise ValueError("no pieces within the limits")
    out, j = [], len(at) - 1
    while j > 0:
        i = int(came[j])
        out.append((int(starts[i]), int(at[j])))
        j = i
    return out[::-1]


def split_oversized(items: DataFrame, keys: Sequence[str], text: str, limits: Limits = Limits()) -> DataFrame:
    """(keys..., piece_no, piece_start, piece) of every text of more than limits.size characters; piece_no from 0.

    Null, empty and short texts need no cut and give no rows. Every row is cut on its own, so repeats give repeats. Lengths are compared in the scan;
    only oversized texts reach the workers, a few at a time, and only with their keys: other columns aren't read. Keys
    may have any names but the three of the result.
    """
    narrow = items.select(*[F.col(f"`{k}`") for k in keys], F.col(f"`{text}`").alias("__text")).where(F.length("__text") > limits.size)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            pieces = [cut(t, limits) for t in batch["__text"]]
            row = np.repeat(np.arange(len(batch)), [len(p) for p in pieces])
            out = batch[list(keys)].iloc[row].reset_index(drop=True)
            out["piece_no"] = np.concatenate([np.arange(len(p)) for p in pieces]) if pieces else []
            out["piece_start"] = [a for p in pieces for a, _ in p]
            out["piece"] = [t[a:b] for t, p in zip(batch["__text"], pieces, strict=True) for a, b in p]
            yield out

    fields = [narrow.schema[k] for k in keys]
    added = [T.StructField("piece_no", T.IntegerType()), T.StructField("piece_start", T.LongType()), T.StructField("piece", T.StringType())]
    return spread_out(narrow).mapInPandas(run, T.StructType([*fields, *added]))
