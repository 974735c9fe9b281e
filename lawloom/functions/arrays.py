"""Array functions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def distinct_by(items: Column, fields: Sequence[str]) -> Column:
    """The items of an array of structs, first occurrence by the fields, in order; null items are dropped, null fields are equal."""
    kept = F.filter(items, lambda x: x.isNotNull())
    keys = F.transform(kept, lambda x: F.struct(*[x[f] for f in fields]))
    return F.filter(kept, lambda x, i: F.array_position(keys, F.struct(*[x[f] for f in fields])) == i + 1)


def middle_out(items: Column, k: int) -> Column:
    """The first k items with the best at both ends: ranks of the parity of k-1 ascending, then the others descending."""
    first = F.slice(items, 1, k)
    near = F.filter(first, lambda x, i: (F.lit(k - 1) - i) % 2 == 0)
    far = F.filter(first, lambda x, i: (F.lit(k - 1) - i) % 2 == 1)
    return F.concat(near, F.reverse(far))
