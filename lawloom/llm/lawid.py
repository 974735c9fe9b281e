"""One form for all spellings of a law's number."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Letters of other scripts that look like Latin ones, after case folding and compatibility composition.
_LOOKALIKE_FROM = "авекмнорстухіјѕԁԛԝαβεηικμνορτυχоɖðᵭ"
_LOOKALIKE_TO = "abekmhopctyxijsdqwabenikmvoptuxođđđ"
# Dashes and slashes that look like - and /.
_DASHES = "‐‑‒–—―−﹘﹣－⁃⸺⸻ー"
_SLASHES = "⁄∕⧸／⟋"
# What stands for no law, in the form that canonical_law gives.
PLACEHOLDERS = frozenset({"", "-", "--", "---", "none", "null", "nan", "n/a", "na", "nil", "?", ".", "...", "…", "_", "không", "khôngcó", "khôngrõ", "chưarõ", "tbd", "unknown", "undefined", "0"})
_TABLE = str.maketrans(_LOOKALIKE_FROM + _DASHES + _SLASHES, _LOOKALIKE_TO + "-" * len(_DASHES) + "/" * len(_SLASHES))


def canonical_law(law: str | None) -> str | None:
    """The form that spellings of a law share, None for nulls, blanks and placeholders.

    Case, white space, invisible characters, compatibility forms, composed or decomposed accents, dashes and look-alike
    letters don't tell laws apart.
    """
    if law is None:
        return None
    folded = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", law).casefold())
    kept = "".join(c for c in folded if not c.isspace() and unicodedata.category(c) not in ("Cf", "Cc", "Zs", "Zl", "Zp"))
    form = kept.translate(_TABLE)
    return None if form in PLACEHOLDERS or not any(c.isalnum() for c in form) else form


@F.pandas_udf(T.StringType())
def canonical_law_udf(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    seen: dict[str | None, str | None] = {}
    for laws in batches:
        if len(seen) > 200_000:
            seen.clear()
        yield pd.Series([seen[x] if x in seen else seen.setdefault(x, canonical_law(x)) for x in laws], dtype=object)
