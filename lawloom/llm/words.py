"""The words of a text in the form in which texts are compared."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TAG = regex.compile(r"<!--.*?-->|</?[A-Za-z][^<>]*>|<[!?][^<>]*>", regex.DOTALL)
_INVISIBLE = regex.compile(r"\p{Cf}+")
_MARKS = regex.compile(r"\p{M}+")
_WORD = re.compile(r"[^\W_]+")


def canonical_words(text: str | None) -> list[str]:
    """The longest runs of letters and digits, without markup tags, invisible characters, case and diacritics; null has none."""
    if not text:
        return []
    if "<" in text:
        text = _TAG.sub(" ", text)
    if not text.isascii():
        text = unicodedata.normalize("NFKD", unicodedata.normalize("NFKD", _INVISIBLE.sub("", text)).casefold())
        text = _MARKS.sub("", text).replace("đ", "d")
        return _WORD.findall(text)
    return _WORD.findall(text.casefold())


@F.pandas_udf(T.StringType())
def joined_words(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The canonical words of a text with one space between them; null where there's none."""
    for texts in batches:
        yield pd.Series([" ".join(canonical_words(t)) or None for t in texts], dtype=object)
