"""Per-document text statistics, and rules with fixed thresholds that tell prose from lists, tables and junk."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lawloom.plans import spread_out

# Frequent function words of Vietnamese, English and French, without case and diacritics.
COMMON_WORDS = (
    "va cua la cac co khong duoc trong cho voi nguoi theo tai mot khi nay da de ve tu do tren phai bi thi nhung den neu ra nhu sau hay vi cung se lai chi con dong chua ngay truoc "
    "the of and to in is that for on as with be by or an shall must may from not once each any near "
    "le les des du une et un en dans pour que qui sur par avec est ne sont aux apres avant doit peut"
).split()

# Rules published for web corpora, with their thresholds (lowest and highest value that passes). They tell
# documents fit for training from others, not prose from lists, tables and junk: here, short sound articles fail the
# word count, and many tables pass them all. So they are recorded for every document, and the kind is decided below.
PUBLISHED = {
    "word_count": ("n_words", 50, 100_000),
    "mean_word_length": ("mean_word_length", 3, 10),
    "symbol_to_word": ("hash_ellipsis_share", None, 0.1),
    "bullet_lines": ("bullet_line_share", None, 0.9),
    "ellipsis_lines": ("ellipsis_line_share", None, 0.3),
    "alphabetic_words": ("alphabetic_word_share", 0.8, None),
    "stop_words": ("stop_words", 2, None),
}
# Rules of the same statistics that decide the kind. Their thresholds are our own, set on the texts of sf0.1 for the reasons
# given; each holds or fails alone, and the first that fails, in the order of classified(), decides.
THRESHOLDS = {
    "replacement_share": 0.01,
    "mojibake_share": 0.1,
    "escape_share": 0.1,
    "symbol_share": 0.4,
    "single_letter_share": 0.4,
    "mean_word_length": 14.0,
    "coded_word_share": 0.4,
    "distinct_word_share": 0.08,
    "common_share": 0.03,
    "cell_line_share": 0.55,
    "short_line_share": 0.6,
    "wrapped_share": 0.6,
    "some_cells_share": 0.85,
    "cell_char_share": 0.5,
    "entry_common_share": 0.12,
    "full_line_words": 6.3,
}
WINDOW = 200  # words over which repetition is measured
LETTER_RUN = r"[\p{L}\p{M}\p{N}]+"


def _folds() -> tuple[str, str]:
    """Letters with diacritics and their base letters, then combining marks without any, which translate() deletes."""
    pairs = [(chr(c), b) for c in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)] if (b := unicodedata.normalize("NFD", chr(c).lower())[0]) != chr(c).lower() and b.isascii()]
    pairs += [("đ", "d"), ("Đ", "d"), ("ð", "d"), ("Ð", "d")]
    marks = "".join(chr(c) for c in range(0x300, 0x370))
    return "".join(a for a, _ in pairs) + marks, "".join(b for _, b in pairs)


def folded(text: Column) -> Column:
    """text in lower case without diacritics, composed or decomposed."""
    return F.translate(F.lower(text), *_folds())


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def _chars(text: Column, pattern: str) -> Column:
    """Characters in runs of the pattern; unlike a count of matches it makes no array of them."""
    return F.length(text) - F.length(F.regexp_replace(text, f"(?:{pattern})+", ""))


def _share(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def _where_share(items: Column, test) -> Column:
    return _share(F.size(F.filter(items, test)), F.size(items))


def _distinct_share(words: Column) -> Column:
    """The mean share of distinct words over windows of WINDOW words, the last of which ends with the text; of all words if they're fewer.

    The share of a whole text falls as it grows, whatever it says.
    """
    last = F.greatest(F.size(words) - WINDOW, F.lit(0))
    starts = F.array_distinct(F.array_append(F.sequence(F.lit(0), last, F.lit(WINDOW)), last))
    shares = F.transform(starts, lambda s: _share(F.size(F.array_distinct(F.slice(words, s + 1, WINDOW))), F.least(F.size(words), F.lit(WINDOW))))
    return F.when(F.size(words) > WINDOW, F.aggregate(shares, F.lit(0.0), lambda a, x: a + x) / F.size(shares)).otherwise(_share(F.size(F.array_distinct(words)), F.size(words)))


def _without(text: Column, characters: str) -> Column:
    for character in characters:
        text = F.replace(text, F.lit(character), F.lit(""))
    return text


def _has_any(text: Column, parts: list[str]) -> Column:
    found = text.contains(parts[0])
    for part in parts[1:]:
        found = found | text.contains(part)
    return found


def _where_any(text: Column, leads: list[str], count: Column) -> Column:
    """count where the text has one of the leads, without which it would be 0."""
    return F.when(_has_any(text, leads), count).otherwise(0)


def _computed(rows: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """rows with the columns, each computed once: an explode of one row keeps the optimiser from copying expressions into every use."""
    kept = [F.col(c) for c in rows.columns if c not in columns]
    return rows.select(F.inline(F.array(F.struct(*kept, *[c.alias(n) for n, c in columns.items()]))))


def text_statistics(documents: DataFrame, key: str = "doc_id", text: str = "text", published: bool = False) -> DataFrame:
    """One row per row of documents: key, counts and shares of its whole text; published: with the statistics of PUBLISHED too.

    Null, empty and blank texts have counts and shares of 0. Characters are code points; letters count their combining
    marks. All statistics are built-in expressions over one scan of two columns, without a shuffle unless the
    scan has fewer partitions than cores; a text is never cut.
    """
    c = F.col
    rows = documents.select(c(f"`{key}`").alias("k"), F.coalesce(c(f"`{text}`"), F.lit("")).alias("t"))
    rows = spread_out(rows)
    rows = _computed(rows, {"lines": F.filter(F.split("t", r"[\n\r\u0085\u2028\u2029]"), lambda x: x.rlike(r"(?U)\S")), "plain": folded(c("t")), "visible": F.length(_without(c("t"), " \n\t\r\u00a0\u3000\u200b\ufeff"))})
    cells = F.when(_has_any(c("t"), _SEPARATORS), F.transform("lines", _cells)).otherwise(F.array_repeat(F.lit(1), F.size("lines")))
    rows = _computed(rows, {"bare": F.regexp_extract_all("plain", F.lit(LETTER_RUN), 0), "cells": cells, "fill": F.transform("lines", lambda x: F.size(F.split(F.btrim(x, F.lit(" \t\u00a0")), r"(?U)\s+")))})
    usual = F.element_at(F.sort_array("cells"), (F.floor(F.size("cells") * 0.6) + 1).cast("int"))
    widest = F.array_max(F.transform("lines", lambda x: F.length(F.rtrim(x))))
    rows = _computed(rows, {"usual": F.when(F.size("cells") > 0, usual), "most": F.array_max("fill"), "words": F.aggregate("fill", F.lit(0), lambda a, n: a + n), "widest": widest, "digits": _chars(c("plain"), r"\p{Nd}")})
    statistics = {
        "n_chars": F.length("t"),
        "n_words": c("words"),
        "n_lines": F.size("lines"),
        "mean_word_length": _share(c("visible"), c("words")),
        "symbol_share": _share(_chars(c("t"), r"[\p{S}\p{P}&&[^.,;:?!'\"()“”‘’/-]]"), c("visible")),
        "letter_share": _share(F.length(F.array_join("bare", "")) - c("digits"), c("visible")),
        "digit_share": _share(c("digits"), c("visible")),
        "ended_line_share": _where_share(c("lines"), lambda x: F.substring(F.rtrim(x), -8, 8).rlike(r"""(?U)[.!?…:;。！？]["'”’»)\]*_\s]*$""")),
        "bullet_line_share": _where_share(c("lines"), lambda x: x.rlike(_BULLET)),
        "short_line_share": _where_share(c("fill"), lambda n: n <= 9),
        "words_per_line": _share(c("words"), F.size("lines")),
        "common_share": _where_share(c("bare"), lambda x: x.isin(COMMON_WORDS)),
        "distinct_word_share": _distinct_share(c("bare")),
        "replacement_share": _share(_where_any(c("t"), ["\ufffd"], _chars(c("t"), "\ufffd")), c("visible")),
        "mojibake_share": _share(_where_any(c("t"), _MOJIBAKE_LEADS, _count(c("t"), _MOJIBAKE)), c("words")),
        "escape_share": _share(_where_any(c("t"), _ESCAPE_LEADS, _count(c("t"), _ESCAPES)), c("words")),
        "single_letter_share": _where_share(c("bare"), lambda x: (F.length(x) == 1) & x.rlike(r"\D")),
        "coded_word_share": _where_share(c("bare"), lambda x: (F.length(x) >= 25) | (((x < "a") | (F.length(x) > 7)) & x.rlike(_CODED))),
        "some_cells_share": _where_share(c("cells"), lambda x: x > 1),
        "cell_line_share": _share(F.size(F.filter("cells", lambda x: (x > 1) & (x == c("usual")))), F.size("cells")),
        "cell_char_share": _share(F.aggregate(F.arrays_zip("lines", "cells"), F.lit(0), lambda a, x: a + F.when(x["cells"] > 1, F.length(x["lines"])).otherwise(0)), F.aggregate("lines", F.lit(0), lambda a, x: a + F.length(x))),
        "wrapped_share": _wrapped(c("lines"), c("widest"), c("fill"), c("most")),
    }
    if published:
        words = F.filter(F.split("t", r"(?U)\s+"), lambda x: x != "")
        statistics |= {
            "hash_ellipsis_share": _share(_count(c("t"), r"#|…|\.\.\."), c("words")),
            "ellipsis_line_share": _where_share(c("lines"), lambda x: F.rtrim(x).rlike(r"(?:…|\.\.\.)$")),
            "alphabetic_word_share": _where_share(words, lambda x: x.rlike(r"\p{L}")),
            "stop_words": F.size(F.array_distinct(F.filter("bare", lambda x: x.isin(COMMON_WORDS)))),
        }
    return _computed(rows, statistics).select(c("k").alias(key), *statistics)


def failures(statistics: DataFrame) -> Column:
    """All rules that a document fails, as an array of (rule, value): those of PUBLISHED, where their statistics are there, then those that may decide its kind."""
    found = []
    if "stop_words" in statistics.columns:
        for rule, (name, low, high) in PUBLISHED.items():
            value = F.col(name).cast("double")
            bad = F.lit(False) if low is None else value < low
            found.append((rule, bad if high is None else bad | (value > high), value))
    found += [(f"{kind}:{rule}", fails, F.col(rule).cast("double") if rule in statistics.columns else F.lit(None).cast("double")) for kind, rule, fails in _rules()]
    listed = F.array(*[F.when(fails, F.struct(F.lit(rule).alias("rule"), value.alias("value"))) for rule, fails, value in found])
    return F.filter(listed, lambda x: x.isNotNull())


_BULLET = r"^\s*(?:[-–—*+•◦▪●○→‣·>]|\[[ xX]?\]|\(?\p{Alnum}{1,3}[.)]|[ivxIVX]+[.)])\s"
_MOJIBAKE = r"á[º»]|Ã[\u0080-¿ƒ‚-›]|Æ[°¡]|Ä[\u0080-¿‘’‘]|Â[ -¿]|â€"
_MOJIBAKE_LEADS = ["áº", "á»", "Ã", "Æ", "Ä", "Â", "â€"]
_ESCAPE_LEADS = ["\\u", "\\x", "%", "=", "&"]
_ESCAPES = r"\\u[0-9a-fA-F]{4}|\\x[0-9a-fA-F]{2}|%[0-9A-F]{2}|=[0-9A-F]{2}|&#x?[0-9a-fA-F]+;|&[a-zA-Z]{2,8};"


_CODED = r"^(?:0\d*|[a-f\d]*[a-f]\d[a-f\d]*|[a-f\d]*\d[a-f][a-f\d]*|[a-z]+\d+[a-z][a-z\d]*)$"
_SEPARATORS = ["|", "│", "┃", "¦", "\t", ";", '","', '";"', "  ", "\u00a0\u00a0", "\u3000"]


def _cells(line: Column) -> Column:
    """Cells of a line by the separator that cuts it into most: bars, tabs, semicolons, quoted commas or wide gaps."""
    inner = F.regexp_replace(line, r"^\s*[|│]|[|│]\s*$", "")
    counts = [_count(inner, r"[|│┃¦]"), _count(line, "\t"), _count(line, r";(?=\S)"), _count(line, '"[,;]"'), _count(F.trim(line), r"(?<=\S)(?: {2,}| {2,}|　+)(?=\S)")]
    return F.greatest(*counts) + 1


def _wrapped(lines: Column, widest: Column, fill: Column, most: Column) -> Column:
    """How much the line ends look like those of wrapped paragraphs, from 0 to 1.

    The larger of two shares: of the ends at which the next word wouldn't have fitted into the widest line (wrapped by
    width), and of the lines that have as many words as the longest (wrapped by number of words).
    """
    ends = F.transform(F.slice(lines, 1, F.greatest(F.size(lines) - 1, F.lit(0))), lambda x, i: F.length(F.rtrim(x)) + 1 + F.length(F.regexp_extract(F.get(lines, i + 1), r"(?U)\S+", 0)) > widest)
    by_width = _share(F.size(F.filter(ends, lambda x: x)), F.size(ends))
    by_words = _share(F.size(F.filter(fill, lambda n: n == most)) - 1, F.size(fill) - 1)
    return F.greatest(by_width, by_words)


def _rules() -> list[tuple[str, str, Column]]:
    """(kind, rule, whether a document fails it), in the order in which they decide."""
    c, t = F.col, THRESHOLDS
    ragged = (c("some_cells_share") >= t["some_cells_share"]) & (c("common_share") < t["entry_common_share"])
    table = (c("n_lines") >= 3) & (c("cell_char_share") >= t["cell_char_share"]) & ((c("cell_line_share") >= t["cell_line_share"]) | ragged)
    full = (c("words_per_line") >= t["full_line_words"]) & (c("bullet_line_share") < 0.3)  # ragged line ends, yet no entries
    wrapped = ((c("wrapped_share") >= t["wrapped_share"]) | full) & (c("ended_line_share") < 0.5) & (c("common_share") >= t["entry_common_share"])
    short = (c("n_lines") >= 3) & (c("short_line_share") >= t["short_line_share"]) & (c("words_per_line") < 9)
    return [
        ("blank", "no_text", c("n_words") == 0),
        ("junk", "replacement_share", c("replacement_share") >= t["replacement_share"]),
        ("junk", "mojibake_share", c("mojibake_share") >= t["mojibake_share"]),
        ("junk", "escape_share", c("escape_share") >= t["escape_share"]),
        ("table", "cell_line_share", table),
        ("junk", "symbol_share", c("symbol_share") >= t["symbol_share"]),
        ("junk", "single_letter_share", (c("single_letter_share") >= t["single_letter_share"]) & (c("n_words") >= 8)),
        ("junk", "mean_word_length", c("mean_word_length") >= t["mean_word_length"]),
        ("junk", "coded_word_share", c("coded_word_share") >= t["coded_word_share"]),
        ("junk", "distinct_word_share", (c("distinct_word_share") <= t["distinct_word_share"]) & (c("n_words") >= 12)),
        ("list", "short_line_share", short & ~wrapped),
        ("junk", "common_share", (c("common_share") < t["common_share"]) & (c("n_words") >= 12)),
    ]


def classified(statistics: DataFrame) -> DataFrame:
    """statistics with kind (prose, list, table, junk, or blank for texts of nothing but white space), reason (the rule that decided it), and failed (all rules that the document fails, with their values)."""
    kind = reason = None
    for name, rule, fails in _rules():
        kind = F.when(fails, name) if kind is None else kind.when(fails, name)
        reason = F.when(fails, rule) if reason is None else reason.when(fails, rule)
    return statistics.withColumn("kind", kind.otherwise("prose")).withColumn("reason", reason).withColumn("failed", failures(statistics))
