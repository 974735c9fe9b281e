"""Text normalisers, id prefixes, prompts and answer parsers, as functions from columns to columns."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python's split() sees it; Java's and RE2's shorthand classes are narrower. The same text serves SQL.
SPACE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
#: Anything but letters, digits, marks-free word characters and white space.
NOT_WORD = r"[^\p{L}\p{N}_\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def collapse(text: Column) -> Column:
    """White space runs become one space, and none is left at the ends."""
    return F.trim(F.regexp_replace(text, SPACE, " "))


def collapse_or_blank(text: Column) -> Column:
    """collapse(), with texts of at most one character replaced by a space."""
    return F.when(F.length(collapse(text)) <= 1, " ").otherwise(collapse(text))


def collapse_lower(text: Column) -> Column:
    return collapse(F.lower(text))


def title_form(text: Column) -> Column:
    """Lower case, with hyphens, line breaks and tabs deleted (not spaced), then collapsed."""
    return collapse(F.translate(F.lower(text), "-\n\t", ""))


def answer_form(text: Column) -> Column:
    """Stripped, lower case, without punctuation, numbers without leading zeros; inner spaces stay."""
    stripped = F.regexp_replace(text, f"^{SPACE}|{SPACE}$", "")
    return F.regexp_replace(F.regexp_replace(F.lower(stripped), NOT_WORD, ""), r"(?<![\p{L}\p{N}_])0+([0-9])", "$1")


def tokens(text: Column) -> Column:
    """Split at every single space, as the index sees words."""
    return F.split(text, " ")


# Fixed values of the documented formats: the marks of the two id prefixes, the relevance prompt, the two verdict words
# and the three question kinds, in the functions below.


def law_prefix(section: Column, law: Column, document: Column, owner: Column, text: Column) -> Column:
    """"[section-law-document@#$owner] text"."""
    return F.concat(F.lit("["), section, F.lit("-"), law, F.lit("-"), document, F.lit("@#$"), owner, F.lit("] "), text)


def article_prefix(article: Column, law: Column, text: Column) -> Column:
    """"[Điều article law] text"."""
    return F.concat(F.lit("[Điều "), article, F.lit(" "), law, F.lit("] "), text)


def split_law_prefix(text: Column) -> dict[str, Column]:
    """The parts of a law_prefix() string: the text ends at the next closing bracket, and a law's hyphens are its own."""
    pieces = F.split(text, r"\]")
    head = F.split(F.substring(F.get(pieces, F.lit(0)), 2, 1 << 20), "-")
    ids = F.split(F.get(head, F.size(head) - 1), r"@#\$")
    return {
        "section": F.get(head, F.lit(0)),
        "law": F.array_join(F.slice(head, 2, F.greatest(F.size(head) - 2, F.lit(0))), "-"),
        "document": F.get(ids, F.lit(0)),
        "owner": F.get(ids, F.lit(1)),
        "body": F.get(pieces, F.lit(1)),
    }


def split_article_prefix(text: Column) -> dict[str, Column]:
    """The parts of an article_prefix() string: closing brackets inside the text are lost, its leading space stays."""
    pieces = F.split(text, r"\]")
    head = F.split(F.get(pieces, F.lit(0)), " ")
    return {
        "law": F.array_join(F.slice(head, 3, F.greatest(F.size(head) - 2, F.lit(0))), " "),
        "article": F.get(head, F.lit(1)),
        "body": F.array_join(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))), ""),
    }


def bracketed(owner: Column, text: Column) -> Column:
    """"[owner]text", with the text collapsed: the form of paragraph corpora."""
    return F.concat(F.lit("["), owner.cast("string"), F.lit("]"), collapse(text))


def split_bracketed(text: Column) -> dict[str, Column]:
    """The parts of a bracketed() string: the text ends at the next closing bracket."""
    pieces = F.split(text, r"\]")
    return {"owner": F.substring(F.get(pieces, F.lit(0)), 2, 1 << 20), "body": F.get(pieces, F.lit(1))}


def joined_sentences(texts: Column) -> Column:
    """The texts of an array as one, with ". " between; null elements are left out, a null array is null."""
    return F.array_join(texts, ". ")


def with_choices(text: Column, choices: Column) -> Column:
    """text followed by the four choices; text alone where any is missing."""
    listed = [F.try_element_at(choices, F.lit(k)) for k in "ABCD"]
    joined = F.concat(text, F.lit(" "), listed[0], *[p for c in listed[1:] for p in (F.lit(". "), c)])
    return F.coalesce(joined, text)


def relevance_prompt(question: Column, document: Column) -> Column:
    return F.concat(F.lit("Câu hỏi: "), question, F.lit(" Điều luật: "), document, F.lit(" Có liên quan:"))


def numbered_relevance_prompt(question: Column, article: Column, document: Column) -> Column:
    """relevance_prompt() of a document whose article number isn't in its text."""
    return relevance_prompt(question, F.concat(F.lit("Điều "), article, F.lit(". "), document))


def verdict_label(word: Column) -> Column:
    """1 for the word of a true verdict, 0 for that of a false one, null for anything else."""
    form = F.lower(F.trim(word))
    return F.when(form == "đúng", 1).when(form == "sai", 0)


def verdict_word(label: Column) -> Column:
    """Any label but zero is true."""
    return F.when(label != 0, "đúng").when(label == 0, "sai")


def printed_choices(choices: Column) -> Column:
    """A map as Python prints a dictionary of strings without quotes inside, keys in order."""
    entries = F.array_sort(F.map_entries(choices))
    return F.concat(F.lit("{"), F.array_join(F.transform(entries, lambda e: F.concat(F.lit("'"), e["key"], F.lit("': '"), e["value"], F.lit("'"))), ", "), F.lit("}"))


# The documented prompt and instruction of each kind of question; {articles}, {question} and {choices} are filled in.
ANSWER_TEMPLATES = {
    "Tự luận": "Các bài viết liên quan: {articles}\n\nCâu hỏi: {question}\n\n",
    "Trắc nghiệm": "Các bài viết liên quan: {articles}\n\nCâu hỏi: {question}\n\nLựa chọn: {choices}\n\n",
    "Đúng/Sai": "Các bài viết liên quan: {articles}\n\nCâu hỏi: {question}\n\n",
}
ANSWER_INSTRUCTIONS = {
    "Tự luận": "Chỉ cần trả lời đáp án ngắn gọn nhất có thể, không cần giải thích",
    "Trắc nghiệm": "Chỉ có 1 đáp án đúng và chỉ cần trả lời A, B, C hoặc D, không cần giải thích",
    "Đúng/Sai": "Chỉ cần trả lời Đúng hoặc Sai, không cần giải thích",
}


def filled_template(template: str, values: Mapping[str, Column]) -> Column:
    """The template with each {name} replaced by its column; a null value counts as empty text."""
    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*[F.coalesce(values[x].cast("string"), F.lit("")) if i % 2 else F.lit(x) for i, x in enumerate(parts) if x])


def answer_prompt(articles: Column, question: Column, kind: Column, choices: Column, templates: Mapping[str, str] = ANSWER_TEMPLATES, instructions: Mapping[str, str] = ANSWER_INSTRUCTIONS, inline: bool = True) -> Column:
    """The prompt of a question by its kind; kinds without a template have none.

    inline: the instruction follows the prompt; otherwise it's meant for a system message (answer_instruction()).
    """
    values = {"articles": articles, "question": question, "choices": F.when(choices.isNotNull(), printed_choices(choices))}
    out = F.lit(None).cast("string")
    for name, template in templates.items():
        filled = filled_template(template, values)
        out = F.when(kind == name, F.concat(filled, F.lit(instructions[name])) if inline else filled).otherwise(out)
    return out


def answer_instruction(kind: Column, instructions: Mapping[str, str] = ANSWER_INSTRUCTIONS) -> Column:
    out = F.lit(None).cast("string")
    for name, said in instructions.items():
        out = F.when(kind == name, said).otherwise(out)
    return out


def extracted_answer(text: Column, kind: Column) -> Column:
    """answer_form() of what stands between the first two "câu trả lời", cut to a leading đúng or sai, or a leading letter of a choice question."""
    form = answer_form(text)
    lead = F.when(form.startswith("câu trả lời"), F.trim(F.get(F.split(form, "câu trả lời"), F.lit(1)))).otherwise(form)
    letter = F.substring(lead, 1, 1)
    return F.when(lead.startswith("đúng"), "đúng").when(lead.startswith("sai"), "sai").when((kind == "Trắc nghiệm") & letter.isin("a", "b", "c", "d"), F.upper(letter)).otherwise(lead)


def typed_answer(text: Column, kind: Column, strict: bool = False) -> Column:
    """The answer in the form its question's kind asks for; a choice answer without a letter is null, or an error if strict."""
    form = F.lower(F.trim(text))
    letter = F.substring(form, 1, 1)
    choice = F.when(letter.isin("a", "b", "c", "d"), F.upper(letter))
    if strict:
        choice = choice.otherwise(F.raise_error(F.concat(F.lit("no choice in: "), F.coalesce(text, F.lit("")))).cast("string"))
    verdict = F.when(form.contains("đúng"), "Đúng").when(form.contains("sai"), "Sai").otherwise(text)
    return F.when(kind == "Đúng/Sai", verdict).when(kind == "Trắc nghiệm", choice).otherwise(text)
