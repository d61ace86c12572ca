"""Tokens, words and wildcard patterns as Java regular expressions and Columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: a token of the standard tokenizer; . and ' between letters and . , between digits don't split.
TOKEN = r"[\p{L}\p{N}_]+(?:(?:(?<=\p{L})['.](?=\p{L})|(?<=\p{N})[.,](?=\p{N}))[\p{L}\p{N}_]+)*"
_BEFORE, _AFTER = r"(?<![\p{L}\p{N}_])(?<!\p{L}['.])(?<!\p{N}[.,](?=\p{N}))", r"(?![\p{L}\p{N}_])(?!['.]\p{L})"
_GAP = r"[^\p{L}\p{N}_]+"


def tokens_of(text: str) -> list[str]:
    """A query text's tokens, in lower case."""
    import regex

    return [t.lower() for t in regex.findall(TOKEN, str(text)) if regex.search(r"[\p{L}\p{N}]", t)]


def tokens(column: Column) -> Column:
    """A text column's tokens, in lower case."""
    return F.filter(F.regexp_extract_all(F.lower(column), F.lit(f"({TOKEN})"), F.lit(1)), lambda t: t.rlike(r"[\p{L}\p{N}]"))


def quote(text: str) -> str:
    """A literal in a Java regular expression."""
    return re.sub(r"([\\^$.|?*+()\[\]{}\-&#~<>\"/@])", r"\\\1", text)


def word_regex(word: str, prefix: bool = False) -> str:
    return f"(?iu){_BEFORE}{quote(word)}{'' if prefix else _AFTER}"


def phrase_regex(words: list[str], slop: int = 0, prefix: bool = False) -> str:
    gap = f"(?:{_GAP}[\\p{{L}}\\p{{N}}_]+){{0,{slop}}}{_GAP}" if slop else _GAP
    return f"(?iu){_BEFORE}{gap.join(map(quote, words))}{'' if prefix else _AFTER}"


def wildcard_regex(pattern: str, fold: bool = False) -> str:
    r"""* and ? with \ escapes, anchored."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            i += 1
            out += quote(pattern[i])
        else:
            out += {"*": ".*", "?": "."}.get(c) or quote(c)
        i += 1
    return f"(?{'i' if fold else ''}s)^{out}$"


def ascii_lower(column: Column) -> Column:
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def within_edits(column: Column, word: str, edits: int, transpositions: bool = True) -> Column:
    """Whether a column is at most ``edits`` (0 to 2) edits from a word; a swap of neighbours is one edit.

    With swaps this is the distance in which no part is edited twice: the column is within reach if
    plain edits suffice, or if a swap in the word and the edits that are left do.
    """
    near = F.levenshtein(column, F.lit(word)) <= edits
    if transpositions and edits:
        swapped = {word[:i] + word[i + 1] + word[i] + word[i + 2 :] for i in range(len(word) - 1) if word[i] != word[i + 1]}
        for w in sorted(swapped):
            near = near | (F.levenshtein(column, F.lit(w)) <= edits - 1)
        if edits >= 2:
            twice = {w[:i] + w[i + 1] + w[i] + w[i + 2 :] for w in swapped for i in range(len(w) - 1)} - {word}
            near = near | column.isin(sorted(twice))
    return near


def auto_fuzziness(value, word: str) -> int:
    text = str(value if value is not None else "AUTO").upper()
    if text.startswith("AUTO"):
        low, high = (int(x) for x in text[5:].split(",")) if ":" in text else (3, 6)
        return 0 if len(word) < low else 1 if len(word) < high else 2
    return int(float(text))
