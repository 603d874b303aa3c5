"""Keyword queries on texts as columns: words, & (and), | (or), ! (not), <-> (next to), :* (prefix) and parentheses."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .stemming import STOP, stem, stems

_TOKEN = re.compile(r"\s*(<->|[&|!()]|[^\s&|!()<]+)")


_MARKS, _ANY = ("<->", "&", "|", "!", "(", ")"), "\0"


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits; a null text has none."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def _term(term: str) -> tuple[str, bool]:
    prefix = term.endswith(":*")
    return (term[:-2] if prefix else term).lower(), prefix


def _has(words: Column, term: str) -> Column:
    word, prefix = _term(term)
    return _phrase(words, [term]) if prefix else F.array_contains(words, word)


def _phrase(words: Column, terms: list[str]) -> Column:
    """Whether the terms stand next to each other (any word for a stop word): a pattern over the words joined by one space (words hold letters and digits)."""
    parts = ["[^ ]+" if w == _ANY else "\\Q" + w.replace("\\E", "") + "\\E" + "[^ ]*" * prefix for w, prefix in map(_term, terms)]
    return F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" ")).rlike(" " + " ".join(parts) + " ")


def match(text: Column, query: str | None, english: bool = False) -> Column:
    """Whether the text satisfies the query; a null query or "%" is satisfied by every text, a malformed one by none.

    english compares stems and passes over stop words: an operand that is one is dropped with its operator, within a phrase
    it stands for any word in its place, and a query of stop words alone is satisfied by none.
    """
    if query is None or query.strip() == "%":
        return F.lit(True)
    words, parts = tokens(text), [m[1] for m in _TOKEN.finditer(query)]
    if english:
        words = stems(words)
        parts = [p if p in _MARKS or p.endswith(":*") else stem(p.lower()) if p.lower() not in STOP else _ANY for p in parts]
    at = 0

    def peek():
        return parts[at] if at < len(parts) else None

    def take():
        nonlocal at
        at += 1
        return parts[at - 1]

    def either():
        found = both()
        while peek() == "|":
            take()
            other = both()
            found = other if found is None else found if other is None else found | other
        return found

    def both():
        found = one()
        while peek() == "&":
            take()
            other = one()
            found = other if found is None else found if other is None else found & other
        return found

    def one():
        if peek() == "!":
            take()
            inner = one()
            return None if inner is None else ~inner
        if peek() == "(":
            take()
            found = either()
            if peek() != ")":
                raise ValueError(query)
            take()
            return found
        if peek() is None or peek() in ("&", "|", ")", "<->"):
            raise ValueError(query)
        terms = [take()]
        while peek() == "<->":
            take()
            if peek() is None or peek() in ("&", "|", "!", "(", ")", "<->"):
                raise ValueError(query)
            terms.append(take())
        while terms and terms[0] == _ANY:
            del terms[0]
        while terms and terms[-1] == _ANY:
            del terms[-1]
        if not terms:
            return None
        return _has(words, terms[0]) if len(terms) == 1 else _phrase(words, terms)

    try:
        found = either()
        if at != len(parts):
            raise ValueError(query)
    except ValueError:
        return F.lit(False)
    return F.lit(False) if found is None else found
