"""Text normalisation and term matching as column expressions."""

from __future__ import annotations

import html
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from noticegrid import settings as S

WORD = r"[\p{L}\p{N}_]"
_ODD_SPACE = r"\t-\r\x1C-\x1F\x85\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
# Whitespace runs that are not already one plain space.
_RUN = rf" ?[{_ODD_SPACE}][ {_ODD_SPACE}]*|  [ {_ODD_SPACE}]*"
# A character NFKC could change: not ASCII, and in none of the ranges known to be stable.
# Text without one never leaves the JVM; the first test rejects ASCII at once.
_NFKC_UNSTABLE = (
    "[\\x{80}-\\x{10FFFF}&&[^À-ı¡-§©«¬®°±¶·»¿"
    "Ĵ-ľŁ-ňŊ-žء-غف-ي٠-٩"
    "۰-۹‐‒-‖‘-‟†-•€]]"
)
_DIGITS_FROM = "".join(chr(0x0660 + i) for i in range(10)) + "".join(chr(0x06F0 + i) for i in range(10))
_ARABIC = r"[؀-ۿݐ-ݿﭐ-﷿ﹰ-﻿]"
_ARABIC_PY = re.compile("[؀-ۿݐ-ݿﭐ-﷿ﹰ-﻿]")

# Tags that mark a string as markup.
MARKUP_TAGS = (
    "p br div span strong em b i u ul ol li dl dt dd table thead tbody tr td th h[1-6] a "
    "font img hr sub sup blockquote pre code section article small figure figcaption"
).split()
_NAMED_TAG = rf"(?i)</?(?:{'|'.join(MARKUP_TAGS)})\b[^>]*/?>"
_ANY_TAG = (
    r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>"
    r"|<template\b.*?</template\s*>"
    r"""|<[a-z/!?](?:"[^"]*"|'[^']*'|[^'">])*>"""
)


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body`` as a bound variable."""
    return F.transform(F.array(value), body)[0]


def quoted(value) -> str:
    """A value as a SQL literal."""
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    if isinstance(value, (list, tuple)):
        return f"array({', '.join(quoted(v) for v in value)})"
    return f"{value!r}D" if isinstance(value, float) else repr(value)


def literals(values) -> Column:
    """Constant array, parsed as one literal instead of one call per element."""
    return F.expr(quoted(list(values)))


def literal_rows(rows: list[dict]) -> Column:
    """Constant array of structs."""
    return F.expr(quoted_rows(rows))


def quoted_rows(rows: list[dict]) -> str:
    one = ("named_struct(" + ", ".join(f"{quoted(k)}, {quoted(v)}" for k, v in r.items()) + ")" for r in rows)
    return f"array({', '.join(one)})"


def literal_map(table: dict) -> Column:
    """Constant map."""
    return F.expr("map(" + ", ".join(f"{quoted(k)}, {quoted(v)}" for k, v in table.items()) + ")")


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def filled(c: Column) -> Column:
    """The value, or NULL when it is empty or blank."""
    return F.when(F.length(F.trim(c)) > 0, c)


def first_filled(*columns: Column) -> Column:
    """First non-empty value among several spellings of one field."""
    return F.coalesce(*[filled(c) for c in columns])


def ascii_digits(c: Column) -> Column:
    """Arabic-Indic and Persian digits as ASCII digits."""
    return F.translate(c, _DIGITS_FROM, "0123456789" * 2)


def _tidy(text: str) -> str:
    text = unicodedata.normalize("NFKC", text).replace("\u200f", "").replace("\u200e", "")
    return " ".join(text.split())


@F.pandas_udf(StringType())
def _clean_rare(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else _tidy(v))


@F.pandas_udf(StringType())
def _unescape_rare(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else _tidy(html.unescape(v)))


def collapse(c: Column) -> Column:
    """Drop direction marks, collapse whitespace, trim; NULL becomes the empty string."""
    def tidy(t: Column) -> Column:
        marked = t.contains("\u200e") | t.contains("\u200f")
        bare = F.when(marked, F.translate(t, "\u200e\u200f", "")).otherwise(t)
        return F.trim(F.regexp_replace(bare, _RUN, " "))

    return let(text_or_empty(c), tidy)


def clean(c: Column) -> Column:
    """NFKC, direction marks dropped, whitespace collapsed, trimmed; NULL-safe.

    Only values that NFKC could change are sent to Python.
    """
    unstable = F.when(c.rlike(_NFKC_UNSTABLE), c)
    return F.coalesce(_clean_rare(unstable), collapse(c))


def _without_tags(c: Column) -> Column:
    """Tags as spaces, then entities and NFKC; Python sees only values that need it."""
    bare = F.regexp_replace(c, _ANY_TAG, " ")
    needs_python = let(bare, lambda t: F.when(t.contains("&") | t.rlike(_NFKC_UNSTABLE), t))
    return F.coalesce(_unescape_rare(needs_python), collapse(bare))


def strip_markup(c: Column) -> Column:
    """Plain text of a value that carries named tags, else :func:`clean`.

    Tags become spaces before entities resolve, so an escaped tag stays readable text.
    """
    marked = c.rlike(_NAMED_TAG)
    markup, plain = F.when(marked, c), F.when(~marked, c)
    return F.when(marked, _without_tags(markup)).otherwise(clean(plain))


def page_text(c: Column) -> Column:
    """Readable text of a whole page."""
    return _without_tags(c)


def arabic_share(c: Column) -> Column:
    """Share of Arabic letters among all letters, 0 when there are no letters."""
    letters = F.length(F.regexp_replace(c, r"[^\p{L}]", ""))
    arabic = F.length(F.regexp_replace(c, r"[^\p{L}]|[^" + _ARABIC[1:], ""))
    return F.when(letters > 0, arabic / letters).otherwise(F.lit(0.0))


def language(c: Column, threshold: float = 0.20) -> Column:
    """``ar`` when at least ``threshold`` of the letters are Arabic, else ``en``."""
    # Text without any Arabic character skips the two counting passes.
    share = F.when(c.rlike(_ARABIC), arabic_share(c)).otherwise(F.lit(0.0))
    return F.when(share >= threshold, "ar").otherwise("en")


def truncate(c: Column, limit: int) -> Column:
    """Cut cleaned text at a word boundary and append an ellipsis."""
    def cut(t: Column) -> Column:
        head = F.regexp_replace(F.substring(t, 1, limit), r" [^ ]*$", "")
        return F.when(F.length(t) <= limit, t).otherwise(F.concat(head, F.lit(" …")))

    return let(clean(c), cut)


# ---------------------------------------------------------------------- term matching


def _quote(term: str) -> str:
    return re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", term)


def word_pattern(terms) -> str:
    """Alternation of whole-word terms with Unicode-aware boundaries."""
    return rf"(?<!{WORD})(?:{'|'.join(_quote(t) for t in terms)})(?!{WORD})"


def is_substring_term(term: str) -> bool:
    """Arabic terms and phrases match anywhere; single words match whole words."""
    return bool(_ARABIC_PY.search(term)) or " " in term or "-" in term


def contains_any(c: Column, terms) -> Column:
    """Whether any term occurs as a substring."""
    return F.exists(literals(terms), lambda t: c.contains(t))


def _matches(text: Column, term: Column) -> Column:
    """Whether a ``{term, pattern}`` row occurs; the pattern runs only on a substring hit."""
    whole = term["pattern"]
    return text.contains(term["term"]) & ((whole == "") | F.rlike(text, whole))


def _term_rows(lexicon, phrases=is_substring_term) -> Column:
    return literal_rows([
        {"term": t, "pattern": "" if phrases(t) else word_pattern([t])}
        for t in dict.fromkeys(t.lower() for t in lexicon)
    ])


def term_hits(c: Column, lexicon) -> Column:
    """Distinct lexicon terms present in cleaned text, in lexicon order."""
    if not lexicon:
        return F.array().cast("array<string>")
    rows = _term_rows(lexicon)

    def hits(text: Column) -> Column:
        return F.transform(F.filter(rows, lambda t: _matches(text, t)), lambda t: t["term"])

    return let(F.lower(clean(c)), hits)


def mentions_country(
    terms: S.CountryTerms, *parts: Column, url: Column | None = None, cleaned: bool = False
) -> Column:
    """Whether text or link refers to the country (never NULL).

    ``cleaned`` says that the parts went through :func:`clean` before.

    A country domain counts unless it is the tail of an e-mail address; Latin terms match
    whole words after addresses are removed; agglutinative terms match as substrings.
    """
    texts = [filled(p if cleaned else clean(p)) for p in parts]
    blob = F.concat_ws(" ", *texts, *([filled(url)] if url is not None else []))

    def domain_in(candidate: Column) -> Column:
        dot = _quote(terms.tld)
        in_link = candidate.rlike(rf"(?i)://[^/\s]*{dot}(?:[/:\s]|$)")
        bare = candidate.rlike(rf"(?i)(?<!{WORD})[\p{{L}}\p{{N}}_-]+{dot}(?!{WORD})")
        before = F.right(F.substring_index(candidate, terms.tld, 1), F.lit(40))
        hit = in_link | (bare & ~before.contains("@"))
        return F.lower(candidate).contains(terms.tld.lower()) & hit

    def matched(b: Column) -> Column:
        address = rf"[\p{{L}}\p{{N}}_.+-]+@[\p{{L}}\p{{N}}_-]+(?:\.[\p{{L}}\p{{N}}_-]+)+"
        without = F.when(b.contains("@"), F.regexp_replace(b, address, " ")).otherwise(b)
        latin = _term_rows(terms.latin, phrases=lambda t: False)
        test = let(F.lower(without), lambda low: F.exists(latin, lambda t: _matches(low, t)))
        if terms.substrings:
            test = test | contains_any(b, terms.substrings)
        if terms.tld:
            test = domain_in(b) | test
            if url is not None:
                test = test | F.coalesce(domain_in(url), F.lit(False))
        return test

    return F.coalesce(let(blob, matched), F.lit(False))


def sector(c: Column, lexicon: dict[str, list[str]] | None = None) -> Column:
    """Label with the most lexicon substrings; the first declared label wins a tie."""
    lexicon = lexicon or S.SECTOR_LEXICON

    ranked = literal_rows([
        {"label": label, "rank": -rank, "terms": list(terms)}
        for rank, (label, terms) in enumerate(lexicon.items())
    ])

    def best(text: Column) -> Column:
        scored = F.transform(ranked, lambda s: F.struct(
            F.size(F.filter(s["terms"], lambda t: text.contains(t))).alias("n"), s["rank"], s["label"],
        ))
        return let(F.array_max(scored), lambda top: F.when(top["n"] > 0, top["label"]).otherwise(S.UNCLASSIFIED))

    return let(F.lower(c), best)


def restricted(c: Column, markers=tuple(S.RESTRICTION_MARKERS)) -> Column:
    """Whether the text restricts bidding by nationality."""
    return let(F.lower(c), lambda t: contains_any(t, [m.lower() for m in markers]))
