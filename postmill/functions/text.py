"""String functions as column expressions; one needs Arrow, since Spark has no HTML parser."""

from __future__ import annotations

import re
from functools import reduce
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .lookups import ABBREVIATIONS, ALIASES, BOARD_PATTERNS, LEGAL_SUFFIXES, NOT_SLUGS, literal_map

WORD_CHAR = r"\p{L}\p{N}_"


def _decomposed(value: Column) -> Column:
    """Lower case; NFKD by the ICU library that Spark brings along, where the text isn't plain ASCII."""
    low = F.lower(value)
    nfkd = F.java_method(F.lit("com.ibm.icu.text.Normalizer"), F.lit("decompose"), F.coalesce(low, F.lit("")), F.lit(True))
    return F.when(F.octet_length(low) != F.length(low), nfkd).otherwise(low)


def squash(value: Column) -> Column:
    """Lower case, NFKD, then letters and digits of ASCII only. A column that uses it isn't merged into others: it is worked out once."""
    return F.regexp_replace(_decomposed(value), "[^a-z0-9]+", "")


def fold(value: Column) -> Column:
    """Lower case, NFKD, without combining marks."""
    return F.regexp_replace(_decomposed(value), r"\p{Mn}+", "")


def _tokens(folded: Column) -> Column:
    return F.filter(F.split(folded, "[^a-z0-9]+"), lambda t: t != "")


def normalize_company(name: Column, folded=fold) -> Column:
    """One word of letters and digits, without one trailing legal suffix where something else is left."""
    tokens = _tokens(F.replace(folded(F.coalesce(name, F.lit(""))), F.lit("."), F.lit("")))
    legal = F.coalesce(F.element_at(tokens, -1).isin(LEGAL_SUFFIXES), F.lit(False))
    return F.when(F.size(tokens) == 0, "").when((F.size(tokens) > 1) & legal, F.array_join(F.slice(tokens, F.lit(1), F.size(tokens) - 1), "")).otherwise(F.array_join(tokens, ""))


# A trailing gender tag, then a trailing requisition number behind a dash or bracket.
GENDER_TAG = r"(?i)\(\s*([mfwdx](\s*/\s*[mfwdx])+|all\s+genders?)\s*\)\s*$"
REQUISITION = r"(?i)[-–—(\[]\s*(req[-\s]?)?[a-z]{0,3}[-\s]?\d{3,}\s*[)\]]?\s*$"


def normalize_title(title: Column, folded=fold) -> Column:
    clean = F.regexp_replace(F.trim(F.coalesce(title, F.lit(""))), GENDER_TAG, "")
    clean = F.replace(F.trim(F.regexp_replace(clean, REQUISITION, "")), F.lit("&"), F.lit(" and "))
    full = literal_map(ABBREVIATIONS)
    return F.array_join(F.transform(_tokens(folded(clean)), lambda t: F.coalesce(F.try_element_at(full, t), t)), "")


def normalize_location(place: Column, squashed=squash) -> Column:
    return F.coalesce(squashed(F.split_part(place, F.lit(","), F.lit(1))), F.lit(""))


def dedupe_key(company: Column, title: Column, place: Column) -> Column:
    c, t = normalize_company(company), normalize_title(title)
    return F.when((c != "") & (t != ""), F.concat_ws("|", c, t, normalize_location(place)))


def let(value: Column, body) -> Column:
    """``body(value)`` with the value worked out once, however often the body has it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def slugify(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), "[^a-z0-9]+", "")


def word_pattern(term: str) -> str:
    """A pattern that finds the term as a whole word; a side that ends in punctuation has no boundary."""
    term = term.strip()
    left = rf"(^|[^{WORD_CHAR}])" if term[:1].isalnum() else ""
    right = rf"([^{WORD_CHAR}]|$)" if term[-1:].isalnum() else ""
    return f"(?i){left}{re.escape(term)}{right}"


def any_word(text: Column, terms: list[str]) -> Column:
    """Does any term stand in the text as a whole word: one pattern, tried only where a term stands there at all."""
    terms = [t.strip() for t in terms if t.strip()]
    if not terms:
        return F.lit(False)
    there = let(F.lower(text), lambda low: reduce(lambda a, b: a | b, [low.contains(t.lower()) for t in terms]))
    return F.coalesce(there & text.rlike("(?i)" + "|".join(f"({word_pattern(t)[4:]})" for t in terms)), F.lit(False))


# What separates skills on a line, and evidence handles within prose.
SKILL_PARTS = r"[:,;·|/]|\s{2,}"
HANDLES = r"[(\[]\s*E\d+(?:\s*,\s*E\d+)*\s*[)\]]|\bE\d+\b"


def split_skill_line(line: Column) -> Column:
    return F.filter(F.transform(F.split(line, SKILL_PARTS), lambda p: F.trim(p)), lambda p: p != "")


def members(line: Column) -> Column:
    """What stands after the last colon, by commas, each once."""
    return F.array_distinct(F.filter(F.transform(F.split(F.substring_index(line, ":", -1), ","), lambda p: F.trim(p)), lambda p: p != ""))


def token_bag(text: Column) -> Column:
    """Tokens with a blank on each side, so that a phrase of whole tokens is found by ``contains``."""
    return F.concat(F.lit(" "), F.array_join(_tokens(F.lower(text)), " "), F.lit(" "))


def has_phrase(bag: Column, phrase: Column) -> Column:
    inner = token_bag(phrase)
    return (F.trim(inner) != "") & bag.contains(inner)


def expand_alias(value: Column) -> Column:
    """The fuller spelling of a short one, for whole strings; null where there is none."""
    return F.try_element_at(literal_map(ALIASES), squash(value))


def strip_handles(text: Column) -> Column:
    """Without (E1), [E1, E2] and bare E1, and without the blanks that they leave."""
    out = F.regexp_replace(F.regexp_replace(text, HANDLES, ""), r"\s+([.,;:!?])", "$1")
    return F.trim(F.regexp_replace(out, r"[ \t]{2,}", " "))


def join_nonempty(*parts: Column, by: str = ", ") -> Column:
    return F.nullif(F.concat_ws(by, *(F.nullif(F.trim(p), F.lit("")) for p in parts)), F.lit(""))


def domain_of(url: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)", 1)), r"^www\.", "")


def url_key(url: Column) -> Column:
    """Host and path in lower case, without query, fragment and trailing slashes."""
    return F.regexp_replace(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^?#]*)", 1)), "/+$", "")


def is_supported(claim: Column, source: Column, squashed=squash) -> Column:
    c = squashed(claim)
    return F.coalesce((F.length(c) > 0) & squashed(source).contains(c), F.lit(False))


def detect_board(text: Column) -> Column:
    """(ats, slug) of the first board pattern, in order, that has a match with a real slug."""
    found = []
    for ats, pattern in BOARD_PATTERNS:
        slugs = F.filter(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), lambda s: ~F.lower(s).isin(NOT_SLUGS))
        found.append(F.when(F.size(slugs) > 0, F.struct(F.lit(ats).alias("ats"), slugs[0].alias("slug"))))
    return F.coalesce(*found)


#: Elements that begin and end lines.
BLOCKS = frozenset("address article aside blockquote br dd div dl dt fieldset footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table td th tr ul".split())


#: Texts that are strings of Python at a time.
TEXTS = 64


class _Text(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.skipping = [], 0

    def handle_starttag(self, tag, attrs):
        self.skipping += tag in ("script", "style")
        if tag in BLOCKS:
            self.out.append("\n")

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.skipping = max(0, self.skipping - 1)
        elif tag in BLOCKS:
            self.out.append("\n")

    def handle_data(self, data):
        if not self.skipping:
            self.out.append(data)


def _plain_text(markup: str | None) -> str | None:
    if markup is None:
        return None
    parser = _Text()
    parser.feed(markup)
    parser.close()
    lines = re.sub(r"[ \t]+\n", "\n", "".join(parser.out))
    return re.sub(r"\n{3,}", "\n\n", lines).strip() or None


@F.arrow_udf(T.StringType())
def html_to_text(markup: pa.Array) -> pa.Array:
    """Text without scripts and styles, blocks on lines of their own, no runs of blank lines; null if empty."""
    # a batch may have 10,000 long texts: few of them at a time are strings of Python
    parts = (markup.slice(at, TEXTS).to_pylist() for at in range(0, len(markup), TEXTS))
    return pa.concat_arrays([pa.array([], pa.string()), *(pa.array(map(_plain_text, texts), pa.string()) for texts in parts)])
