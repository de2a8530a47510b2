"""Scalar text functions as columns."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from deltadoc import fixed

S = fixed.SPACE


def once(x: Column, f: Callable[[Column], Column]) -> Column:
    """``f(x)`` with ``x`` computed once; as often as ``f`` names a column's expression, Spark computes it again."""
    return F.transform(F.array(x), f)[0]


@pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t))


def fold(text: Column, unicode: bool = True) -> Column:
    """Compatibility form, straight quotes, plain dashes and blanks, no zero-width spaces.

    Without ``unicode`` the text is taken to be in compatibility form already and no Python runs.
    """
    text = nfkc(text) if unicode else text
    plain = F.translate(text, fixed.QUOTES_FROM + fixed.DASHES_FROM + "\u200b", fixed.QUOTES_TO + fixed.DASHES_TO)
    plain = F.regexp_replace(plain, "[\u00a0\u2007\u2009\u202f\u3000]", " ")
    return F.when(text.rlike(r"[^\x00-\x7f]"), plain).otherwise(text)


def squeeze(text: Column) -> Column:
    """Each run of white space as one blank, none at the ends; plain texts with single blanks are only looked at."""
    return F.when(text.rlike("[^ -~]|  |^ | $"), F.trim(F.regexp_replace(text, f"{S}+", " "))).otherwise(text)


def normalize_text(text: Column, unicode: bool = True) -> Column:
    return once(fold(text, unicode), lambda x: F.lower(squeeze(x)))


def normalize_heading(text: Column, unicode: bool = True) -> Column:
    """Lower-case letters and digits of a heading without its number."""
    body = once(fold(text, unicode), lambda x: F.regexp_replace(squeeze(x), fixed.HEADING_NUMBER, ""))
    return once(F.regexp_replace(body, r"[^\p{L}\p{N}\s]", " "), lambda x: F.lower(squeeze(x)))


def heading_number(text: Column, unicode: bool = True) -> Column:
    return F.nullif(F.regexp_extract(F.trim(fold(text, unicode)), fixed.HEADING_NUMBER, 1), F.lit(""))


def heading_body(text: Column, number: Column) -> Column:
    """A heading without its number; ``(untitled)`` where nothing is left."""
    text = F.trim(text)
    rest = F.regexp_replace(F.substring(text, F.length(number) + 1, F.length(text)), r"^[.)\s]+", "")
    body = F.trim(F.when(number.isNotNull(), rest).otherwise(text))
    return F.when(body == "", "(untitled)").otherwise(body)


def section_label(number: Column, heading: Column) -> Column:
    return F.concat_ws(" ", number, heading)


def strip_list_marker(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, fixed.LEADING_MARKER, ""))


def tokens(normalized: Column) -> Column:
    return F.regexp_extract_all(normalized, F.lit(r"[\p{L}\p{N}$£€₦%./-]+"), F.lit(0))


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def sentence_ended(text: Column) -> Column:
    return F.trim(text).rlike(r"[.:;!?]\s*$")


def block_type(text: Column) -> Column:
    """heading, list_item or paragraph, by the look of one block."""
    return once(squeeze_edges(text), lambda s: once(_pieces(s), lambda parts: _type_of(s, parts)))


def _pieces(s: Column) -> Column:
    """Split at runs of white space; at single blanks no pattern is needed."""
    return F.when(s.rlike("[^ -~]|  "), F.split(s, f"{S}+")).otherwise(F.split(s, " "))


def _type_of(s: Column, parts: Column) -> Column:
    ended = sentence_ended(s)
    numbered = s.rlike(fixed.NUMBERED_HEADING) & ~ended & (F.size(F.split(F.regexp_extract(s, fixed.NUMBERED_HEADING, 2), f"{S}+")) <= 12)
    shouted = (F.size(parts) <= 10) & (s == F.upper(s)) & s.rlike(r"\p{L}")
    capital = F.size(F.filter(parts, lambda w: w.rlike(r"^\p{Lu}")))
    titled = (F.size(parts) <= 9) & ~ended & s.rlike(r"^\p{Lu}") & (capital / F.size(parts) >= 0.6)
    return (
        F.when(s == "", "paragraph").when(s.rlike(fixed.LIST_MARK), "list_item").when(numbered | shouted | titled, "heading").otherwise("paragraph")
    )


def squeeze_edges(text: Column) -> Column:
    return F.when(text.rlike("[^ -~]|^ | $"), F.regexp_replace(text, f"^{S}+|{S}+$", "")).otherwise(text)


def distinct_terms(normalized: Column) -> Column:
    """``content_terms`` without repeats; a word that comes back is stemmed once."""
    return F.array_distinct(_terms(F.array_distinct(F.regexp_extract_all(normalized, F.lit("[a-z][a-z-]+"), F.lit(0)))))


def content_terms(normalized: Column) -> Column:
    """Stemmed words of three letters or more that aren't stop words, with repeats."""
    return _terms(F.regexp_extract_all(normalized, F.lit("[a-z][a-z-]+"), F.lit(0)))


def _terms(raw: Column) -> Column:
    bare = F.transform(raw, lambda w: F.regexp_replace(w, "^-+|-+$", ""))
    kept = F.filter(bare, lambda w: (F.length(w) >= 3) & ~w.isin(fixed.STOP_WORDS))

    def stem(w: Column) -> Column:
        cut = w
        for suffix in reversed(fixed.SUFFIXES):
            n = len(suffix)
            cut = F.when((F.length(w) > n + 2) & w.endswith(suffix), F.substring(w, F.lit(1), F.length(w) - n)).otherwise(cut)
        return cut

    return F.transform(kept, stem)


def cosmetic_key(text: Column) -> Column:
    return F.lower(F.regexp_replace(text, r"[^\p{L}\p{N}$£€₦%]", ""))


def is_cosmetic(a: Column, b: Column) -> Column:
    """Whether only white space, case or punctuation differs."""
    return cosmetic_key(a) == cosmetic_key(b)


def any_of(text: Column, keywords) -> Column:
    return reduce(lambda x, y: x | y, [F.contains(text, F.lit(k)) for k in keywords])


def categorize(*texts: Column) -> Column:
    """Categories whose keywords occur, in their fixed order."""
    found = lambda blob: F.array_compact(F.array(*[F.when(any_of(blob, words), F.lit(name)) for name, words in fixed.CATEGORY_KEYWORDS]))
    return once(F.lower(F.concat_ws(" ", *texts)), found)


def categories_or(found: Column, fallback: Column | str) -> Column:
    fallback = F.lit(fallback) if isinstance(fallback, str) else fallback
    return once(found, lambda x: F.when(F.size(x) > 0, x).otherwise(F.array(fallback)))


def merge_categories(first: Column, more: Column) -> Column:
    return once(F.array_distinct(F.concat(first, more)), lambda x: F.when(F.size(x) > 0, x).otherwise(F.array(F.lit("WORDING"))))


def entity_categories(types: Column) -> Column:
    return F.array_distinct(F.array_compact(F.transform(types, lambda t: lookup(t, fixed.ENTITY_CATEGORY))))


def lookup(key: Column, table: dict, default=None) -> Column:
    made = F.lit(default)
    for k, v in table.items():
        made = F.when(key == k, F.lit(v)).otherwise(made)
    return made


def first_of(text: Column, pairs, default: str = "general") -> Column:
    """The label of the first keyword that occurs in lower-case ``text``."""
    made = F.lit(default)
    for keyword, label in reversed(pairs):
        made = F.when(F.contains(text, F.lit(keyword)), F.lit(label)).otherwise(made)
    return made


def shorten(text: Column, limit: int = 180) -> Column:
    return once(once(text, squeeze), lambda s: F.when(F.length(s) <= limit, s).otherwise(F.concat(F.rtrim(F.substring(s, 1, limit - 1)), F.lit("…"))))


def rewrite_summary(before: Column, after: Column) -> Column:
    both = F.concat(F.lit('Wording changed: "'), shorten(before, 120), F.lit('" → "'), shorten(after, 120), F.lit('".'))
    return (
        F.when((before != "") & (after != ""), both)
        .when(after != "", F.concat(F.lit('Text added: "'), shorten(after, 160), F.lit('".')))
        .when(before != "", F.concat(F.lit('Text removed: "'), shorten(before, 160), F.lit('".')))
        .otherwise("Text modified.")
    )


def title_case(text: Column) -> Column:
    """The first letter of each run of ASCII letters, digits and underscores in upper case; the rest stays."""
    parts = F.split(text, "(?<=[^A-Za-z0-9_])")
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, F.lit(2), F.length(p)))), "")


def short_section(path: Column) -> Column:
    """The last two parts of a section path."""
    parts = F.split(path, " > ")
    return F.when(F.size(parts) <= 2, path).otherwise(F.concat(F.lit("… > "), F.array_join(F.slice(parts, -2, 2), " > ")))


def html_escape(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def safe_stem(name: Column) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(name, r"[^\p{L}\p{N}\-_ ]", "-"), " +", "-"), 1, 80)


def plural(n: Column, word: str) -> Column:
    return F.concat(n.cast("string"), F.lit(f" {word}"), F.when(n == 1, "").otherwise("s"))


def half_up(x: Column, places: int) -> Column:
    """Rounds halves towards positive infinity."""
    f = 10**places
    return F.floor(x * f + 0.5) / f


def number(x: Column) -> Column:
    """A number without trailing zeros, at most two decimals."""
    return F.call_function("format_number", x, F.lit("0.##"))


def amount(x: Column, currency: Column) -> Column:
    """An amount with its currency's sign, or with its code after it."""
    body = F.call_function("format_number", x, F.lit("#,##0.##"))
    glyph = lookup(currency, fixed.GLYPHS)
    return F.when(glyph.isNotNull(), F.concat(glyph, body)).when(currency.isNotNull(), F.concat_ws(" ", body, currency)).otherwise(body)
