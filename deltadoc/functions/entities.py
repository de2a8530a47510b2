"""Typed values in text with their exact places.

Spark has no function that gives the offsets of all matches, so a small Arrow function finds the spans and
reads their numbers; roles, types and derived values are columns over the words around a span.
Offsets count code points.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as K
from pyspark.sql.functions import arrow_udf
from pyspark.sql.pandas.types import to_arrow_type

from deltadoc import fixed
from deltadoc.functions import text as T

_I = re.I | re.A
_s = fixed.SPACE


def _any(words) -> str:
    return "|".join(sorted(map(re.escape, words), key=len, reverse=True)).replace(r"\ ", " ")


_number_word = _any([*fixed.UNITS, *fixed.TENS, *fixed.SCALES, "and", "a"])
# The patterns of amounts, percentages, dates, durations and obligations.
NUMBER_WORDS = rf"(?:{_number_word})(?:(?:{_s}|-)+(?:{_number_word}))*"
MONEY = re.compile(
    rf"(?P<pre>₦|\$|£|€|¥|(?<![A-Za-z])N(?=\d)|\bNGN|\bUSD|\bGBP|\bEUR|\bKES|\bZAR|\bGHS)?{_s}*"
    rf"(?P<amount>\d{{1,3}}(?:,\d{{3}})+(?:\.\d+)?|\d+(?:\.\d+)?){_s}*"
    rf"(?P<mult>k|m|mn|bn|thousand|million|billion)?\b{_s}*"
    r"(?P<post>naira|dollars?|pounds?|euros?|NGN|USD|GBP|EUR|KES|ZAR|GHS)?", _I,
)
WORD_MONEY = re.compile(rf"(?P<pre>₦|\$|£|€|NGN|USD|GBP|EUR)?{_s}*(?P<words>{NUMBER_WORDS}){_s}*(?P<post>naira|dollars?|pounds?|euros?)", _I)
PERCENT = re.compile(rf"(?P<amount>\d+(?:\.\d+)?|{NUMBER_WORDS}){_s}*(?:%|per{_s}?cent(?:age)?)", _I)
_months = _any(fixed.MONTHS)
DAY_MONTH = re.compile(rf"\b(?P<day>\d{{1,2}})(?:st|nd|rd|th)?{_s}+(?:of{_s}+)?(?P<month>{_months})\.?(?:,?{_s}+(?P<year>\d{{4}}))?\b", _I)
MONTH_DAY = re.compile(rf"\b(?P<month>{_months})\.?{_s}+(?P<day>\d{{1,2}})(?:st|nd|rd|th)?(?:,?{_s}+(?P<year>\d{{4}}))?\b", _I)
NUMERIC_DATE = re.compile(r"\b(?P<a>\d{1,4})[/.-](?P<b>\d{1,2})[/.-](?P<c>\d{2,4})\b", re.A)
DURATION = re.compile(rf"\b(?P<amount>\d+(?:\.\d+)?|{NUMBER_WORDS})(?:{_s}|-)+(?P<unit>{_any(fixed.DURATION_UNITS)})\b", _I)
OBLIGATION = re.compile(
    rf"\b(?P<actor>(?:the{_s}+)?(?:{_any(fixed.ROLES)})|[A-Z][\w&.'-]*(?:{_s}+[A-Z][\w&.'-]*){{0,3}})"
    rf"{_s}+(?P<modality>{_any(fixed.MODALITY_STRENGTH)}){_s}+(?P<rest>.{{0,220}})", _I,
)
#: Numbers at which a value may begin, with a whole run of number words taken at once, and what has to follow them.
_run = rf"(?:{_number_word})(?:(?:{_s}|-)+(?:{_number_word}))*+"
_number = re.compile(rf"\d+(?:\.\d+)?|{_run}", _I)
_bounded_number = re.compile(rf"\b(?:\d+(?:\.\d+)?|{_run})", _I)
_words = re.compile(_run, _I)
_share = re.compile(rf"{_s}*(?:%|per{_s}?cent)", _I)
_time = re.compile(rf"(?:{_s}|-)+(?:{_any(fixed.DURATION_UNITS)})\b", _I)
_sum = re.compile(rf"{_s}*(?:naira|dollar|pound|euro)", _I)
_blank = re.compile(_s, _I)
_sign_before = re.compile(rf"(?:₦|\$|£|€|NGN|USD|GBP|EUR)?{_s}*\Z", _I)
_money_marks = re.compile("[₦$£€¥]|n[0-9]|ngn|usd|gbp|eur|kes|zar|ghs|naira|dollar|pound")
_date_marks = re.compile("[0-9][/.-][0-9]")
ACTION = re.compile(rf"(?:not{_s}+)?[a-z]+(?:{_s}+[a-z]+)?", _I)

SPAN = K.ArrayType(K.StructType([
    K.StructField("family", K.StringType()), K.StructField("source_text", K.StringType()), K.StructField("char_start", K.IntegerType()), K.StructField("char_end", K.IntegerType()),
    K.StructField("value_num", K.DoubleType()), K.StructField("value_str", K.StringType()), K.StructField("unit", K.StringType()), K.StructField("confidence", K.DoubleType()),
    K.StructField("note", K.StringType()), K.StructField("actor", K.StringType()), K.StructField("rest", K.StringType()), K.StructField("action", K.StringType()),
]))


_MEANING = {w: ("plus", n) for w, n in (fixed.UNITS | fixed.TENS).items()} | {w: ("times", n) for w, n in fixed.SCALES.items()} | {"a": ("least", 1), "and": ("plus", 0)}


def words_to_number(phrase: str) -> float | None:
    """The number that words say, or None where one of them isn't a number word or none has a value.

    Smaller numbers add up to a part; a scale multiplies it, and from a thousand on closes it.
    """
    words = [w for w in re.split(r"[\s-]+", phrase.strip().lower()) if w]
    if not {*words} - {"a", "and"} or not {*words} <= _MEANING.keys():
        return None
    closed = part = 0.0
    for kind, n in map(_MEANING.__getitem__, words):
        part = part + n if kind == "plus" else max(part, 1.0) * (n if kind == "times" else 1)
        if kind == "times" and n >= 1000:
            closed, part = closed + part, 0.0
    return closed + part


def parse_number(text: str) -> float | None:
    plain = re.sub(rf"[,]|{_s}", "", text)
    return float(plain) if re.fullmatch(r"\d+(\.\d+)?", plain, re.A) else words_to_number(text)


def _code(token: str | None) -> str | None:
    token = (token or "").strip()
    if token in fixed.CURRENCY_SYMBOLS:
        return fixed.CURRENCY_SYMBOLS[token]
    return "NGN" if token.lower() == "n" else fixed.CURRENCY_CODES.get(token.lower())


def _row(family, m, value=None, text=None, unit=None, confidence=1.0, note=None, actor=None, rest=None, action=None):
    return family, m[0].strip(), m.start(), m.end(), value, text, unit, confidence, note, actor, rest, action


def _led_by_number(number: re.Pattern, follow: re.Pattern, whole: re.Pattern, text: str) -> Iterator[re.Match]:
    """Matches of ``whole``, which is a ``number`` and then ``follow``, in one walk over the text.

    Nothing that may follow begins like a number word, so where a run of words isn't followed by it, no part of
    the run is. Only behind a decimal point may another number begin inside of one.
    """
    at = 0
    while (m := number.search(text, at)) is not None:
        found = whole.match(text, m.start()) if follow.match(text, m.end()) else None
        if found:
            yield found
            at = found.end()
        else:
            at = m.start() + m[0].find(".") + 1 if "." in m[0] else m.end()


def _sums_in_words(text: str) -> Iterator[re.Match]:
    """Matches of ``WORD_MONEY``, which begin at a sign or at the blanks before the words."""
    at = 0
    while (m := _words.search(text, at)) is not None:
        if _sum.match(text, m.end()):
            blank = m.start()
            while blank > at and _blank.match(text, blank - 1):
                blank -= 1
            begin = _sign_before.search(text, max(at, blank - 3), blank)
            found = WORD_MONEY.match(text, begin.start() if begin else blank)
            if found:
                yield found
                at = found.end()
                continue
        at = m.end()


def money_spans(text: str) -> Iterator[tuple]:
    digits = []
    for m in MONEY.finditer(text) if _money_marks.search(text.lower()) else ():
        if not (m["pre"] or m["post"]) or m["pre"] == "n":
            continue
        value = parse_number(m["amount"]) * fixed.MULTIPLIERS.get((m["mult"] or "").lower(), 1)
        code = _code(m["pre"]) or _code(m["post"])
        digits.append(m.span())
        yield _row("MONEY", m, math.floor(value * 100 + 0.5) / 100, unit=code, confidence=1.0 if code else 0.6)
    for m in _sums_in_words(text):
        value = words_to_number(m["words"])
        if value is not None and not any(a <= m.start() < b for a, b in digits):
            yield _row("MONEY", m, value, unit=_code(m["pre"]) or _code(m["post"]), confidence=0.85)


def percent_spans(text: str) -> Iterator[tuple]:
    for m in _led_by_number(_number, _share, PERCENT, text):
        value = parse_number(m["amount"])
        if value is not None:
            yield _row("PERCENT", m, value, unit="percent")


def date_spans(text: str, day_first: bool = True) -> Iterator[tuple]:
    taken: list[tuple[int, int]] = []

    def dated(m, year, month, day, confidence, note=None):
        if 1 <= month <= 12 and 1 <= day <= 31 and not any(a < m.end() and m.start() < b for a, b in taken):
            taken.append(m.span())
            yield _row("DATE", m, text=f"{year:04d}-{month:02d}-{day:02d}" if year else f"--{month:02d}-{day:02d}", unit="date", confidence=confidence, note=note)

    low = text.lower()
    for pattern in (DAY_MONTH, MONTH_DAY) if any(m in low for m in fixed.MONTHS) else ():
        for m in pattern.finditer(text):
            year = int(m["year"] or 0)
            yield from dated(m, year, fixed.MONTHS[m["month"].lower()], int(m["day"]), 1.0 if year else 0.6, None if year else "year not stated")
    for m in NUMERIC_DATE.finditer(text) if _date_marks.search(text) else ():
        a, b, c = int(m["a"]), int(m["b"]), int(m["c"])
        if len(m["a"]) == 4:
            yield from dated(m, a, b, c, 1.0)
        else:
            day, month = (a, b) if day_first else (b, a)
            unclear = a <= 12 and b <= 12 and a != b
            yield from dated(m, c + 2000 if c < 100 else c, month, day, 0.55 if unclear else 0.9, "ambiguous day/month order" if unclear else None)


def duration_spans(text: str) -> Iterator[tuple]:
    for m in _led_by_number(_bounded_number, _time, DURATION, text):
        value = parse_number(m["amount"])
        if value is not None:
            yield _row("DURATION", m, value, unit=fixed.DURATION_UNITS[m["unit"].lower()])


def obligation_spans(text: str) -> Iterator[tuple]:
    for m in OBLIGATION.finditer(text):
        rest = m["rest"].strip()
        action = ACTION.match(rest)
        actor = re.sub(rf"^the{_s}+", "", m["actor"].strip(), flags=_I).lower()
        yield _row("OBLIGATION", m, text=m["modality"].lower(), unit="modality", confidence=0.9, actor=actor, rest=rest, action=action[0].strip().lower() if action else "")


_digit = re.compile(r"\d", re.A)
_sums, _times = ("naira", "dollar", "pound", "euro"), ("day", "week", "month", "year", "hour")


def _spans(text: str | None, day_first: bool) -> list[tuple]:
    """All values; what a pattern can't do without is looked for first, as that is much cheaper."""
    low = (text or "").lower()
    has = lambda words: any(w in low for w in words)
    digits, found = bool(_digit.search(low)), []
    if digits or has(_sums):
        found += money_spans(text)
    if "%" in low or "cent" in low:
        found += percent_spans(text)
    if digits:
        found += date_spans(text, day_first)
    if has(_times):
        found += duration_spans(text)
    if has(fixed.MODALITY_STRENGTH):
        found += obligation_spans(text)
    return found


def _span_lists(texts: pa.Array, day_first: bool) -> pa.Array:
    """The values of each text; equal texts of a batch are read once, and values become columns together."""
    coded = texts.dictionary_encode()
    found = [_spans(t, day_first) for t in coded.dictionary.to_pylist()]
    ends = [0]
    for own in found:
        ends.append(ends[-1] + len(own))
    columns = list(zip(*(row for own in found for row in own))) or [()] * len(SPAN.elementType)
    kinds = [(f.name, to_arrow_type(f.dataType)) for f in SPAN.elementType]
    rows = pa.StructArray.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, kinds)], fields=[pa.field(n, t) for n, t in kinds])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rows).take(coded.indices)


@arrow_udf(SPAN)
def spans_day_first(text: pa.Array) -> pa.Array:
    return _span_lists(text, True)


@arrow_udf(SPAN)
def spans_month_first(text: pa.Array) -> pa.Array:
    return _span_lists(text, False)


def around(text: Column, start: Column, end: Column, before: int, after: int) -> Column:
    begin = F.greatest(start - before, F.lit(0))
    return F.substring(text, begin + 1, end + after - begin)


def to_days(value: Column, unit: Column) -> Column:
    factor = T.lookup(unit, fixed.DAYS_PER)
    return F.when(factor.isNotNull(), F.floor(value * factor * 100 + 0.5) / 100)


def percent_type(window: Column) -> Column:
    return F.when(window.rlike(fixed.RATE_CONTEXT), "INTEREST_RATE").otherwise("PERCENT")


def duration_type(window: Column) -> Column:
    return F.when(window.rlike(fixed.PAYMENT_CONTEXT), "PAYMENT_PERIOD").when(window.rlike(fixed.NOTICE_CONTEXT), "NOTICE_PERIOD").otherwise("DURATION")


def entities(blocks: DataFrame, keys: list[str], day_first: bool = True) -> DataFrame:
    """A row for each typed value in ``blocks`` (``keys`` and text), with place, value and role.

    Percentages near words of interest are rates; durations near words of payment or notice are such
    periods. Values are numbers (value_num) or strings (value_str), exactly one of them.
    """
    find = spans_day_first if day_first else spans_month_first
    rows = blocks.select(*keys, "text", F.explode(find("text")).alias("e")).select(*keys, "text", "e.*")
    is_ = lambda f: F.col("family") == f
    near = lambda b, a: around(F.col("text"), F.col("char_start"), F.col("char_end"), b, a)
    kind = duration_type(near(110, 60))
    rows = rows.withColumn("type", F.when(is_("PERCENT"), percent_type(near(60, 60))).when(is_("DURATION"), kind).otherwise(F.col("family")))
    date_kind = T.first_of(F.lower(around(F.col("text"), F.col("char_start"), F.col("char_start"), 90, 40)), fixed.DATE_KINDS)
    length_kind = F.when(F.col("type") == "PAYMENT_PERIOD", "payment").when(F.col("type") == "NOTICE_PERIOD", "notice").otherwise(T.first_of(F.lower(near(110, 60)), fixed.DURATION_KINDS))
    strength = F.coalesce(T.lookup(F.col("value_str"), fixed.MODALITY_STRENGTH), F.lit(3))
    frequency = F.lower(F.nullif(F.regexp_extract("rest", f"(?i){fixed.FREQUENCY}", 0), F.lit("")))
    return rows.select(
        *keys, "type", "source_text", "char_start", "char_end", "value_num", "value_str", "unit",
        F.when(is_("MONEY"), F.col("unit")).alias("currency"), "confidence",
        F.when(is_("DATE"), date_kind).when(is_("DURATION"), length_kind).alias("kind"),
        F.when(is_("PERCENT"), T.first_of(F.lower(near(60, 60)), fixed.PERCENT_CONTEXTS)).alias("context"), "note",
        F.when(is_("DURATION"), to_days(F.col("value_num"), F.col("unit"))).alias("days_equivalent"), "actor",
        F.when(is_("OBLIGATION"), strength).alias("strength"), "action", F.substring("rest", 1, 160).alias("object"), frequency.alias("frequency"),
        F.when(is_("OBLIGATION"), F.col("rest").rlike(f"(?i){fixed.NEGATION}")).alias("negated"),
    )


def number_words(words: Column) -> Column:
    """The number that an array of lower-case number words says, without Python; null for an unknown word."""
    small = lambda w: T.lookup(w, fixed.UNITS | fixed.TENS)
    scale = lambda w: T.lookup(w, fixed.SCALES)
    none = F.lit(None).cast("long")

    def step(s: Column, w: Column) -> Column:
        part = F.greatest(s.part, F.lit(1).cast("long"))
        return (
            F.when(s.total.isNull() | w.isin("and", ""), s)
            .when(w == "a", F.struct(s.total.alias("total"), part.alias("part"), s.seen.alias("seen")))
            .when(small(w).isNotNull(), F.struct(s.total.alias("total"), (s.part + small(w)).alias("part"), F.lit(True).alias("seen")))
            .when(w == "hundred", F.struct(s.total.alias("total"), (part * 100).alias("part"), F.lit(True).alias("seen")))
            .when(scale(w).isNotNull(), F.struct((s.total + part * scale(w)).alias("total"), F.lit(0).cast("long").alias("part"), F.lit(True).alias("seen")))
            .otherwise(F.struct(none.alias("total"), none.alias("part"), F.lit(True).alias("seen")))
        )

    start = F.struct(F.lit(0).cast("long").alias("total"), F.lit(0).cast("long").alias("part"), F.lit(False).alias("seen"))
    return F.aggregate(words, start, step, lambda s: F.when(s.seen, s.total + s.part))
