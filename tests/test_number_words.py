"""Values led by numbers: the one walk over a text finds what the whole patterns find, in linear time."""

import random
import re
import time

import pytest

from deltadoc import fixed
from deltadoc.functions import entities as E

WORDS = [*fixed.UNITS, *fixed.TENS, *fixed.SCALES, "and", "a"]


def test_nothing_that_follows_begins_like_a_number_word():
    after = [*fixed.DURATION_UNITS, "naira", "dollar", "pound", "euro", "per", "%"]
    assert not any(w.startswith(n) for w in after for n in WORDS)


def test_walk_equals_whole_patterns():
    rng = random.Random(1)
    bits = ["one", "Two", "hundred", "and", "a", "thousand", "six", "sixty", "5", "12.5", "1.5.5", ".", "%", "per cent", "percentage", "days", "business day", "month", "naira", "dollars", "Pounds", "$", "USD", "usd", "₦", "-", ",", "annum", "others", "someone", "x", "é", "\n", " "]
    for _ in range(6000):
        text = "".join(rng.choice(bits) + rng.choice(["", " ", " ", "  ", "-"]) for _ in range(rng.randint(0, 14)))
        spans = lambda ms: [(m.span(), m.groupdict()) for m in ms]
        assert spans(E._led_by_number(E._number, E._share, E.PERCENT, text)) == spans(E.PERCENT.finditer(text)), text
        assert spans(E._led_by_number(E._bounded_number, E._time, E.DURATION, text)) == spans(E.DURATION.finditer(text)), text
        assert spans(E._sums_in_words(text)) == spans(E.WORD_MONEY.finditer(text)), text
        if not E._money_marks.search(text.lower()):
            assert not [m for m in E.MONEY.finditer(text) if m["pre"] or m["post"]], text


@pytest.mark.parametrize("bit", ["one ", "one-hundred ", "five  and ", "a ", "one day two "])
def test_long_runs_of_number_words_take_linear_time(bit):
    text = bit * (300_000 // len(bit)) + "% cent day dollar"
    began = time.process_time()
    list(E.percent_spans(text)), list(E.duration_spans(text)), list(E._sums_in_words(text))
    assert time.process_time() - began < 5


def test_words_to_number_is_a_fold():
    assert [E.words_to_number(w) for w in ("two hundred and five", "a thousand", "one million two thousand", "and", "x", "twenty-one")] == [205.0, 1000.0, 1002000.0, None, None, 21.0]
    assert re.search(E.NUMBER_WORDS, "two hundred")
