"""Layout decides: each of its three measures changes what is prose."""

import random

import pytest

from chronoplane.llm import quality as ql

COMMON = frozenset("the of and to in is a was for it on that at by this with from as not are be has".split())
TABLE = "\n".join(["item;state;seen", "the gate of the short series;not yet;it was late", "the manifest of the panel;to be seen;the sample is short", "the end of the run;done;it is not known"])
LIST = "\n".join(["1) the end of the first panel", "2) not yet in the record for the long sample", "3) which window to use if the calendar has a hole", "4) the correction of the bond panel"])
FIXED = "\n".join(f"{name:>12}{state:>14}{place:>12}" for name, state, place in [("series", "state", "place"), ("skew", "waiting", "north"), ("carry", "", "south"), ("breadth", "waiting", ""), ("gold", "finished", "east"), ("spread", "", "west")])


def other(text):
    r = ql.assess(text, COMMON)
    return r["other_chars"] > r["prose_chars"]


@pytest.mark.parametrize("text,measure,without", [(TABLE, "alignment", lambda lines: [False] * len(lines)), (LIST, "periodicity", lambda lines: 0.0), (FIXED, "length_autocorrelation", lambda lines: 0.0)])
def test_each_measure_decides(monkeypatch, text, measure, without):
    assert other(text)
    monkeypatch.setattr(ql, measure, without)
    monkeypatch.setattr(ql, "natural", lambda lines, common: (True, ql.characters(" ".join(lines))[0]))
    assert not other(text)


def test_characters_are_counted_by_kind():
    rng = random.Random(1)
    for _ in range(300):
        text = "".join(rng.choices("ab Z09.,-#|_ \t\nä¿€日“‍ ", k=rng.randint(0, 40)))
        wide = [c for c in text if ord(c) > 127 and not c.isspace()]
        plain = [c for c in text if ord(c) < 128 and not c.isspace()]
        letters = sum(c.isalpha() for c in plain) + sum(c.isalnum() for c in wide)
        marks = sum(not c.isalnum() and c not in ".,-" for c in plain) + sum(not c.isalnum() and c not in ql.WIDE_PUNCTUATION for c in wide)
        got = ql.characters(text)
        assert (got[0], got[1], got[3]) == (len(wide) + len(plain), letters, marks)


def test_length_of_a_line_makes_no_difference():
    rng = random.Random(2)
    names = ["".join(rng.choices(["ba", "lo", "mi", "te", "ru", "sen"], k=3)) for _ in range(400)]
    for n in (1, 40, 4_000):
        assert not other(" ".join(f"the {rng.choice(names)} of the {rng.choice(names)} was {rng.choice(names)}, and it is not {rng.choice(names)} at {rng.choice(names)}." for _ in range(n)))
        assert other("total=1;count=2;" * 4 * n) and other("<b>x</b> &amp; " * 4 * n) and other("{'a': [1, 2]}, " * 4 * n)


def test_statistics(spark):
    text = "It's a day.\r\nNot 2 days!\r\r— “So?”  \n \nend"
    blank = [(1, None), (2, ""), (3, " \n\t")]
    df = spark.createDataFrame([*blank, (4, text), (4, text), (5, "..."), (6, "ΛΑΓ 5")], "doc_id long, text string").selectExpr("*", "1 as words", "'x' as layout")
    rows = ql.text_quality(df, "doc_id", "text", frozenset({"a", "so"})).collect()
    assert len(rows) == 7 and all(r.words is None and r.symbol_ratio is None and r.is_prose is None for r in rows if r.doc_id < 4)
    r = [x for x in rows if x.doc_id == 4][0]
    assert r.words == 7 and abs(r.mean_word_length - 20 / 7) < 1e-9 and abs(r.punctuated_lines - 3 / 4) < 1e-9
    assert abs(r.common_words - 2 / 7) < 1e-9 and r.distinct_words == 1.0 and abs(r.digit_ratio - 1 / 27) < 1e-9 and abs(r.symbol_ratio - 7 / 27) < 1e-9
    r = [x for x in rows if x.doc_id == 5][0]
    assert (r.words, r.mean_word_length, r.symbol_ratio, r.common_words, r.is_prose) == (0, 0.0, 1.0, 0.0, False)
    assert [x.words for x in rows if x.doc_id == 6] == [1]
