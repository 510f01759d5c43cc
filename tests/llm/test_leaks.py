"""Pigeonhole matching against plain dynamic programming."""

import random

from partita.llm import leaks
from partita.llm.queries import QUERIES


def plain(item, text):
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        old, row[0] = row[:], i
        for j, b in enumerate(text, 1):
            row[j] = min(old[j] + 1, row[j - 1] + 1, old[j - 1] + (a != b))
    return min(row)


def test_finds_all_within_budget():
    draw = random.Random(5)
    items = [(k, "".join(draw.choice("abcde ") for _ in range(80)).strip().replace("  ", " a")) for k in range(6)]
    items = [(k, leaks.normal(t)) for k, t in items]
    matcher = leaks.Matcher(items)
    for _ in range(60):
        text = list(draw.choice(items)[1])
        for _ in range(draw.randrange(8)):
            at = draw.randrange(len(text))
            text[at : at + draw.randrange(2)] = draw.choice(["", "x", "y"])
        text = leaks.normal("ab " * draw.randrange(9) + "".join(text) + " de" * draw.randrange(9))
        want = [(k, d) for k, t in items if (d := plain(t, text)) <= int(len(t) * leaks.RATE)]
        assert [k for k, _ in matcher.find(text)] == [k for k, _ in want]
    assert matcher.find(None) == matcher.find("") == [] and leaks.Matcher([(1, "")]).find("abc") == []


def test_query(spark):
    got = QUERIES["op8_benchmark_decontamination"](spark, "/root/testdata/sf0.001").collect()
    assert len(got) == 200 and 0 < sum(not r.kept for r in got) < 100
