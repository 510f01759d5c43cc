"""Personal data against the plain patterns."""

import hashlib
import random
import re

from partita.llm import personal
from partita.llm.queries import QUERIES

DIR = "/root/testdata/sf0.001"


def plain(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if max(map(int, m[0].split("."))) <= 255]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in re.sub("[^0-9]", "", m[0])]
        if 13 <= len(d) <= 19 and sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(d[::-1])) % 10 == 0:
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def test_base_against_plain_patterns():
    draw = random.Random(2)
    for _ in range(20000):
        text = "".join(draw.choice("a1.@ -+(0é92") for _ in range(draw.randrange(60)))
        assert personal.base_spans(text) == plain(text), text


def test_query(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").collect()
    got = {r.doc_id: r for r in QUERIES["op6_pii"](spark, DIR).collect()}
    for d in docs:
        want = plain(d.text or "")
        line = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert got[d.doc_id].base_sha256 == hashlib.sha256(line.encode()).hexdigest()
        assert set(line.split(",")) <= set(got[d.doc_id].spans.split(","))


def test_held_out_precision_and_nulls(spark):
    trees, slope, offset, threshold = personal.model()
    x, y = personal.examples(3000, seed=99)
    chosen = 1 / (1 + 2.718281828459045 ** -(slope * personal.raw_score(trees, x) + offset)) >= threshold
    assert y[chosen].mean() > 0.97 and chosen[y == 1].mean() > 0.7
    docs = spark.createDataFrame([(1, None, 5, "x"), (None, "call 555-123-4567 now, a.b@c.de", 0, None), (3, "", 0, "")], "doc_id long, text string, n_chars long, spans string")
    assert len(personal.report(docs).collect()) == 3
    assert personal.stage(docs).collect()[1].text == "call [NUMBER] now, [EMAIL]"
