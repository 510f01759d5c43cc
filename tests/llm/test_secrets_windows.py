"""Keys joined to a name by =, - or _ in secret scans."""

import math
import random
import re
from collections import Counter

from partita.llm import secrets


def plain(s):
    """The entropy span of a run: each window against the threshold of its own class."""
    whole = secrets.HEX_BITS if re.fullmatch("[0-9a-fA-F]+", s) else secrets.ALNUM_BITS if re.fullmatch("[A-Za-z0-9]+", s) else secrets.OTHER_BITS
    ends = []
    for i in range(len(s) - 19):
        w = s[i : i + 20]
        most = secrets.HEX_BITS if re.fullmatch("[0-9a-fA-F]+", w) else secrets.ALNUM_BITS if re.fullmatch("[A-Za-z0-9]+", w) else secrets.OTHER_BITS
        if re.fullmatch("[^A-Za-z]+|[^0-9A-Z]+|[^0-9a-z]+", w):
            most = whole
        if -sum(c / 20 * math.log2(c / 20) for c in Counter(w).values()) >= most:
            ends.append(i + 20)
    return f"entropy:{ends[0] - 20}:{ends[-1]}" if ends else ""


def spans(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r.spans for r in sorted(secrets.report(docs).collect(), key=lambda r: r.doc_id)]


def test_named_hex_keys(spark):
    draw = random.Random(8)
    texts = [name + "".join(draw.choice("0123456789ABCDEF") for _ in range(n)) for name in ("", "SIG=", "session-", "key_id=") for n in (20, 24, 32) for _ in range(12)]
    got = spans(spark, texts)
    assert got == [plain(t) for t in texts]
    assert sum(map(bool, got)) >= len(texts) - 2


def test_mixed_runs(spark):
    draw = random.Random(9)
    texts = ["".join(draw.choice(draw.choice(["0123456789", "ABCDEFGH", "abcdefghijkl", "-_=/", "XYZxyz019"])) * draw.randrange(1, 3) for _ in range(draw.randrange(10, 50))) for _ in range(80)]
    texts += ["order_31415926535897932384A", "item2=" + "unverhaeltnismaessigkeit", "Sig-" + "aZ3kQ9xL" * 4]
    texts = [t for t in texts if len(t) >= 20 and not re.search(secrets.ALLOWED, t) and t[0] not in "+/_=-"]
    assert [",".join(x for x in s.split(",") if x[:7] == "entropy") for s in spans(spark, texts)] == [plain(t) for t in texts]
