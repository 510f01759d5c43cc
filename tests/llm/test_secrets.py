"""Secret scans against the plain patterns and plain window entropy."""

import hashlib
import math
import random
import re
from collections import Counter

from partita.llm import secrets
from partita.llm.queries import QUERIES

DIR = "/root/testdata/sf0.001"


def plain(text):
    out = [(m.start(), 0, "assign", m.end()) for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.A) if len(m[2]) >= 6]
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    base = sorted(out)
    for m in re.finditer(secrets.RUN, text):
        s = m[0]
        if re.search(secrets.ALLOWED, s):
            continue
        most = secrets.HEX_BITS if re.fullmatch("[0-9a-fA-F]+", s) else secrets.ALNUM_BITS if re.fullmatch("[A-Za-z0-9]+", s) else secrets.OTHER_BITS
        ends = [i + 20 for i in range(len(s) - 19) if -sum(c / 20 * math.log2(c / 20) for c in Counter(s[i : i + 20]).values()) >= most]
        if ends:
            out.append((m.start() + ends[0] - 20, 3, "entropy", m.start() + ends[-1]))
    line = lambda x: ",".join(f"{k}:{a}:{b}" for a, _, k, b in x)
    n = Counter(k for _, k, *_ in base)
    return n[0], n[1], n[2], hashlib.sha256(line(base).encode()).hexdigest(), line(sorted(out))


def test_against_plain(spark, tmp_path):
    given, draw = spark.read.parquet(f"{DIR}/documents.parquet"), random.Random(4)
    docs = [tuple(d) for d in given.collect()]
    odd = [None, "", "token=token: abcdefgh", "é API_KEY='abc' apikey: \"abcdef.\" PassWord=xyzxyz", "AKIAAKIA AKIA" + "A1" * 9, "f" * 23 + " " + "0f" * 14, "token = a_example_Zk39dkLLqm29xxPPw0"]
    odd += ["".join(draw.choice("aZ09kQx7PmR+/_=") for _ in range(draw.randrange(18, 90))) for _ in range(30)] + ["Zk39dkLLqm" * 300]
    docs += [(10**6 + i, t, None, None, 0) for i, t in enumerate(odd)]
    spark.createDataFrame(docs, given.schema).write.parquet(f"{tmp_path}/documents.parquet")
    want = {(d[0], *plain(d[1] or "")) for d in docs}
    assert {tuple(r) for r in QUERIES["op4_secret_scans"](spark, str(tmp_path)).collect()} == want
