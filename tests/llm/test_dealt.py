"""The dealt operators against brute force."""

import re
from collections import Counter

import duckdb

from partita.llm import chat
from partita.llm.queries import ORACLE, QUERIES

DIR = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    words = WORD.findall(text or "")
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    many = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if many[g] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_quality_base(spark, tmp_path):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").collect()
    more = [(10**6 + i, t, None, None, 0) for i, t in enumerate([None, "", " \n", "a a a a a", "a b\na b\n\n", "é\x0bé x" * 40])]
    spark.createDataFrame([tuple(d) for d in docs] + more, spark.read.parquet(f"{DIR}/documents.parquet").schema).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in QUERIES["op1_quality_rules"](spark, str(tmp_path)).collect()}
    assert len(got) == len(docs) + len(more)
    for doc_id, text in [(d.doc_id, d.text) for d in docs] + [(m[0], m[1]) for m in more]:
        r, want = got[doc_id], brute(text)
        assert tuple(r[1:6]) == want, (doc_id, text)
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.kept and r.base_failed)


def test_chat_oracle(spark):
    db = duckdb.connect()
    db.execute(f"create view conversations as select * from '{DIR}/conversations.parquet'")
    want = db.execute(ORACLE["op10_chat_formatting"]).fetchall()
    assert sorted(map(tuple, QUERIES["op10_chat_formatting"](spark, DIR).collect())) == sorted(want)


def test_chat_round_trip_and_edits(spark):
    turns = [("user", "a\\<s>[INST] </s>\n"), ("assistant", ""), ("", "]\\")]
    assert chat.parse(chat.render(turns)[0]) == turns
    log = [(1, 0, 0, "open", "assistant", "x"), (1, 0, 1, "delta", None, "y"), (1, 0, 2, "regen", None, None), (1, 0, 3, "delta", None, "z"), (1, 1, 0, "open", "user", None), (1, 1, 1, "edit", None, "q")]
    out = chat.formatted(spark.createDataFrame(log, "conv_id long, msg long, seq long, op string, role string, payload string")).collect()
    assert chat.parse(out[0].formatted) == [("assistant", "z"), ("user", "q")]
