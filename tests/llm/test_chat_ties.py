"""Chat formatting of tied, repeated and null turns."""

import hashlib

from partita.llm import chat


def test_ties_keep_their_texts(spark):
    long_a, long_b = "a" * 150, "b" * 150
    rows = [(1, 0, "user", long_b), (1, 0, "assistant", long_a), (1, 0, "user", long_b), (1, 1, "assistant", "x"), (1, 1, "assistant", "y")]
    rows += [(1, None, "user", "later " * 30), (1, None, "assistant", "last " * 30), (2, None, None, None), (2, None, None, None), (None, 0, "user", "q")]
    docs = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    want = {
        1: [("assistant", long_a), ("user", long_b), ("user", long_b), ("assistant", "x"), ("assistant", "y"), ("assistant", "last " * 30), ("user", "later " * 30)],
        2: [("", ""), ("", "")],
        None: [("user", "q")],
    }
    made = {r.conv_id: r for r in chat.formatted(chat.events(docs)).collect()}
    assert {k: chat.parse(r.formatted) for k, r in made.items()} == want
    said = {r.conv_id: (r.n_turns, r.loss_sha256) for r in chat.report(docs).collect()}
    assert said == {k: (len(v), hashlib.sha256("".join(t for r, t in v if r == "assistant").encode()).hexdigest()) for k, v in want.items()}
