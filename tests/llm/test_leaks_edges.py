"""Short items and blocks of items in decontamination."""

from partita.llm import leaks

LONG = "which of the seven rivers of the northern plain reaches the sea first"


def test_short_items_match_exactly_at_word_bounds():
    matcher = leaks.Matcher([(1, "what is 2+2?"), (2, "art"), (3, LONG), (4, "(c)")])
    assert matcher.find("So: What  is\n2+2? Yes.") == [(1, 0)]
    assert matcher.find("what is 2+3?") == matcher.find("a party starts") == matcher.find("cart art_s") == []
    assert matcher.find("a party; art") == [(2, 0)]
    assert matcher.find("x(c)y") == [(4, 0)]
    assert matcher.find(LONG.replace("seven", "sevan")) == [(3, 1)]


def test_blocks_give_the_same_rows(spark, monkeypatch):
    items = spark.createDataFrame([(k, f"{LONG} number {k} {'xyz' * k}") for k in (2, 11, 7, 9, 1)] + [(5, "which of the seven")], "item_id long, text string")
    texts = [f"{LONG} number 9 {'xyz' * 9}", f"{LONG} number 11 {'xyz' * 11} so", "nothing", None]
    rows = [(k, t) for k in (1, 1, None, 2) for t in texts]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    plain = lambda: sorted(map(str, leaks.matches(docs, items).collect()))
    want = plain()
    assert len(want) == len(rows) and any("items='1,2,5,7,9'" in x for x in want)
    for size in (2, 3, 6):
        monkeypatch.setattr(leaks, "BLOCK", size)
        assert plain() == want
