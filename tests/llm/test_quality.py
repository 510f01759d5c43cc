"""The quality rules' fences on sources with junk."""

from partita.llm import quality

SCHEMA = "doc_id long, text string, lang string, source string"


def words(k, n):
    return [f"w{k}x{i}" for i in range(n)]


def marked(k, n):
    return " ".join([w + "#" * (i < n) for i, w in enumerate(words(k, 100))])


def verdicts(spark, rows):
    docs = spark.createDataFrame([(k, t, "en", s) for k, (t, s) in enumerate(rows)], SCHEMA)
    return [r.kept for r in sorted(quality.report(docs).collect(), key=lambda r: r.doc_id)]


def test_junk_does_not_raise_its_own_fence(spark):
    clean = [" ".join(words(k, 60)) for k in range(210)]
    junk = [" ".join(f"#{w}%" for w in words(1000 + k, 60)) + " $" * (k % 40) for k in range(90)]
    assert verdicts(spark, [(t, "hot") for t in clean + junk]) == [True] * 210 + [False] * 90


def test_fence_tightens_where_the_group_shows_it(spark):
    # the group's symbols a word lie near 0.06, so that 0.25 is far out, though under the floor
    usual = [marked(k, 4 + k % 5) for k in range(220)]
    assert verdicts(spark, [(t, "s") for t in [*usual, marked(900, 25)]])[-1] is False
    assert verdicts(spark, [(t, "s") for t in usual]) == [True] * 220


def test_repeated_lines_of_ordinary_length(spark):
    # 11 of 30 lines repeat a line of seven words; longer lines keep the share of repeated words low
    def text(k, again):
        long = [" ".join(words(100 * k + i, 30)) for i in range(18)]
        short = ["the same seven words on a line"] * 12 if again else [" ".join(words(100 * k + 50 + i, 7)) for i in range(12)]
        return "\n".join(long + short)

    assert verdicts(spark, [(text(k, k == 3), "s") for k in range(5)]) == [True, True, True, False, True]


def test_thresholds_change_smoothly_with_a_groups_rows(spark):
    hot = [(marked(k, [1, 2, 3, 5, 8, 12, 18, 25, 30, 38][k % 10]), "hot") for k in range(600)]
    usual = [(marked(1000 + k, 4 + k % 5), "s") for k in range(199)]
    probe = [(marked(2000, 20), "s"), (marked(2001, 20), "small")]
    at = [verdicts(spark, hot + usual[:n] + probe)[-2:] for n in (198, 199)]
    assert at == [[False, True], [False, True]]
