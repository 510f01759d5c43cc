"""Cases of the second round's findings: each failed before its change."""

import duckdb
import pytest

from partita.operators import joins
from partita.plans import registry, special


def test_word_parts_of_texts_with_one_word(spark, tmp_path):
    rows = [(1, "banana", "en", "a", 6), (2, "one banana", "en", "a", 10), (3, None, "en", "a", 0), (4, "", "en", "a", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.parts for r in special.word_parts(spark, str(tmp_path)).collect()}
    assert got == {1: None, 2: "ba-na-na", 3: None, 4: None}


def test_matching_rows_rounds_as_its_sql(spark):
    rows = [(i, [x] * 8, label) for i, (x, label) in enumerate([(-0.04, 1), (0.04, 0), (0.25, 1), (0.35, 0), (0.449999988079071, 0), (0.3, 0), (0.4, 1), (0.15000000596046448, 0), (0.05, 0), (-0.25, 1), (float("nan"), 1)])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    db = duckdb.connect()
    values = ", ".join(f"({i}, {[str(x) for x in e]}::float[], {label})" for i, e, label in rows)
    db.execute(f"create table embeddings as select * from (values {values}) t(vec_id, embedding, label)")
    assert joins.matching_rows(v).collect()[0].n == db.execute(registry.ORACLE["matching_rows"]).fetchone()[0]


def test_note_sequences_round_as_their_sql(spark, tmp_path):
    """An end 291 ticks of 960 in: 0.303125 s, which its SQL rounds down."""
    from partita.sources import midi, sequences

    db = duckdb.connect()
    notes = spark.createDataFrame([("1", 0, 0, 291, 0, 60, 64)], "path string, track int, onset int, dur int, channel int, pitch int, velocity int")
    spark.createDataFrame([(1, 1, 1, 1, 251.0, 1.0, None)], "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_shipdate timestamp_ntz").write.parquet(f"{tmp_path}/lineitem.parquet")
    db.execute(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet/*.parquet'")
    names = "seq_id, n, n_tempos, total_time"
    want = db.execute(f"select {names} from ({special.ORACLE['note_sequences']}) t").fetchall()
    assert [tuple(r) for r in special.note_sequences(spark, str(tmp_path)).select(*names.split(", ")).collect()] == want
    assert sequences.note_sequences(midi.decoded(midi.encoded(midi.opus_of(notes)))).count() == 1


def test_files_are_encoded_as_one_by_one(spark):
    """Files of all kinds of events, in batches of many files, against the plain encoder."""
    from partita.sources import midi

    def events(k):
        return [(0, "set_tempo", None, None, 500000 + k, None), (k * 127, "note_on", k % 18, 60 + k % 70, 64, None), (16384, "note_on", k % 18, 61, 0, None), (2**21 * (k % 2), "pitch_wheel_change", 2, None, k - 8192, None), (3, "patch_change", 2, 5, None, None), (0, "channel_after_touch", 2, None, 9, None)] + [(5, "lyric", None, None, None, b"la")] * (k % 3 == 0) + [(7, "text_event", None, None, None, b"")] * (k % 5 == 0)

    files = {None if k == 7 else f"f{k}": {t: events(k + t) for t in range(k % 4)} for k in range(200)}
    rows = [(p, 480, t, i, *e) for p, tracks in files.items() for t, es in (tracks.items() or [(None, [(None,) * 6])]) for i, e in enumerate(es)]
    frame = spark.createDataFrame(rows, "path string, ticks int, track int, idx int, dtime long, kind string, channel int, num int, value int, data binary")
    got = {r.path: bytes(r.content) for r in midi.encoded(frame.repartition(5)).collect()}
    assert got == {p: midi.encode(480, [tracks[t] for t in sorted(tracks)]) for p, tracks in files.items()}
    from pyspark.sql import functions as F

    parts = midi.decoded(midi.encoded(frame)).where("track is not null").groupBy("path").agg(F.count("*").alias("n"))
    assert {r.path: r.n for r in parts.collect()} == {p: n for p, tracks in files.items() if (n := sum(map(len, tracks.values())))}


def test_detect_beat_makes_no_row_for_each_note_and_grid_cell(spark):
    from partita.operators import stats

    rows = [(s, o) for s in range(30) for o in [(s * k * k) % 23 for k in range(1 + s % 6)]] + [(99, None)]
    notes = spark.createDataFrame(rows, "seq_id long, onset int")
    got = stats.detect_beat(notes)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Window" not in plan
    values = ", ".join(f"({s}, {'null' if o is None else o})" for s, o in rows)
    db = duckdb.connect()
    db.execute(f"create table notes as select * from (values {values}) t(seq_id, onset)")
    from partita.operators import DUCK

    want = db.execute(stats.detect_beat.text(DUCK).format(notes="notes")).fetchall()
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_chords_of_many_sequences_are_those_of_each(spark):
    import numpy as np

    from partita.operators import inference

    draw = np.random.default_rng(3)
    near = 100 * draw.random((25, 6, len(inference.chord_names()))).round(1)
    want = np.stack([inference.key_chord_path(x, 0.01, 0.001, 0.5) for x in near])
    assert (inference.key_chord_paths(near, 0.01, 0.001, 0.5) == want).all()
    rows = [(s, f, int(pc), float(w)) for s in range(40) for f in range(s % 3, s % 3 + 1 + s % 5) for pc, w in zip(draw.choice(12, 3, replace=False), draw.integers(1, 9, 3), strict=True)]
    got = {}
    for r in inference.infer_chords(spark.createDataFrame(rows, "seq_id long, frame long, pc int, weight double")).collect():
        got.setdefault(r.seq_id, []).append((r.frame, r.key, r.chord))
    for s in range(40):
        frames = sorted({f for q, f, *_ in rows if q == s})
        v = np.zeros((len(frames), 12))
        for q, f, pc, w in rows:
            if q == s:
                v[f - frames[0], pc] += w
        found = inference.chords_of_frames(v / np.sqrt((v**2).sum(axis=1, keepdims=True)))
        assert sorted(got[s]) == [(frames[0] + i, k, c) for i, (k, c) in enumerate(found) if i == 0 or c != found[i - 1][1]]


def test_similar_songs_deals_no_pairs(spark):
    from partita.operators import DUCK

    rows = [(s, p, (s * p * p + s // 7) % 5) for s in range(250) for p in range(1, 2 + s % 7)]
    got = joins.similar_songs(spark.createDataFrame(rows, "seq_id long, pos long, pitch int"))
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
    db = duckdb.connect()
    db.execute(f"create table notes as select * from (values {', '.join(map(str, rows))}) t(seq_id, pos, pitch)")
    assert sorted(tuple(r) for r in got.collect()) == sorted(db.execute(joins.similar_songs.text(DUCK).format(notes="notes")).fetchall())


def test_alike_compares_in_order_only_what_can_reach_the_threshold(monkeypatch):
    import random
    from difflib import SequenceMatcher

    from partita.functions import text

    draw = random.Random(5)
    words = ["".join(draw.choice("abcd ") for _ in range(draw.randint(1, 14))) for _ in range(60)]
    want = [x == y or (abs(len(x) - len(y)) / max(len(x), len(y)) <= 0.25 and SequenceMatcher(None, x, y).ratio() >= 0.75) for x in words for y in words]
    assert [text.alike(x, y, 0.75) for x in words for y in words] == want
    monkeypatch.setattr(text, "SequenceMatcher", None)
    assert not text.alike("abcdefgh", "abcdwxyz", 0.85)


def test_least_edges_of_a_tile():
    import numpy as np

    from partita.operators import vectors

    draw = np.random.default_rng(2)
    a, b = draw.permutation(40), draw.permutation(60)
    dist = draw.integers(0, 9, (40, 60)) / 8.0
    dist[:5] = np.inf
    low, high = np.minimum(a[:, None], b[None, :]), np.maximum(a[:, None], b[None, :])
    want = np.lexsort((high, low, dist), axis=1)[:, 0]
    got = vectors._least(dist, a, b)
    i = np.arange(40)
    assert (dist[i, got] == dist[i, want]).all() and (got[5:] == want[5:]).all()


def test_alike_titles_are_those_of_all_documents(spark, tmp_path):
    """Short, long, equal and empty titles, and pairs whose longest shared run is two characters, against all pairs."""
    import random

    from partita.functions import text

    draw = random.Random(3)
    titles = ["abxcdef", "abcdyef", "", "", "a", "a", None, "Zoë", "zoe", "Zoe!", "xy 1 zw", "naïve", "x" * 600, "x" * 599 + "y"]
    for n in (5, 9, 40, 63, 64, 65, 130, 210, 700):
        for _ in range(4):
            base = "".join(draw.choice("abcde fgh") for _ in range(n))
            titles.append(base)
            for _ in range(3):
                titles.append("".join(c if draw.random() > 0.06 else draw.choice(["", "k", c + "m"]) for c in base))
    rows = [(i, None if t is None else f"{t}. and more\nlines", "en", "a", 0) for i, t in enumerate(titles)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    clean = {i: text.clean_title(t) for i, t in enumerate(titles) if t is not None}
    rep = {}
    for i, t in sorted(clean.items()):
        rep.setdefault(t, i)
    want = {(rep[t], i, True) for i, t in clean.items() if rep[t] != i}
    classes = sorted(rep.values())
    want |= {(a, b, False) for a in classes for b in classes if a < b and (text.alike(clean[a], clean[b], 0.85) or text.alike(clean[b], clean[a], 0.85))}
    got = [tuple(r) for r in special.alike_titles(spark, str(tmp_path)).collect()]
    assert set(got) == want and len(got) == len(want) and (0, 1, False) in want and sum(not s for *_, s in want) > 30
    docs = spark.createDataFrame(list(clean.items()), "id long, clean string")
    assert {tuple(r) for r in text.alike_texts(docs, rows=30, letters=3000).collect()} == want


def test_spanning_tree_compares_all_pairs_once(spark, monkeypatch):
    """Blocks and tiles of a few rows, ties, copies and zeros: the least tree in the order of (dist, a, b), and no pair compared in several rounds."""
    import numpy as np

    from partita.operators import vectors

    rng = np.random.default_rng(4)
    x = rng.integers(-2, 3, (90, 3)).astype(float)
    ids = rng.permutation(500)[:90]
    frame = spark.createDataFrame([(int(i), v.tolist(), 0) for i, v in zip(ids, x, strict=True)] + [(900, None, 0), (901, [1.0], 0), (902, [2.0], 0)], "vec_id long, embedding array<float>, label int")
    dist = vectors._distances(x, x, ids, ids)
    edges = sorted((dist[i, j], *sorted((int(ids[i]), int(ids[j])))) for i in range(90) for j in range(i))
    root = {int(i): int(i) for i in ids}
    want = {(901, 902, 0.0)}
    for d, a, b in edges:
        if root[a] != root[b]:
            want.add((a, b, float(d)))
            old, new = root[a], root[b]
            root = {k: new if r == old else r for k, r in root.items()}
    made = []
    monkeypatch.setattr(vectors, "_edges", lambda *given, f=vectors._edges: made.append(given) or f(*given))
    for last in (1 << 18, 60):
        got = [tuple(r) for r in vectors.spanning_tree(frame, rows=25, tile=8, last=last).collect()]
        assert len(got) == len(want) == 90 and set(got) == want
    assert len(made) == 2
