"""Queries whose operators work in frames or Arrow batches; an oracle where SQL can say the result."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from partita import streaming
from partita.functions import text, theory
from partita.operators import basics, inference, joins, mining, vectors
from partita.operators.iterate import shared_folder
from partita.plans.registry import VIEWS, view
from partita.sources import datasets, midi, musicxml, sequences

_NOTES = "notes as (" + VIEWS["notes"].replace("{lineitem}", "lineitem") + ")"
_PAIRS = """fp as (select a.seq_id, a.channel, a.pitch, a.on_, b.off_ - a.on_ as dur, a.velocity from (select *, onset * 40 as on_, row_number() over (partition by seq_id, channel, pitch order by onset, velocity) as k from notes) a
 join (select seq_id, channel, pitch, onset * 40 + dur as off_, row_number() over (partition by seq_id, channel, pitch order by onset * 40 + dur) as k from notes) b on a.seq_id = b.seq_id and a.channel = b.channel and a.pitch = b.pitch and a.k = b.k)"""


def _notes(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "notes")


def _opus(spark, sf) -> DataFrame:
    """Events of one file a sequence: channels as tracks, onsets 40 ticks apart."""
    notes = _notes(spark, sf).select(F.col("seq_id").cast("string").alias("path"), F.col("channel").alias("track"), (F.col("onset") * 40).alias("onset"), "dur", "channel", "pitch", "velocity")
    return midi.opus_of(notes)


def _tempos(spark, sf) -> DataFrame:
    """The same with a tempo at each first note of an onset whose pitch four divides."""
    found = _notes(spark, sf).where("pitch % 4 = 0").groupBy(F.col("seq_id").cast("string").alias("path"), (F.col("onset") * 40).cast("long").alias("tick")).agg(F.max("pitch").alias("p"))
    rows = found.select("path", F.lit(480).alias("ticks"), F.lit(-1).alias("track"), F.lit(0).alias("idx"), F.lit(0).cast("long").alias("dtime"), "tick", F.lit("set_tempo").alias("kind"), F.lit(None).cast("int").alias("channel"), F.lit(None).cast("int").alias("num"), (400_000 + 1000 * F.col("p")).cast("int").alias("value"))
    notes = _notes(spark, sf).select(F.col("seq_id").cast("string").alias("path"), F.lit(480).alias("ticks"), F.lit(0).alias("track"), F.col("pos").cast("int").alias("idx"), F.lit(0).cast("long").alias("dtime"), (F.col("onset") * 40).cast("long").alias("tick"), F.lit("note_on").alias("kind"), "channel", F.col("pitch").alias("num"), F.col("velocity").alias("value"))
    return notes.unionByName(rows)


_MAP = """t as (select seq_id, onset * 40 as tick, 400000 + 1000 * max(pitch) as tempo from notes where pitch % 4 = 0 group by seq_id, onset),
 z as (select seq_id, 0 as tick, 500000 as tempo from (select distinct seq_id from notes) s union all select * from t),
 y as (select * from (select *, lag(tempo) over (partition by seq_id order by tick) as was from z) q where was is null or was <> tempo),
 m as (select seq_id, tick, tempo, sum(part) over (partition by seq_id order by tick rows between unbounded preceding and current row) as ms from (
 select *, coalesce((tick - lag(tick) over (partition by seq_id order by tick)) * lag(tempo) over (partition by seq_id order by tick) / 480000.0::double, 0) as part from y) p)"""


def midi_round_trip(spark, sf):
    return joins.paired(midi.decoded(midi.encoded(_opus(spark, sf)))).select(F.col("path").cast("long").alias("seq_id"), "channel", "pitch", "onset", "dur", "velocity")


def midi_event_kinds(spark, sf):
    return midi.decoded(midi.encoded(_opus(spark, sf))).groupBy("kind").agg(F.count("*").alias("n"))


def midi_without_offs(spark, sf):
    return midi.decoded(midi.encoded(_opus(spark, sf)), exclude=["note_off", "set_tempo"]).groupBy(F.col("path").cast("long").alias("seq_id")).agg(F.count("track").alias("n"))


def pairs_that_close_all(spark, sf):
    return joins.paired(_opus(spark, sf).withColumn("tick", F.expr("sum(dtime) over (partition by path, track order by idx)")), "all").select(F.col("path").cast("long").alias("seq_id"), "channel", "pitch", "onset", "dur", "velocity")


def tempo_map(spark, sf):
    return joins.tempo_map(_tempos(spark, sf)).select(F.col("path").cast("long").alias("seq_id"), "tick", "tempo", F.round("ms", 4).alias("ms"))


def to_millis(spark, sf):
    return joins.to_millis(_tempos(spark, sf)).where("kind = 'note_on'").select(F.col("path").cast("long").alias("seq_id"), F.col("idx").alias("pos"), F.round("ms", 4).alias("ms"))


def to_ticks(spark, sf):
    events = _tempos(spark, sf)
    timed = joins.to_millis(events).where("kind = 'note_on'").select("path", "idx", "ms")
    return joins.to_ticks(timed, joins.tempo_map(events)).select(F.col("path").cast("long").alias("seq_id"), F.col("idx").alias("pos"), "tick")


def ms_notes(spark, sf):
    return sequences.ms_notes(_opus(spark, sf).withColumn("tick", F.expr("sum(dtime) over (partition by path, track order by idx)"))).groupBy(F.col("path").cast("long").alias("seq_id")).agg(F.count("*").alias("n"), F.min("onset").alias("first"))


def note_sequences(spark, sf):
    events = midi.decoded(midi.encoded(_opus(spark, sf)))
    return sequences.note_sequences(events).select(F.col("path").cast("long").alias("seq_id"), F.size("notes").alias("n"), F.size("tempos").alias("n_tempos"), (F.round(F.col("total_time") * 1e5) / 1e5).alias("total_time"))


def instruments(spark, sf):
    events = _opus(spark, sf)
    return sequences.instruments(events).select(F.col("path").cast("long").alias("seq_id"), "channel", "program", F.col("drum").cast("int").alias("drum"), "n")


def number_rows(spark, sf):
    notes = _notes(spark, sf).select(F.col("seq_id").cast("string").alias("path"), "onset", "dur", "channel", "pitch", "velocity")
    back = sequences.notes_of_rows(sequences.number_rows(notes))
    return back.select(F.col("path").cast("long").alias("seq_id"), "onset", "dur", "channel", "pitch", "velocity")


def cropped_rows(spark, sf):
    notes = _notes(spark, sf).select(F.col("seq_id").cast("string").alias("path"), "onset", "dur", "channel", "pitch", "velocity")
    return sequences.cropped_rows(sequences.number_rows(notes), 8).select(F.col("path").cast("long").alias("seq_id"), F.size("rows").alias("n"))


def wrapped_notes(spark, sf):
    events = _opus(spark, sf).withColumn("tick", F.expr("sum(dtime) over (partition by path, track order by idx)"))
    return sequences.notes_of(events).groupBy("channel").agg(F.count("*").alias("n"), F.sum("dur").alias("dur"))


def files_read_safely(spark, sf):
    files = midi.encoded(_opus(spark, sf)).withColumn("content", F.when(F.col("path").endswith("7"), F.lit(b"broken")).otherwise(F.col("content")))
    return sequences.safely(files).select(F.col("path").cast("long").alias("seq_id"), "n_events", F.col("corrupt").cast("int").alias("corrupt"))


def merged_scores(spark, sf):
    notes = _notes(spark, sf).select((F.col("seq_id") / 4).cast("long").alias("piece"), (F.col("seq_id") % 4).alias("score"), "channel", "pos", "pitch")
    return sequences.merged(notes).groupBy("piece").agg(F.countDistinct("score", "channel").alias("n_tracks"), F.count("*").alias("n"))


def same_ticks(spark, sf):
    notes = _notes(spark, sf).select((F.col("seq_id") / 2).cast("long").alias("piece"), "seq_id", "pos", F.expr("cast(120 * (1 + seq_id % 2) as int)").alias("ticks"), F.col("onset").cast("long").alias("onset"), F.col("dur").cast("long").alias("dur"))
    return sequences.same_ticks(notes).select("seq_id", "pos", "ticks", "onset", "dur")


def asof_chord(spark, sf):
    states = view(spark, sf, "states").where("kind = 'chord'").groupBy("seq_id", "time").agg(F.max("value").alias("state"))
    return joins.asof_join(_notes(spark, sf), states, ["seq_id"], "onset", "time", ["state"]).select("seq_id", "pos", "state")


def near_ends(spark, sf):
    left = _notes(spark, sf).selectExpr("seq_id", "pos", "onset + dur as t")
    right = _notes(spark, sf).selectExpr("seq_id", "pos", "onset as t")
    return joins.band_join(left, right, ["seq_id"], "t", "t", 3).select(F.col("l.seq_id").alias("seq_id"), F.col("l.pos").alias("a"), F.col("r.pos").alias("b"))


def overlapping_notes(spark, sf):
    spans = _notes(spark, sf).selectExpr("seq_id", "pos", "onset", "onset + dur as stop")
    return joins.overlap_join(spans, spans, ["seq_id"], 16).where("l.pos < r.pos").select(F.col("l.seq_id").alias("seq_id"), F.col("l.pos").alias("a"), F.col("r.pos").alias("b"))


def _chords(spark, sf):
    return _notes(spark, sf).groupBy("seq_id", "onset").agg(F.array_sort(F.collect_set("pitch")).alias("pitches"))


def chord_symbols(spark, sf):
    return theory.name_chords(_chords(spark, sf)).select("seq_id", "onset", "symbol")


def chord_dimension(spark, sf):
    rows = [(r, k, " ".join(map(str, p)), q) for r, k, p, q in theory.chord_dimension()]
    return spark.createDataFrame(rows, "root string, kind string, tones string, quality string")


def spelled_chords(spark, sf):
    names = F.transform("pitches", lambda p: F.get(F.array(*[F.lit(x) for x in ("c", "c#", "d", "eb", "e", "f", "f#", "g", "ab", "a", "bb", "b")]), (p % 12).cast("int")))
    return theory.recognised(_chords(spark, sf).select("seq_id", "onset", F.array_distinct(names).alias("notes"))).select("seq_id", "onset", "name")


def spelled_scales(spark, sf):
    names = F.transform("pitches", lambda p: F.get(F.array(*[F.lit(x) for x in ("c", "db", "d", "eb", "e", "f", "f#", "g", "ab", "a", "bb", "b")]), (p % 12).cast("int")))
    return theory.recognised(_notes(spark, sf).groupBy("seq_id").agg(F.array_sort(F.collect_set("pitch")).alias("pitches")).select("seq_id", F.array_distinct(names).alias("notes")), "scale")


def spelled_intervals(spark, sf):
    rows = [([a, b],) for a in ("c", "d", "f#", "bb") for b in ("c", "e", "g", "ab", "b", "c#")]
    return theory.recognised(spark.createDataFrame(rows, "notes array<string>"), "interval").select(F.array_join("notes", " ").alias("notes"), "name")


def hz_columns(spark, sf):
    n = _notes(spark, sf).select("pitch").distinct()
    return n.select("pitch", F.round(theory.hz_to_note_number(theory.note_number_to_hz(F.col("pitch"))), 4).alias("back"), theory.note_name_to_number(theory.note_number_to_name(F.col("pitch"))).cast("int").alias("named"))


def _tokens(spark, sf):
    return mining.tokens_of(_notes(spark, sf).withColumn("pitch", F.col("pitch") % 4))


def frequent_patterns(spark, sf):
    return mining.frequent_patterns(_tokens(spark, sf), 0.05).select(F.array_join(F.transform("pattern", lambda x: x.cast("string")), " ").alias("pattern"), "support")


def learned_pairs(spark, sf):
    codes, _ = mining.learn_pairs(_tokens(spark, sf), most=6)
    return spark.createDataFrame([(i, *c) for i, c in enumerate(codes)], "rank int, a int, b int, new int")


def pairs_and_back(spark, sf):
    tokens = _tokens(spark, sf)
    codes, merged = mining.learn_pairs(tokens, most=6)
    return mining.decode_pairs(merged, codes).select("seq_id", F.array_join(F.transform("tokens", lambda x: x.cast("string")), " ").alias("tokens"))


def encoded_and_back(spark, sf):
    tokens = _tokens(spark, sf)
    codes = [(0, 1, 4), (4, 2, 5), (1, 1, 6), (3, 3, 7)]
    return mining.decode_pairs(mining.encode_pairs(tokens, codes), codes).select("seq_id", F.array_join(F.transform("tokens", lambda x: x.cast("string")), " ").alias("tokens"))


def retokenized(spark, sf):
    return mining.retokenize(_tokens(spark, sf), [(0, 1, 4), (4, 2, 5)]).select("seq_id", F.size("tokens").alias("n"), F.size(F.filter("tokens", lambda x: x >= 4)).alias("n_merged"))


def repeated_patterns(spark, sf):
    return mining.repeating_patterns(_tokens(spark, sf), 2).select("seq_id", F.array_join(F.transform("pattern", lambda x: x.cast("string")), " ").alias("pattern"), F.size("starts").alias("n"))


def negatives(spark, sf):
    return mining.corrupted(_tokens(spark, sf)).select("seq_id", F.size("tokens").alias("n"), "mode")


def chain_json(spark, sf):
    return mining.chain_json(mining.chain_counts(_notes(spark, sf).withColumn("pitch", F.col("pitch") % 4), size=1))


def chain_walks(spark, sf):
    sums = mining.chain_sums(_notes(spark, sf).withColumn("pitch", F.col("pitch") % 4), size=2)
    return mining.walks(sums, mining.starts(spark, 20), 2, most=6).select("walk", F.array_join("tokens", " ").alias("tokens"), F.col("done").cast("int").alias("done"))


def translation_counts(spark, sf):
    pairs = _tokens(spark, sf).select(F.transform("tokens", lambda x: x.cast("string")).alias("made"), F.reverse(F.transform("tokens", lambda x: x.cast("string"))).alias("wanted"))
    return mining.bleu_counts(pairs, 2)


def nearest_neighbours(spark, sf):
    v = view(spark, sf, "vectors")
    return vectors.nearest(v.where("vec_id % 50 = 0"), v, 3).select("a", "b", F.round("sim", 4).alias("sim"), "rk")


def spanning_tree(spark, sf):
    return vectors.spanning_tree(view(spark, sf, "vectors")).select("a", "b", F.round("dist", 5).alias("dist"))


def principal_components(spark, sf):
    return vectors.pca(view(spark, sf, "vectors"))


def inferred_chords(spark, sf):
    frames = _notes(spark, sf).groupBy("seq_id", F.col("onset").cast("long").alias("frame"), (F.col("pitch") % 12).alias("pc")).agg(F.sum("dur").cast("double").alias("weight"))
    return inference.infer_chords(frames)


def inferred_melody(spark, sf):
    return inference.infer_melody(_notes(spark, sf))


def harmonised(spark, sf):
    allowed = [tuple(sorted((r + i) % 12 for i in p)) for r in range(12) for p in ((0, 4, 7), (0, 3, 7), (0, 4), (0, 3), (0, 7), (0,))]
    return inference.harmonise(_tokens(spark, sf), allowed).select("seq_id", F.array_join("chords", "|").alias("chords"))


def estimated_tempi(spark, sf):
    return inference.estimate_tempi(_notes(spark, sf).select("seq_id", (F.col("onset") * 0.3).alias("time")))


def _measure() -> F.Column:
    names = F.get(F.array(*[F.lit(x) for x in ("C", "C", "D", "D", "E", "F", "F", "G", "G", "A", "A", "B")]), (F.col("pitch") % 12).cast("int"))
    alter = F.when((F.col("pitch") % 12).isin(1, 3, 6, 8, 10), "<alter>1</alter>").otherwise("")
    return F.concat(F.lit("<note><pitch><step>"), names, F.lit("</step>"), alter, F.lit("<octave>"), (F.floor(F.col("pitch") / 12) - 1).cast("string"), F.lit("</octave></pitch><duration>"), F.col("dur").cast("string"), F.lit("</duration></note>"))


def scores_round_trip(spark, sf):
    """Sequences written as scores, read back: notes after each other."""
    one = _notes(spark, sf).withColumn("m", _measure()).groupBy("seq_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda x: x["m"]), "").alias("body"))
    files = one.select(F.col("seq_id").cast("string").alias("path"), F.concat(F.lit('<score-partwise><part id="P1"><measure number="1"><attributes><divisions>1</divisions></attributes>'), "body", F.lit("</measure></part></score-partwise>")).cast("binary").alias("content"))
    return musicxml.decoded(files).select(F.col("path").cast("long").alias("seq_id"), F.col("pos").cast("long").alias("pos"), "onset", "dur", "pitch")


def cut_chunks(spark, sf):
    return datasets.cut_chunks(_tokens(spark, sf).withColumnRenamed("tokens", "chunk"), 6).select("seq_id", F.size("chunk").alias("n"))


def healed_notes(spark, sf):
    return basics.healed(_notes(spark, sf))[1]


def clean_titles(spark, sf):
    return text.with_titles(view(spark, sf, "docs").select("doc_id", F.element_at(F.split("text", r"[.\n]"), 1).alias("title"))).select("doc_id", "clean")


def clean_artists(spark, sf):
    return text.with_artists(view(spark, sf, "docs").select("doc_id", F.array_join(F.slice(F.split("text", " "), 1, 3), " ").alias("artist"))).select("doc_id", "clean")


def file_names(spark, sf):
    return text.with_names(view(spark, sf, "docs").select("doc_id", F.concat("source", F.lit("/"), "lang", F.lit(" - "), F.col("doc_id").cast("string"), F.lit(".mid")).alias("path"))).select("doc_id", "name.artist", "name.title")


def alike_titles(spark, sf):
    """Titles of all documents: members of classes of equal ones, and classes that are alike."""
    return text.alike_texts(text.with_titles(view(spark, sf, "docs").select(F.col("doc_id").alias("id"), F.element_at(F.split("text", r"[.\n]"), 1).alias("title"))).select("id", "clean"))


def sentence_counts(spark, sf):
    return text.with_sentences(view(spark, sf, "docs").where("text is not null")).select("doc_id", F.size("sentences").alias("n"))


def parted_words(spark, sf):
    words = ["the", "in", "an", "on", "re", "er", "th", "st", "es", "en", "ti", "at", "nd", "he", "a", "s", "t", "e", "o", "n", "i", "r"]
    return text.split_words(view(spark, sf, "docs").select("doc_id", F.lower(F.element_at(F.split("text", " "), 1)).alias("text")), words).select("doc_id", F.array_join("words", " ").alias("words"))


def word_parts(spark, sf):
    return text.with_syllables(view(spark, sf, "docs").select("doc_id", F.lower(F.get(F.split("text", " "), 1)).alias("word"))).select("doc_id", F.array_join("parts", "-").alias("parts"))


def page_ranks(spark, sf):
    """The best page of each of two sources of urls for a query: no list pages first, then by score."""
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", F.col("url").alias("title"), F.col("html").alias("extract"))
    scored = pages.select("page_id", F.col("page_id") % 5, text.page_score(F.col("title"), F.col("extract"), "the", "html").alias("score"), text.is_disambiguation(F.col("title"), F.col("extract")).alias("listed"))
    return scored.groupBy((F.col("page_id") % 5).alias("part")).agg(F.min_by("page_id", F.struct("listed", -F.col("score"), "page_id")).alias("best"), F.max("score").alias("score"))


def search_texts(spark, sf):
    docs = view(spark, sf, "docs").select("doc_id", text.search_queries(F.col("source"), F.col("lang")).alias("q"))
    return docs.select("doc_id", F.explode("q").alias("q"))


def _streamed(spark, sf, make, mode: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    return streaming.run_once(make(streaming.read_events(spark, f"{sf}/events.parquet")), f"{folder}/out", f"{folder}/state", mode)


def stream_tumbling(spark, sf):
    return _streamed(spark, sf, streaming.tumbling, "complete")


def stream_sliding(spark, sf):
    return _streamed(spark, sf, streaming.sliding, "complete")


def stream_sessions(spark, sf):
    return _streamed(spark, sf, streaming.sessions, "complete")


def stream_distinct(spark, sf):
    return _streamed(spark, sf, lambda e: streaming.distinct_events(e, ("event_id",), "60 days"), "append").select("event_id", "user_id", "event_type")


def stream_users(spark, sf):
    users = spark.read.parquet(f"{sf}/customer.parquet").select(F.col("c_custkey").alias("user_id"), "c_name")
    return _streamed(spark, sf, lambda e: streaming.with_dimension(e, users), "append").select("event_id", "user_id", "c_name")


def stream_detector(spark, sf):
    return _streamed(spark, sf, streaming.detect, "append").select("user_id", "event_id", "held")


_TOKENS = "select seq_id, array_to_string(list(cast(pitch % 4 as string) order by pos), ' ') as tokens from notes group by seq_id"

QUERIES = {f.__name__: f for f in (
    midi_round_trip, midi_event_kinds, midi_without_offs, pairs_that_close_all, tempo_map, to_millis, to_ticks, ms_notes, note_sequences, instruments, number_rows, cropped_rows, wrapped_notes, files_read_safely,
    merged_scores, same_ticks, asof_chord, near_ends, overlapping_notes, chord_symbols, chord_dimension, spelled_chords, spelled_scales, spelled_intervals, hz_columns, frequent_patterns, learned_pairs, pairs_and_back,
    encoded_and_back, retokenized, repeated_patterns, negatives, chain_json, chain_walks, translation_counts, nearest_neighbours, spanning_tree, principal_components, inferred_chords, inferred_melody, harmonised,
    estimated_tempi, scores_round_trip, cut_chunks, healed_notes, clean_titles, clean_artists, file_names, alike_titles, sentence_counts, parted_words, word_parts, page_ranks, search_texts,
    stream_tumbling, stream_sliding, stream_sessions, stream_distinct, stream_users, stream_detector,
)}

ORACLE = {
    "midi_round_trip": f"with {_NOTES}, {_PAIRS} select seq_id, channel, pitch, on_ as onset, dur, velocity from fp",
    "midi_event_kinds": f"with {_NOTES} select 'note_on' as kind, count(*) as n from notes union all select 'note_off', count(*) from notes union all select 'set_tempo', count(*) from (select distinct seq_id, channel from notes) t",
    "midi_without_offs": f"with {_NOTES} select seq_id, count(*) as n from notes group by seq_id",
    "pairs_that_close_all": f"""with {_NOTES} select a.seq_id, a.channel, a.pitch, a.onset * 40 as onset, min(b.onset * 40 + b.dur) - a.onset * 40 as dur, a.velocity from notes a join notes b on a.seq_id = b.seq_id and a.channel = b.channel and a.pitch = b.pitch
 and b.onset * 40 + b.dur > a.onset * 40 group by a.seq_id, a.pos, a.channel, a.pitch, a.onset, a.velocity""",
    "tempo_map": f"with {_NOTES}, {_MAP} select seq_id, tick, tempo, round(ms, 4) as ms from m",
    "to_millis": f"with {_NOTES}, {_MAP} select n.seq_id, n.pos, round(m.ms + (n.onset * 40 - m.tick) * m.tempo / 480000.0::double, 4) as ms from notes n asof join m on n.seq_id = m.seq_id and n.onset * 40 >= m.tick",
    "to_ticks": f"with {_NOTES} select seq_id, pos, onset * 40 as tick from notes",
    "note_sequences": f"with {_NOTES} select seq_id, count(*) as n, count(distinct channel) as n_tempos, round(max(onset * 40 + dur) / 960.0::double, 5) as total_time from notes group by seq_id",
    "instruments": f"with {_NOTES} select seq_id, channel, 0 as program, case when channel = 9 then 1 else 0 end as drum, count(*) as n from notes group by seq_id, channel",
    "number_rows": f"with {_NOTES} select seq_id, onset, dur, channel, pitch, velocity from notes",
    "cropped_rows": f"with {_NOTES} select distinct seq_id, 8 as n from notes",
    "wrapped_notes": f"with {_NOTES}, {_PAIRS} select channel, count(*) as n, cast(sum(dur) as bigint) as dur from fp group by channel",
    "files_read_safely": f"with {_NOTES} select seq_id, case when seq_id % 10 = 7 then 0 else 2 * count(*) + count(distinct channel) end as n_events, case when seq_id % 10 = 7 then 1 else 0 end as corrupt from notes group by seq_id",
    "same_ticks": f"""with {_NOTES}, p as (select *, 120 * (1 + seq_id % 2) as ticks, count(distinct seq_id) over (partition by cast(floor(seq_id / 2.0) as bigint)) as k from notes)
 select seq_id, pos, cast(case when k > 1 then 1000 else ticks end as int) as ticks, cast(round_even(case when k > 1 then onset * 500.0::double / ticks else onset end, 0) as bigint) as onset, cast(round_even(case when k > 1 then dur * 500.0::double / ticks else dur end, 0) as bigint) as dur from p""",
    "asof_chord": f"""with {_NOTES}, s as (select seq_id, onset as time, max(pitch % 3) as state from notes where channel % 3 = 1 group by seq_id, onset)
 select n.seq_id, n.pos, s.state from notes n asof left join s on n.seq_id = s.seq_id and n.onset >= s.time""",
    "near_ends": f"with {_NOTES} select a.seq_id, a.pos as a, b.pos as b from notes a join notes b on a.seq_id = b.seq_id and abs(a.onset + a.dur - b.onset) < 3",
    "overlapping_notes": f"with {_NOTES} select a.seq_id, a.pos as a, b.pos as b from notes a join notes b on a.seq_id = b.seq_id and a.pos < b.pos and a.onset < b.onset + b.dur and b.onset < a.onset + a.dur",
    "hz_columns": f"with {_NOTES} select distinct pitch, cast(pitch as double) as back, pitch as named from notes",
    "pairs_and_back": f"with {_NOTES} {_TOKENS}",
    "encoded_and_back": f"with {_NOTES} {_TOKENS}",
    "nearest_neighbours": """with v as (select vec_id, cast(embedding as double[]) as e from embeddings), p as (select a.vec_id as a, b.vec_id as b,
 round(list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e)) + 1e-10), 12) as sim from v a join v b on a.vec_id % 50 = 0 and a.vec_id <> b.vec_id)
 select a, b, round(sim, 4) as sim, rk from (select *, row_number() over (partition by a order by sim desc, b) as rk from p) t where rk <= 3""",
    "scores_round_trip": f"with {_NOTES} select seq_id, pos - 1 as pos, cast(coalesce(sum(dur) over (partition by seq_id order by pos rows between unbounded preceding and 1 preceding), 0) as double) as onset, cast(dur as double) as dur, pitch from notes",
    "cut_chunks": f"with {_NOTES} select seq_id, least(6, count(*)) as n from notes group by seq_id",
    "file_names": "select doc_id, lang as artist, cast(doc_id as string) as title from documents",
    "search_texts": """select doc_id, unnest(['"' || lang || '" "' || source || '"', concat_ws(' ', lang, source, 'song'), concat_ws(' ', source, lang), lang]) as q from documents""",
    "stream_tumbling": "select date_trunc('day', ts) as start, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2",
    "stream_sliding": "select d as start, event_type, count(*) as n from (select event_type, unnest([date_trunc('day', ts) - interval 1 day, date_trunc('day', ts)]) as d from events) t group by 1, 2",
    "stream_sessions": """with s as (select user_id, ts, sum(fresh) over (partition by user_id order by ts, event_id rows between unbounded preceding and current row) as k from (
 select *, case when ts - lag(ts) over (partition by user_id order by ts, event_id) < interval 12 hours then 0 else 1 end as fresh from events) t) select user_id, min(ts) as start, max(ts) + interval 12 hours as end_, count(*) as n from s group by user_id, k""",
    "stream_distinct": "select event_id, user_id, event_type from events",
    "stream_users": "select event_id, user_id, c_name from events left join customer on c_custkey = user_id",
}
