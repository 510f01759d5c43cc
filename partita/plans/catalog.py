"""Queries over the canonical note, event, word and vector views, as one SQL text for Spark and the oracle.

``NOTES`` is the note view over ``lineitem``; every window ends in ``pos``, which is unique in a sequence.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

NOTES = """notes as (select l_orderkey as seq_id, cast(l_quantity as int) as dur, cast(l_suppkey % 16 as int) as channel,
 cast(l_partkey % 128 as int) as pitch, 1 + (l_linenumber * 16) % 127 as velocity, l_linenumber as onset,
 row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity, l_extendedprice) as pos
 from lineitem)"""


def _notes(body: str) -> str:
    return f"with {NOTES} {body}"


_NGRAM = """, g as (select seq_id, pitch as a, lead(pitch) over (partition by seq_id order by pos) as b,
 lead(pitch, 2) over (partition by seq_id order by pos) as c from notes)"""

SQL: dict[str, str] = {
    "pitch_histogram": "select (l_partkey % 128) % 12 as pc, count(*) as n from lineitem group by 1",
    "pitch_class_histogram_weighted": _notes("select pitch % 12 as pc, sum(dur) as weight from notes group by 1"),
    "channel_filter": _notes("select seq_id, pos, pitch from notes where channel <> 9"),
    "transpose_clip": _notes("select seq_id, pos, greatest(0, least(127, pitch + 7)) as pitch from notes"),
    "octave_fold": _notes("select seq_id, pos, pitch % 12 + 60 as pitch from notes"),
    "velocity_normalise": _notes("select seq_id, pos, round(cast(velocity as double) / max(velocity) over (partition by seq_id), 6) as v from notes"),
    "seq_stats": _notes("select seq_id, count(*) as n, min(pitch) as low, max(pitch) as high, round(avg(cast(pitch as double)), 6) as mean_pitch, sum(dur) as total_dur from notes group by seq_id"),
    "pitch_deviation": _notes("select seq_id, round(stddev_pop(cast(pitch as double)), 6) as sigma from notes group by seq_id"),
    "channel_activity": _notes("select channel, count(*) as n, count(distinct seq_id) as seqs from notes group by channel"),
    "skyline_melody": _notes("select seq_id, onset, max(pitch) as pitch from notes group by seq_id, onset"),
    "bass_line": _notes("select seq_id, onset, min(pitch) as pitch from notes group by seq_id, onset"),
    "chord_sizes": _notes("select seq_id, onset, count(distinct pitch % 12) as tones from notes group by seq_id, onset"),
    "delta_times": _notes("select seq_id, pos, onset - coalesce(lag(onset) over (partition by seq_id order by pos), onset) as delta from notes"),
    "dedup_in_chord": _notes("select seq_id, onset, pitch, max(dur) as dur from notes group by seq_id, onset, pitch"),
    "unique_justseen": _notes("select seq_id, pos, pitch from (select *, lag(pitch) over (partition by seq_id order by pos) as prev from notes) t where prev is null or prev <> pitch"),
    "monophonic_fix": _notes("select seq_id, pos, least(dur, coalesce(lead(onset) over (partition by seq_id order by pos) - onset, dur)) as dur from notes"),
    "parsons_code": _notes("select seq_id, pos, case when prev is null then '*' when pitch > prev then 'U' when pitch < prev then 'D' else 'R' end as step from (select *, lag(pitch) over (partition by seq_id order by pos) as prev from notes) t"),
    "session_on_silence": _notes("""select seq_id, pos, sum(fresh) over (partition by seq_id order by pos rows between unbounded preceding and current row) as session
 from (select seq_id, pos, case when onset > coalesce(max(onset + dur % 2) over (partition by seq_id order by pos rows between unbounded preceding and 1 preceding), onset) + 1 then 1 else 0 end as fresh from notes) t"""),
    "moving_convolve": _notes("select seq_id, pos, pitch + 2 * coalesce(lag(pitch) over (partition by seq_id order by pos), 0) + coalesce(lag(pitch, 2) over (partition by seq_id order by pos), 0) as y from notes"),
    "grouper": _notes("select seq_id, cast(floor((pos - 1) / 3.0) as int) as block, count(*) as n, sum(pitch) as total from notes group by 1, 2"),
    "nth_note": _notes("select seq_id, pitch from notes where pos = 2"),
    "ngram_counts": _notes(_NGRAM[0:] + " select a, b, c, count(*) as n from g where c is not null group by a, b, c"),
    "markov_table": _notes(_NGRAM + " select a, b, count(*) as n from g where b is not null group by a, b"),
    "markov_cumdist": _notes(_NGRAM + ", m as (select a, b, count(*) as n from g where b is not null group by a, b) select a, b, sum(n) over (partition by a order by b rows between unbounded preceding and current row) as cum from m"),
    "markov_start": _notes("select pitch, count(*) as n from notes where pos = 1 group by pitch"),
    "transition_entropy": _notes(_NGRAM + ", m as (select a, b, count(*) as n from g where b is not null group by a, b), p as (select a, cast(n as double) / sum(n) over (partition by a) as p from m) select a, round(-sum(p * ln(p) / ln(2.0)), 6) as h from p group by a"),
    "bpe_best_pair": _notes(_NGRAM + " select a, b, count(*) as n from g where b is not null group by a, b order by n desc, a, b limit 1"),
    "band_transition": _notes(_NGRAM + " select a % 12 as a, b % 12 as b, count(*) as n from g where b is not null group by 1, 2"),
    "top_intervals": _notes(_NGRAM + " select b - a as step, count(*) as n from g where b is not null group by 1 order by n desc, step limit 10"),
    "interval_class": _notes(_NGRAM + " select least((b - a + 132) % 12, 12 - (b - a + 132) % 12) as ic, count(*) as n from g where b is not null group by 1"),
    "inversion": _notes("select seq_id, pos, (144 - pitch) % 12 as pc from notes"),
    "note_number_to_hz": _notes("select distinct pitch, round(440.0 * power(cast(2 as double), cast(pitch - 69 as double) / 12), 4) as hz from notes"),
    "program_family": _notes("select cast(floor(pitch / 8.0) as int) as family, count(*) as n from notes group by 1"),
    "semi_match_rows": "select c_custkey, c_name from customer where exists (select 1 from orders where o_custkey = c_custkey)",
    "anti_match_rows": "select c_custkey, c_name from customer where not exists (select 1 from orders where o_custkey = c_custkey)",
    "rollup_catalog": "select r_name, n_name, count(*) as n from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by rollup(r_name, n_name)",
    "set_union": "select l_partkey as k from lineitem union select o_orderkey from orders",
    "set_intersect": "select l_partkey as k from lineitem intersect select o_orderkey from orders",
    "set_except": "select o_orderkey as k from orders except select l_orderkey from lineitem",
    "event_counts": "select event_type, count(*) as n, round(sum(value), 4) as total from events group by event_type",
    "asof_state": "select event_id, max(case when event_type = 'purchase' then ts end) over (partition by user_id order by ts, event_id rows between unbounded preceding and current row) as last_purchase from events",
    "turn_roles": "select conv_id, role, count(*) as n from conversations group by conv_id, role",
    "label_rates": "select source, count(*) as n, sum(quality) as good from documents join labels on documents.doc_id = labels.doc_id group by source",
}
SQL = {k: v.replace(") , g as", "), g as") for k, v in SQL.items()}


def views(spark: SparkSession, sf_dir: str, text: str) -> None:
    for name in TABLES:
        if name in text:
            spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)


def query(name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        views(spark, sf_dir, SQL[name])
        return spark.sql(SQL[name])

    return run
