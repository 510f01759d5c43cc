"""As-of, band and interval joins, slices of sequences, note pairing and tempo maps, searches."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from partita.operators import floor_div, operator


def asof_join(left: DataFrame, right: DataFrame, by: list[str], left_on: str, right_on: str, columns: list[str], strict: bool = False, order: list[str] | None = None) -> DataFrame:
    """left with the columns of the last row of right at or before it (before it, if strict).

    One sort of both sides together by (by, time); no pair is formed, so a long history costs nothing more."""
    at, side = "__at", "__side"
    tie = [F.col(c) for c in order or []]
    cols = left.columns
    a = left.select("*", F.col(left_on).alias(at), F.lit(0 if strict else 1).alias(side), *[F.lit(None).cast(right.schema[c].dataType).alias(f"__{c}") for c in columns], *[F.lit(None).cast(right.schema[c].dataType).alias(f"__o{i}") for i, c in enumerate(order or [])])
    b = right.select(*[F.col(c) if c in by else F.lit(None).cast(left.schema[c].dataType).alias(c) for c in cols], F.col(right_on).alias(at), F.lit(1 if strict else 0).alias(side), *[F.col(c).alias(f"__{c}") for c in columns], *[t.alias(f"__o{i}") for i, t in enumerate(tie)])
    w = Window.partitionBy(*by).orderBy(at, side, *[f"__o{i}" for i in range(len(tie))]).rowsBetween(Window.unboundedPreceding, 0)
    known = a.unionByName(b).withColumns({f"__v{c}": F.last(F.when(F.col(side) == (1 if strict else 0), F.struct(f"__{c}")), ignorenulls=True).over(w) for c in columns})
    return known.where(F.col(side) == (0 if strict else 1)).select(*cols, *[F.col(f"__v{c}.__{c}").alias(c) for c in columns])


def band_join(left: DataFrame, right: DataFrame, by: list[str], left_on: str, right_on: str, width: float) -> DataFrame:
    """Pairs of rows, as structs l and r, whose values lie under ``width`` apart: an equi-join on buckets of that width and their neighbours."""
    a = left.select(F.struct("*").alias("l"), *[F.col(c).alias(f"__{c}") for c in by], F.explode(F.expr(f"transform(array(-1, 0, 1), k -> cast(floor({left_on} / {width}) as bigint) + k)")).alias("__b"))
    b = right.select(F.struct("*").alias("r"), *[F.col(c).alias(f"__{c}") for c in by], F.expr(f"cast(floor({right_on} / {width}) as bigint)").alias("__b"))
    return a.join(b, [f"__{c}" for c in by] + ["__b"]).where(F.abs(F.col(f"l.{left_on}") - F.col(f"r.{right_on}")) < width).select("l", "r")


def overlap_join(left: DataFrame, right: DataFrame, by: list[str], size: int, start: str = "onset", stop: str = "stop") -> DataFrame:
    """Pairs of rows, as structs l and r, whose half-open spans overlap: an equi-join on the cells of ``size`` that they touch, each pair once in the cell where the later one begins."""
    cells = F.expr(f"sequence(cast(floor({start} / {size}) as bigint), cast(floor(({stop} - 1) / {size}) as bigint))")
    a, b = (df.where(F.col(stop) > F.col(start)).select(F.struct("*").alias(n), *[F.col(c).alias(f"__{c}") for c in by], F.explode(cells).alias("__c")) for df, n in ((left, "l"), (right, "r")))
    both = a.join(b, [f"__{c}" for c in by] + ["__c"]).where((F.col(f"l.{start}") < F.col(f"r.{stop}")) & (F.col(f"r.{start}") < F.col(f"l.{stop}")))
    return both.where(F.col("__c") == F.floor(F.greatest(f"l.{start}", f"r.{start}") / size)).select("l", "r")


# --- note pairing and tempo maps over events of files -----------------------------------------


def paired(events: DataFrame, rule: str = "fifo") -> DataFrame:
    """Notes (path, track, onset, dur, channel, pitch, velocity) of events.

    ``fifo``: an off, or an on with velocity 0, ends the oldest open note of its channel and pitch; an off
    without an open note counts for nothing; a note still open lasts to the track's end.  The k-th on
    meets the k-th off that finds one open; such offs are those at which the running sum of ons
    minus offs reaches no new low under zero.  ``all``: an off ends all open notes that began at an
    earlier tick, and notes still open at the end are dropped."""
    key = ["path", "track", "channel", "num"]
    is_on = (F.col("kind") == "note_on") & (F.col("value") > 0)
    both = events.where(F.col("kind").isin("note_on", "note_off")).withColumn("on", is_on)
    last = events.groupBy("path", "track").agg(F.max("tick").alias("end"))
    named = lambda df: df.select("path", "track", F.col("tick").alias("onset"), (F.col("stop") - F.col("tick")).alias("dur"), "channel", F.col("num").alias("pitch"), "velocity")
    if rule == "all":
        ahead = Window.partitionBy(*key).orderBy("tick").rangeBetween(1, Window.unboundedFollowing)
        return named(both.withColumn("stop", F.min(F.when(~F.col("on"), F.col("tick"))).over(ahead)).where(F.col("on") & F.col("stop").isNotNull()).withColumn("velocity", F.col("value")))
    w = Window.partitionBy(*key).orderBy("idx")
    so_far, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    deep = both.withColumn("s", F.sum(F.when(F.col("on"), 1).otherwise(-1)).over(so_far))
    real = deep.withColumn("off", ~F.col("on") & (F.col("s") >= F.least(F.lit(0), F.coalesce(F.min("s").over(before), F.lit(0)))))
    k = F.sum(F.when(F.col("on"), 1)).over(so_far), F.sum(F.when(F.col("off"), 1)).over(so_far)
    numbered = real.withColumn("k", F.when(F.col("on"), k[0]).when(F.col("off"), k[1])).where(F.col("on") | F.col("off"))
    notes = numbered.groupBy(*key, "k").agg(F.max(F.when(F.col("on"), F.col("tick"))).alias("tick"), F.max(F.when(F.col("on"), F.col("value"))).alias("velocity"), F.max(F.when(F.col("off"), F.col("tick"))).alias("stop"))
    return named(notes.join(last, ["path", "track"]).withColumn("stop", F.coalesce("stop", "end")).where(F.col("tick").isNotNull()))


def tempo_map(events: DataFrame, default: int = 500_000, track: int | None = None, distinct: bool = True) -> DataFrame:
    """(path, tick, tempo, ms): from which tick a tempo holds and at which millisecond; equal neighbours are dropped."""
    tempos = events.where(F.col("kind") == "set_tempo")
    if track is not None:
        tempos = tempos.where(F.col("track") == track)
    first = events.select("path", F.lit(0).cast("long").alias("tick"), F.lit(default).alias("tempo"), F.lit(-1).alias("place"), "ticks").distinct()
    found = tempos.select("path", "tick", F.col("value").alias("tempo"), (F.col("track") * 1_000_000 + F.col("idx")).cast("int").alias("place"), "ticks")
    each = first.unionByName(found).groupBy("path", "tick").agg(F.max_by("tempo", "place").alias("tempo"), F.max("ticks").alias("ticks"))
    w = Window.partitionBy("path").orderBy("tick")
    if distinct:
        each = each.withColumn("was", F.lag("tempo").over(w)).where(F.col("was").isNull() | (F.col("was") != F.col("tempo"))).drop("was")
    part = (F.col("tick") - F.lag("tick").over(w)) * F.lag("tempo").over(w) / (F.lit(1000.0) * F.col("ticks"))
    return each.withColumn("part", F.coalesce(part, F.lit(0.0))).withColumn("ms", F.sum("part").over(w.rowsBetween(Window.unboundedPreceding, 0))).select("path", "tick", "tempo", "ms", "ticks")


def to_millis(events: DataFrame, default: int = 500_000, track: int | None = None) -> DataFrame:
    """events with their time in milliseconds, ``ms``."""
    tempos = tempo_map(events, default, track).select("path", F.col("tick").alias("from_tick"), "tempo", F.col("ms").alias("from_ms"))
    known = asof_join(events, tempos, ["path"], "tick", "from_tick", ["from_tick", "tempo", "from_ms"])
    return known.withColumn("ms", F.col("from_ms") + (F.col("tick") - F.col("from_tick")) * F.col("tempo") / (F.lit(1000.0) * F.col("ticks"))).drop("from_tick", "tempo", "from_ms")


def to_ticks(times: DataFrame, tempos: DataFrame) -> DataFrame:
    """times (path, ms) with the nearest tick, the lower one on a tie."""
    known = asof_join(times, tempos.select("path", F.col("ms").alias("from_ms"), F.col("tick").alias("from_tick"), "tempo", "ticks"), ["path"], "ms", "from_ms", ["from_ms", "from_tick", "tempo", "ticks"])
    exact = F.col("from_tick") + (F.col("ms") - F.col("from_ms")) * 1000.0 * F.col("ticks") / F.col("tempo")
    return known.withColumn("tick", F.ceil(exact - 0.5).cast("long")).drop("from_ms", "from_tick", "tempo", "ticks")


# --- SQL operators ------------------------------------------------------------------------------


@operator
def fifo_pairs() -> str:
    """Starts and ends of each channel and pitch paired in order."""
    return """select a.seq_id, a.channel, a.pitch, a.onset, b.stop - a.onset as dur, a.velocity from (select *, row_number() over (partition by seq_id, channel, pitch order by onset, velocity) as k from {notes}) a
 join (select seq_id, channel, pitch, onset + dur as stop, row_number() over (partition by seq_id, channel, pitch order by onset + dur) as k from {notes}) b on a.seq_id = b.seq_id and a.channel = b.channel and a.pitch = b.pitch and a.k = b.k"""


@operator
def segment(start: int = 2, end: int = 4) -> str:
    """Notes that begin in [start, end], and for each channel the state that holds at the start as a row at it."""
    return f"""select seq_id, 'note' as kind, onset as time, channel, pitch as value from {{notes}} where onset between {start} and {end}
 union all select seq_id, kind, {start} as time, channel, value from (select *, row_number() over (partition by seq_id, kind, channel order by time desc, pos desc) as rk from {{states}} where time <= {start}) t where rk = 1"""


@operator
def subsequence(start: float = 2, end: float = 4) -> str:
    """Notes that begin in [start, end), cut at the end and set back to the start."""
    return f"select seq_id, pos, onset - {start} as onset, least(onset + dur, {end}) - onset as dur, pitch from {{notes}} where onset >= {start} and onset < {end}"


@operator
def subsequences(times: tuple = (1, 3, 5, 8)) -> str:
    """All slices between split times at once: each note in the slice in which it begins, cut and set back."""
    spans = " union all ".join(f"select {k} as part, {a} as a, {b} as b" for k, (a, b) in enumerate(zip(times, times[1:], strict=False)))
    return f"select n.seq_id, n.pos, s.part, onset - a as onset, least(onset + dur, b) - onset as dur, pitch from {{notes}} n join ({spans}) s on n.onset >= s.a and n.onset < s.b"


@operator
def trimmed(start: float = 2, end: float = 4) -> str:
    """The same without setting back."""
    return f"select seq_id, pos, onset, least(onset + dur, {end}) - onset as dur, pitch from {{notes}} where onset >= {start} and onset < {end}"


@operator
def warped(old: tuple = (1, 3, 6), new: tuple = (0, 4, 5)) -> str:
    """Times brought from old to new points, straight between them; what lies outside goes, and so do notes that end up empty."""
    spans = " union all ".join(f"select {a} as a, {b} as b, {c} as c, {e} as e" for (a, b), (c, e) in zip(zip(old, old[1:], strict=False), zip(new, new[1:], strict=False), strict=True))
    to = lambda x, s: f"{s}.c + ({x} - {s}.a) * cast({s}.e - {s}.c as double) / ({s}.b - {s}.a)"
    top = old[-1]
    return f"""select seq_id, pos, round({to('onset', 's')}, 6) as start, round({to('stop', 't')}, 6) as stop, pitch from (select *, least(onset + dur, {top}) as stop from {{notes}}) n
 join ({spans}) s on n.onset >= s.a and n.onset < s.b join ({spans}) t on n.stop > t.a and n.stop <= t.b where {to('stop', 't')} > {to('onset', 's')}"""


@operator
def near_transitions(width: int = 2) -> str:
    """Pitch classes of notes that end within ``width`` of where another of the sequence begins, through buckets of that width."""
    cell = lambda x: floor_div(x, width)
    near = " union all ".join(f"select *, {cell('onset + dur')} + {k} as cell from {{notes}}" for k in (-1, 0, 1))
    return f"""select a.pitch % 12 as a, b.pitch % 12 as b, count(*) as n from ({near}) a join (select *, {cell('onset')} as cell from {{notes}}) b
 on a.seq_id = b.seq_id and a.cell = b.cell where abs(a.onset + a.dur - b.onset) < {width} group by 1, 2"""


@operator
def equal_vectors(d, like: int = 0) -> str:
    """Rows whose vector equals that of one row."""
    return f"select a.vec_id from {{vectors}} a join (select embedding as e from {{vectors}} where vec_id = {like}) b on a.embedding = b.e"


@operator
def matching_rows(d) -> str:
    """How many rows have a label-wise neighbour with the same first eight values."""
    key = d.joined(d.map(d.part("embedding", 1, 8), "x", d.tenths("x")), " ")
    return f"select count(*) as n from (select {key} as k, label from {{vectors}}) a where exists (select 1 from (select {key} as k, label from {{vectors}}) b where a.k = b.k and b.label = 1)"


def _tokens(d, token: str) -> str:
    return f"select seq_id, {d.alist(token, 'pos')} as h from {{notes}} group by seq_id"


def _found(d, needle: tuple) -> str:
    m, want = len(needle), d.array(*needle)
    return d.where(d.range(1, f"{d.size}(h) - {m} + 1"), "i", f"{d.part('h', 'i', m)} = {want}")


@operator
def find_first(d, needle: tuple = (1, 2), token: str = "pitch % 4") -> str:
    """The first place (from 0) of a needle in each sequence, -1 if there is none."""
    return f"select seq_id, coalesce({d.at(_found(d, needle), 1)} - 1, -1) as place from ({_tokens(d, token)}) t" if d.name == "duck" else f"select seq_id, coalesce(get({_found(d, needle)}, 0) - 1, -1) as place from ({_tokens(d, token)}) t"


@operator
def find_all(d, needle: tuple = (1, 2), token: str = "pitch % 4") -> str:
    """All places of a needle, which may overlap; an empty needle has none."""
    if not needle:
        return f"select seq_id, 0 as place from ({_tokens(d, token)}) t where false"
    return f"select seq_id, place - 1 as place from (select seq_id, {d.explode}({_found(d, needle)}) as place from ({_tokens(d, token)}) t) u"


@operator
def find_next(d, needle: tuple = (1, 2), after: int = 0, token: str = "pitch % 4") -> str:
    """The first place of a needle after a place."""
    return f"select seq_id, min(place) as place from ({find_all.text(d, needle=needle, token=token)}) f where place > {after} group by seq_id"


@operator
def vertical_search(needle: tuple = (3, 5)) -> str:
    """Onsets from which the following onsets' chords hold the needle's pitch classes one after the other."""
    want = " union all ".join(f"select {j} as j, {x} as x" for j, x in enumerate(needle))
    return f"""with c as (select distinct seq_id, rk, pc from (select seq_id, pitch % 12 as pc, dense_rank() over (partition by seq_id order by onset) as rk from {{notes}}) t)
 select seq_id, rk - j as start from c join ({want}) w on c.pc = w.x where rk - j >= 1 group by seq_id, rk - j having count(distinct j) = {len(needle)}"""


@operator
def duplicate_tracks() -> str:
    """Tracks (channels) of a file with equal counts and ranges: the first stays."""
    return """select seq_id, channel, n, high, low, row_number() over (partition by seq_id, n, high, low order by channel) as copy from (
 select seq_id, channel, count(*) as n, max(pitch) as high, min(pitch) as low from {notes} group by seq_id, channel) t"""


@operator
def bar_spans(d, bar: int = 4) -> str:
    """Each channel's bars up to its end."""
    return f"select seq_id, channel, bar, bar * {bar} as start, least((bar + 1) * {bar}, stop) as stop from (select seq_id, channel, stop, {d.explode}({d.range(0, f'cast(ceil(stop / {float(bar)}) as int) - 1')}) as bar from (select seq_id, channel, max(onset + dur) as stop from {{notes}} group by seq_id, channel) t) u"


@operator
def similar_songs(d) -> str:
    """For each sequence that has four notes: the other one (of the next hundred by number) whose repeat counters agree at most places of its own, the first on a tie."""
    counters = """with c as (select seq_id, pos, row_number() over (partition by seq_id, island order by pos) - 1 as again, count(*) over (partition by seq_id) as n from (
 select *, sum(fresh) over (partition by seq_id order by pos rows between unbounded preceding and current row) as island from (select seq_id, pos, case when pitch % 2 = lag(pitch % 2) over (partition by seq_id order by pos) then 0 else 1 end as fresh from {notes}) t) u)"""
    if d.name == "spark":  # the sequences of a hundred meet as one row of at most a hundred arrays; no row for each pair is dealt
        return f"""{counters}, g as (select seq_id, max(n) as n, collect_list(pos * 4294967296 + again) as h, collect_list(pos) as p from c where seq_id is not null group by seq_id),
 k as (select collect_list(struct(seq_id, n, h, p)) as l from g group by cast(floor(seq_id / 100.0) as bigint)),
 best as (select explode(transform(filter(l, a -> a.n >= 4), a -> struct(a.seq_id as seq_id, a.n as n, array_min(transform(filter(l, b -> b.seq_id <> a.seq_id and (get(a.p, 0) = get(b.p, 0) or arrays_overlap(a.p, b.p))), b -> struct(-size(array_intersect(a.h, b.h)) as less, b.seq_id as other))) as m))) as r from k)
 select r.seq_id, r.m.other, round(-r.m.less / cast(r.n as double), 6) as share from best where r.m is not null"""
    return f"""{counters}
 select seq_id, other, round(share, 6) as share from (select a.seq_id, b.seq_id as other, sum(case when a.again = b.again then 1.0 else 0.0 end) / max(a.n) as share, row_number() over (partition by a.seq_id order by sum(case when a.again = b.again then 1.0 else 0.0 end) / max(a.n) desc, b.seq_id) as rk
 from c a join c b on a.pos = b.pos and cast(floor(a.seq_id / 100.0) as bigint) = cast(floor(b.seq_id / 100.0) as bigint) and a.seq_id <> b.seq_id where a.n >= 4 group by a.seq_id, b.seq_id) t where rk = 1"""


@operator
def melody_chords(d) -> str:
    """Each onset's melody note with the chord under it."""
    return f"""select m.seq_id, m.onset, m.melody, c.tones from (select seq_id, onset, max(pitch) as melody from {{notes}} group by seq_id, onset) m
 join (select seq_id, onset, {d.joined(d.map(d.sorted_set('pitch % 12'), 'x', 'cast(x as string)'), ' ')} as tones from {{notes}} group by seq_id, onset) c on m.seq_id = c.seq_id and m.onset = c.onset"""


@operator
def histogram_search(like: int = 1) -> str:
    """Sequences by the share of common pitches with one sequence, over its twelve transpositions."""
    shifts = " union all ".join(f"select {k} as k" for k in range(-6, 6))
    return f"""with q as (select distinct pitch + k as pitch, k from {{notes}} cross join ({shifts}) s where seq_id = {like}), p as (select distinct seq_id, pitch from {{notes}}),
 n as (select seq_id, count(*) as n from p group by seq_id), m as (select count(distinct pitch) as m from {{notes}} where seq_id = {like})
 select seq_id, round(max(share), 6) as share from (select p.seq_id, q.k, count(*) / cast(max(greatest(n.n, m.m)) as double) as share from p join q on p.pitch = q.pitch join n on n.seq_id = p.seq_id cross join m group by p.seq_id, q.k) t group by seq_id"""


@operator
def not_recent(window: int = 2) -> str:
    """Pitches of a sequence that were not among the ``window`` before."""
    lags = " and ".join(f"not (pitch is not distinct from lag(pitch, {k}) over (partition by seq_id order by pos))" for k in range(1, window + 1))
    return f"select seq_id, pos, pitch from (select *, {lags} as fresh from {{notes}}) t where fresh"
