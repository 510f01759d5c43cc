"""Aggregates over notes, tokens and vectors."""

from __future__ import annotations

from partita.operators import floor_div, mod, operator

# The pitch classes of the major scale on 0, the three scale kinds of the likelihood test, and Krumhansl's major key weights
MAJOR = (0, 2, 4, 5, 7, 9, 11)
SCALES = {"major": MAJOR, "minor": (0, 2, 3, 5, 7, 8, 10), "harmonic": (0, 2, 3, 5, 7, 8, 11)}
KEY_WEIGHTS = (6.35, 2.23, 3.48, 2.33, 4.38, 4.09, 2.52, 5.19, 2.39, 3.66, 2.29, 2.88)


def _rows(*rows: tuple) -> str:
    """A small table of numbers or names, with the columns c0, c1 and so on."""
    body = ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)
    return f"select * from (values {body}) as v_({', '.join(f'c{i}' for i in range(len(rows[0])))})"


def _numbers(n: int) -> str:
    return _rows(*((k,) for k in range(n)))


@operator
def score_stats(d) -> str:
    """One row a sequence: notes, pitch range and its sum over tracks (channels), channels, percussion notes and length in ticks."""
    return f"""select seq_id, sum(n) as n_notes, sum(drums) as n_percussion, count(*) as n_channels, {d.joined(d.alist('cast(channel as string)', 'channel'), ' ')} as channels,
 min(low) as low, max(high) as high, sum(high - low) as range_sum, max(stop) as nticks
 from (select seq_id, channel, count(*) as n, sum(case when channel = 9 then 1 else 0 end) as drums, min(pitch) as low, max(pitch) as high, max(onset + dur) as stop from {{notes}} group by seq_id, channel) t group by seq_id"""


@operator
def channel_counts() -> str:
    return "select seq_id, channel, count(*) as n from {notes} group by seq_id, channel"


@operator
def signature(d, full: bool = True) -> str:
    """Medians of pitch (high, middle, low), duration, velocity and gaps between onsets, rounded half to even; in full with sample deviations and harmonic means."""
    more = f""", round({'stddev_samp(cast(pitch as double))'}, 6) as pitch_dev, round(stddev_samp(cast(dur as double)), 6) as dur_dev,
 round(count(*) / sum(1.0 / pitch_1), 6) as pitch_harmonic, round(count(*) / sum(1.0 / dur_1), 6) as dur_harmonic""" if full else ""
    rank = lambda c, place: f"max(case when r_{c} = {place} then {c} end)"
    return f"""select seq_id, {rank('pitch', 'floor(n / 2.0) + 1')} as pitch_high, cast({d.bround(d.percentile('pitch', 0.5))} as bigint) as pitch_mid, {rank('pitch', 'floor((n + 1) / 2.0)')} as pitch_low,
 cast({d.bround(d.percentile('dur', 0.5))} as bigint) as dur_mid, cast({d.bround(d.percentile('velocity', 0.5))} as bigint) as velocity_mid, cast({d.bround(d.percentile('gap', 0.5), -1)} as bigint) as gap_mid{more}
 from (select *, cast(greatest(pitch, 1) as double) as pitch_1, cast(greatest(dur, 1) as double) as dur_1, count(*) over (partition by seq_id) as n, row_number() over (partition by seq_id order by pitch, pos) as r_pitch,
 coalesce(onset - lag(onset) over (partition by seq_id order by pos), 0) as gap from {{notes}}) t group by seq_id"""


@operator
def midi_signature(d) -> str:
    """Sums and whole means of the five fields over all notes and over the melody (the highest note of each onset)."""
    fields = ("onset", "dur", "channel", "pitch", "velocity")
    cols = ", ".join(f"sum(case when {w} then {f} end) as {n}_sum_{f}, {d.trunc(f'avg(case when {w} then cast({f} as double) end)')} as {n}_avg_{f}" for n, w in (("all", "true"), ("melody", "rk = 1")) for f in fields)
    return f"select seq_id, {cols} from (select *, row_number() over (partition by seq_id, onset order by pitch desc, pos) as rk from {{notes}}) t group by seq_id"


@operator
def music_features() -> str:
    """Counts and means of gaps, durations, channels, pitches and velocities of melody (highest of an onset), all notes and bass (lowest)."""
    parts = []
    for name, where in (("melody", "hi = 1"), ("all", "true"), ("bass", "lo = 1")):
        parts += [f"round(avg(case when {where} then cast({f} as double) end), 6) as {name}_{f}" for f in ("gap", "dur", "channel", "pitch", "velocity")]
    return f"""select seq_id, count(*) as n, sum(pitch) as pitch_sum, {', '.join(parts)} from (select *, row_number() over (partition by seq_id, onset order by pitch desc, pos) as hi,
 row_number() over (partition by seq_id, onset order by pitch, pos) as lo, onset - coalesce(lag(onset) over (partition by seq_id order by pos), onset) as gap from {{notes}}) t group by seq_id"""


@operator
def first_of_each(fields: tuple = ("pitch",)) -> str:
    """The first note of each combination of the fields, and how many it stands for."""
    by = ", ".join(("seq_id", *fields))
    return f"select seq_id, pos, pitch, n from (select *, row_number() over (partition by {by} order by pos) as rk, count(*) over (partition by {by}) as n from {{notes}}) t where rk = 1"


def _counts(value: str) -> str:
    return f"""select seq_id, value, n, row_number() over (partition by seq_id order by n desc, seen) as rk from (select seq_id, value, count(*) as n, min(pos) as seen
 from (select seq_id, pos, {value} as value from {{notes}}) t group by seq_id, value) u"""


@operator
def pitch_counts() -> str:
    """Values with counts, ranked by count; ties by who came first."""
    return _counts("pitch")


@operator
def tone_counts() -> str:
    return _counts("pitch % 12")


@operator
def gap_counts() -> str:
    return _counts("onset - coalesce(lag(onset) over (partition by seq_id order by pos), onset)")


@operator
def duration_counts() -> str:
    return _counts("dur")


@operator
def most_common() -> str:
    """The commonest pitch and tone of a sequence, the first met on a tie."""
    return f"""select p.seq_id, p.value as pitch, t.value as tone from ({_counts('pitch')}) p join ({_counts('pitch % 12')}) t on p.seq_id = t.seq_id where p.rk = 1 and t.rk = 1"""


@operator
def melody_range() -> str:
    return "select seq_id, max(pitch) as high, round(avg(cast(pitch as double)), 6) as mean, min(pitch) as low, max(pitch) - min(pitch) as width from {notes} group by seq_id"


@operator
def run_time(tick_ms: int = 16) -> str:
    """Sum of gaps plus the last duration, in milliseconds, seconds and minutes."""
    total = "(max(onset) - min(onset) + max(case when rk = 1 then dur end))"
    return f"select seq_id, {total} * {tick_ms} as ms, {total} * {tick_ms} / 1000.0 as s, round({total} * {tick_ms} / 60000.0, 6) as minutes from (select *, row_number() over (partition by seq_id order by pos desc) as rk from {{notes}}) t group by seq_id"


@operator
def octave() -> str:
    return "select seq_id, cast(floor(avg(cast(pitch as double)) / 12) as int) as octave from {notes} group by seq_id"


@operator
def pitch_class_histogram(by_duration: bool = True, by_velocity: bool = True, normalised: bool = True) -> str:
    """Twelve bins a sequence, zero bins included."""
    weight = " * ".join(["1.0"] + ["dur"] * by_duration + ["velocity"] * by_velocity)
    share = "coalesce(w, 0) / nullif(sum(coalesce(w, 0)) over (partition by s.seq_id), 0)" if normalised else "coalesce(w, 0)"
    return f"""select s.seq_id, k.c0 as pc, round({share}, 6) as weight from (select distinct seq_id from {{notes}}) s cross join ({_numbers(12)}) k
 left join (select seq_id, pitch % 12 as pc, sum(cast({weight} as double)) as w from {{notes}} group by seq_id, pitch % 12) h on h.seq_id = s.seq_id and h.pc = k.c0"""


@operator
def end_time() -> str:
    return "select seq_id, max(greatest(onset + dur, onset)) as stop from {notes} group by seq_id"


@operator
def major_key_histogram() -> str:
    """For each major key the notes whose pitch class it holds."""
    dim = _rows(*((k, (k + p) % 12) for k in range(12) for p in MAJOR))
    return f"select seq_id, k.c0 as key, count(*) as n from {{notes}} n join ({dim}) k on n.pitch % 12 = k.c1 group by seq_id, k.c0"


@operator
def major_key() -> str:
    """The key with the largest histogram entry, the lowest on a tie."""
    return f"select seq_id, key from (select seq_id, key, row_number() over (partition by seq_id order by n desc, key) as rk from ({major_key_histogram.text()}) h) t where rk = 1"


@operator
def sequence_entropy() -> str:
    """Shannon entropy (bits) of a sequence's pitches."""
    return """select seq_id, round(-sum(p * (ln(p + 1e-12) / ln(2.0))), 6) as entropy from (select seq_id, cast(n as double) / sum(n) over (partition by seq_id) as p
 from (select seq_id, pitch, count(*) as n from {notes} group by seq_id, pitch) t) u group by seq_id"""


@operator
def sequence_features(d) -> str:
    """The numeric features of a token sequence: length, its remainder by three, distinct values, bit mask of values under 32, moments and percentiles, last steps."""
    cuts = ", ".join(f"round({d.percentile('x', q / 100)}, 6) as p{q}" for q in (10, 25, 50, 75, 90))
    return f"""select seq_id, count(*) as n, count(*) % 3 as mod3, count(distinct pitch) as n_distinct, bit_or(cast(case when pitch < 32 then cast(power(2, pitch) as bigint) else 0 end as bigint)) as mask,
 round(avg(x), 6) as mean, round(stddev_pop(x), 6) as dev, min(pitch) as low, max(pitch) as high, {cuts}, coalesce(max(case when back = 1 then step end), -1) as last_step, coalesce(max(case when back = 2 then step end), -1) as step_before
 from (select *, cast(pitch as double) as x, pitch - lag(pitch) over (partition by seq_id order by pos) as step, row_number() over (partition by seq_id order by pos desc) as back from {{notes}}) t group by seq_id"""


@operator
def last_ngrams(n: int = 2, k: int = 8) -> str:
    """The last k n-grams of a sequence, by place."""
    leads = ", ".join(f"lead(pitch, {j}) over (partition by seq_id order by pos) as t{j}" for j in range(1, n))
    text = " || ' ' || ".join(["cast(pitch as string)"] + [f"cast(t{j} as string)" for j in range(1, n)])
    return f"select seq_id, rk, gram from (select seq_id, {text} as gram, row_number() over (partition by seq_id order by pos desc) - {n - 1} as rk from (select *, {leads} from {{notes}}) t) u where gram is not null and rk <= {k}"


@operator
def generation_report() -> str:
    """Diversity of single tokens and pairs, longest run, mean step and entropy of steps of a sequence."""
    return """select seq_id, round(count(distinct pitch) / cast(count(*) as double), 6) as uni, round(coalesce(count(distinct pair) / nullif(cast(count(pair) as double), 0), 0), 6) as bi,
 round(1 - count(distinct pitch) / cast(count(*) as double), 6) as repetition, max(run) as longest_run, round(coalesce(avg(abs(cast(step as double))), 0), 6) as mean_step from (
 select *, count(*) over (partition by seq_id, island) as run from (select *, sum(case when step = 0 then 0 else 1 end) over (partition by seq_id order by pos rows between unbounded preceding and current row) as island,
 cast(pitch as string) || ' ' || cast(after as string) as pair from (select *, pitch - lag(pitch) over (partition by seq_id order by pos) as step, lead(pitch) over (partition by seq_id order by pos) as after from {notes}) t) u) v group by seq_id"""


@operator
def frame_rates() -> str:
    """Per sequence and channel: share of the sequence's frames with a note, of those with two or more, and of the busiest channel's."""
    return """with f as (select seq_id, channel, frame, count(distinct pitch) as tones from {frames} group by seq_id, channel, frame),
 c as (select seq_id, channel, count(*) as active, sum(case when tones > 1 then 1 else 0 end) as poly, max(frame) + 1 as frames from f group by seq_id, channel)
 select seq_id, channel, active, round(active / cast(max(frames) over (partition by seq_id) as double), 6) as occupation, round(poly / cast(active as double), 6) as polyphony,
 round(active / cast(max(active) over (partition by seq_id) as double), 6) as relative from c"""


@operator
def track_features() -> str:
    """Features of each track (channel) of a file: counts, pitch and duration figures, and the same brought to 0..1 across the file (1 for the largest where all are equal)."""
    norm = lambda c, same: f"round(case when max({c}) over w = min({c}) over w then {same} else cast({c} - min({c}) over w as double) / (max({c}) over w - min({c}) over w) end, 6) as {c}_norm"
    cols = [("n", 1), ("high", 1), ("low", 0), ("long", 1), ("short", 0)]
    return f"""select seq_id, channel, n, high, low, mode, dev, long, short, mean_dur, {', '.join(norm(c, s) for c, s in cols)} from (
 select a.seq_id, a.channel, n, high, low, mode, dev, long, short, mean_dur from (select seq_id, channel, count(*) as n, max(pitch) as high, min(pitch) as low, round(stddev_pop(cast(pitch as double)), 6) as dev, max(dur) as long, min(dur) as short,
 round(avg(cast(dur as double)), 6) as mean_dur from {{notes}} group by seq_id, channel) a join (select seq_id, channel, pitch as mode from (select seq_id, channel, pitch, row_number() over (partition by seq_id, channel order by count(*) desc, pitch) as rk
 from {{notes}} group by seq_id, channel, pitch) m where rk = 1) b on a.seq_id = b.seq_id and a.channel = b.channel) t window w as (partition by seq_id)"""


@operator
def pitch_intervals(slack: int = 3) -> str:
    """Steps between neighbouring notes that follow closely and end in order: distinct, largest, smallest, commonest and deviation; -1 without any."""
    return f"""with i as (select seq_id, abs(after - pitch) as step from (select *, lead(pitch) over (partition by seq_id order by pos) as after, lead(onset) over (partition by seq_id order by pos) as next_on,
 lead(onset + dur) over (partition by seq_id order by pos) as next_off from {{notes}}) t where after is not null and onset + dur - next_on >= -{slack} and next_off >= onset + dur),
 m as (select seq_id, step as mode from (select seq_id, step, row_number() over (partition by seq_id order by count(*) desc, step) as rk from i group by seq_id, step) t where rk = 1),
 a as (select seq_id, count(distinct step) as n, max(step) as high, min(step) as low, round(stddev_pop(cast(step as double)), 6) as dev from i group by seq_id)
 select s.seq_id, coalesce(n, -1) as n, coalesce(high, -1) as high, coalesce(low, -1) as low, coalesce(mode, -1) as mode, coalesce(dev, -1) as dev from (select distinct seq_id from {{notes}}) s left join a on a.seq_id = s.seq_id left join m on m.seq_id = s.seq_id"""


@operator
def note_durations() -> str:
    return "select seq_id, max(dur) as long, min(dur) as short, round(avg(cast(dur as double)), 6) as mean, round(stddev_pop(cast(dur as double)), 6) as dev from {notes} group by seq_id"


@operator
def music_metrics(scale: tuple = MAJOR) -> str:
    """Pitches and pitch classes used, share of onsets with two or more notes, share of notes in a scale."""
    return f"""select seq_id, count(distinct pitch) as n_pitches, count(distinct pitch % 12) as n_classes, round(avg(case when pitch % 12 in ({', '.join(map(str, scale))}) then 1.0 else 0.0 end), 6) as in_scale,
 round(count(distinct case when n > 1 then onset end) / cast(count(distinct onset) as double), 6) as polyphonic from (select *, count(*) over (partition by seq_id, onset) as n from {{notes}}) t group by seq_id"""


@operator
def polyphony_score() -> str:
    """Share of onsets with more than one note."""
    return "select seq_id, round(avg(case when n > 1 then 1.0 else 0.0 end), 6) as score from (select seq_id, onset, count(*) as n from {notes} group by seq_id, onset) t group by seq_id"


@operator
def onset_intervals(k: int = 5) -> str:
    """The k commonest gaps between onsets, the first from 0, with their shares."""
    return f"""select gap, n, round(n / cast(total as double), 8) as share from (select gap, count(*) as n, sum(count(*)) over () as total, row_number() over (order by count(*) desc, gap) as rk
 from (select onset - lag(onset, 1, 0) over (partition by seq_id order by pos) as gap from {{notes}}) t group by gap) u where rk <= {k}"""


@operator
def rhythm_stats(quarter: int = 4) -> str:
    return f"select {mod('onset', quarter)} as place, count(*) as n from {{notes}} group by 1"


@operator
def intensities() -> str:
    return "select seq_id, min(velocity) as quiet, max(velocity) as loud from {notes} group by seq_id"


def _scales() -> str:
    return _rows(*((f"{base} {kind}", (base + p) % 12) for kind, ps in SCALES.items() for base in range(12) for p in ps))


@operator
def scale_shares() -> str:
    """Share of a sequence's notes inside each of the 36 scales that hold any."""
    return f"select n.seq_id, s.c0 as scale, round(count(*) / cast(max(total) as double), 6) as share from (select *, count(*) over (partition by seq_id) as total from {{notes}}) n join ({_scales()}) s on n.pitch % 12 = s.c1 group by n.seq_id, s.c0"


@operator
def likeliest_scale() -> str:
    return f"select seq_id, scale, share from (select *, row_number() over (partition by seq_id order by share desc, scale) as rk from ({scale_shares.text()}) t) u where rk = 1"


def _detect_beat_at_once(periods: tuple) -> str:
    """The same with one row a sequence: a sum for each period and phase instead of a row for each of them and each note."""
    cells = [(p, s) for p in periods for s in range(p)]
    fits = lambda p, s: f"(({mod(f'onset - {s}', p)}) * 4.0 / {p})"
    sums = ", ".join(f"sum(abs({fits(p, s)} - floor({fits(p, s)} + 0.5))) / nullif(count(onset), 0) as s{k}" for k, (p, s) in enumerate(cells))
    near = f"array({', '.join(f'case when s{k} <= least_ + 0.00001 then struct(round(s{k}, 6) as stray, {p} as period, {s} as phase) end' for k, (p, s) in enumerate(cells))})"
    least = f"least({', '.join(f's{k}' for k in range(len(cells)))})" if len(cells) > 1 else "s0"
    return f"""select seq_id, coalesce(b.period, {periods[0]}) as period, coalesce(b.phase, 0) as phase, b.stray from (select seq_id, array_min(filter({near}, x -> x is not null)) as b from (select *, {least} as least_ from (
 select seq_id, {sums} from (select /*+ repartition(seq_id) */ seq_id, onset from {{notes}}) n group by seq_id) t) u) v"""


@operator
def detect_beat(d, periods: tuple = (4, 6, 8, 12, 16)) -> str:
    """The grid of period and phase from which onsets stray least, over four steps a period."""
    grid = _rows(*((p, s) for p in periods for s in range(p)))
    if d.name == "spark":
        return _detect_beat_at_once(periods)
    off = f"abs(({mod('onset - g.c1', 'g.c0')}) * 4.0 / g.c0 - floor(({mod('onset - g.c1', 'g.c0')}) * 4.0 / g.c0 + 0.5))"
    return f"select seq_id, period, phase, round(stray, 6) as stray from (select seq_id, period, phase, stray, row_number() over (partition by seq_id order by round(stray, 6), period, phase) as rk from (select seq_id, g.c0 as period, g.c1 as phase, avg({off}) as stray from {{notes}} n cross join ({grid}) g group by seq_id, g.c0, g.c1) t) u where rk = 1"


@operator
def repetitions(length: int = 2) -> str:
    """How often two equal runs of ``length`` tones lie at least that far apart, per sequence."""
    leads = "".join(f" || ' ' || cast(lead(pitch % 12, {j}) over (partition by seq_id order by pos) as string)" for j in range(1, length))
    return f"""with g as (select seq_id, pos, cast(pitch % 12 as string){leads} as gram from {{notes}}), h as (select seq_id, gram, pos from g where gram is not null)
 select seq_id, cast(sum(n) as bigint) as n from (select seq_id, gram, pos, count(*) over (partition by seq_id, gram order by pos range between unbounded preceding and {length} preceding) as n from h) t group by seq_id"""


@operator
def approximate_key() -> str:
    """The key (of all twelve) whose template fits a sequence's pitch classes best."""
    dim = _rows(*((k, p, KEY_WEIGHTS[(p - k) % 12]) for k in range(12) for p in range(12)))
    return f"""select seq_id, key from (select seq_id, k.c0 as key, row_number() over (partition by seq_id order by round(sum(k.c2 * n), 6) desc, k.c0) as rk from (select seq_id, pitch % 12 as pc, count(*) as n from {{notes}} group by seq_id, pitch % 12) h
 join ({dim}) k on h.pc = k.c1 group by seq_id, k.c0) t where rk = 1"""


@operator
def corpus_summary(top: int = 5) -> str:
    """The commonest programs (channels) of a corpus, all others as one row."""
    return f"""select case when rk <= {top} then cast(channel as string) else 'other' end as program, cast(sum(n) as bigint) as n, count(*) as n_programs from (select channel, n, row_number() over (order by n desc, channel) as rk
 from (select channel, count(*) as n from {{notes}} group by channel) t) u group by 1"""


@operator
def loop_density(beats: int = 4) -> str:
    """Note sets of some length for each beat."""
    return f"select seq_id, round(sum(case when dur > 0 then 1 else 0 end) / {float(beats)}, 6) as density from {{notes}} group by seq_id"


def depth_of(time: str, quarter: int, most: int = 6) -> str:
    """The coarsest division of a quarter that a tick falls on: binary divisions even, ternary odd."""
    levels = "".join(f" when ({time}) % {max(1, quarter >> k)} = 0 then {2 * k}" + (f" when ({time}) * 3 % {max(1, quarter >> k)} = 0 then {2 * k + 1}" if 2 * k + 1 <= most else "") for k in range(most // 2 + 1))
    return f"case{levels} else {most} end"


@operator
def metric_depth(quarter: int = 8, most: int = 6) -> str:
    return f"select seq_id, pos, {depth_of('onset', quarter, most)} as depth from {{notes}}"


@operator
def median_metric_depth(d, quarter: int = 8, most: int = 6) -> str:
    """The whole part of a sequence's median depth."""
    return f"select seq_id, {d.trunc(d.percentile('depth', 0.5))} as depth from ({metric_depth.text(quarter=quarter, most=most)}) t group by seq_id"


@operator
def interval_vector() -> str:
    """Pairs of a sequence's pitch classes by interval class 1 to 6."""
    ic = "least(abs(a.pc - b.pc), 12 - abs(a.pc - b.pc))"
    return f"""with p as (select distinct seq_id, pitch % 12 as pc from {{notes}}) select a.seq_id, {ic} as ic, count(*) as n from p a join p b on a.seq_id = b.seq_id and a.pc < b.pc group by a.seq_id, {ic}"""


@operator
def suffix_triplet() -> str:
    """The commonest last three values of sequences whose length three divides, with its share."""
    return """select triplet, n, round(n / cast(total as double), 8) as share from (select triplet, count(*) as n, sum(count(*)) over () as total, row_number() over (order by count(*) desc, triplet) as rk from (
 select seq_id, max(case when back = 3 then cast(pitch as string) end) || ' ' || max(case when back = 2 then cast(pitch as string) end) || ' ' || max(case when back = 1 then cast(pitch as string) end) as triplet
 from (select seq_id, pitch, row_number() over (partition by seq_id order by pos desc) as back from {notes}) t group by seq_id having count(*) >= 3) u group by triplet) v where rk = 1"""


@operator
def row_summaries(d) -> str:
    """Mean, population deviation, median and variance of each vector."""
    return f"""select vec_id, round(avg(x), 5) as mean, round(stddev_pop(x), 5) as dev, round({d.percentile('x', 0.5)}, 5) as median, round(var_pop(x), 5) as variance
 from (select vec_id, cast(x as double) as x from (select vec_id, {d.explode}(embedding) as x from {{vectors}}) t) u group by vec_id"""


@operator
def octaves_used() -> str:
    return f"select seq_id, {floor_div('pitch', 12)} as octave, count(*) as n from {{notes}} group by 1, 2"
