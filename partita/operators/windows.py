"""Groupings, slices, sessions, quantising and rolls: operators that depend on a sequence's order."""

from __future__ import annotations

from partita.operators import floor_div, mod, operator


@operator
def chordified(divider: int = 1) -> str:
    """Chord numbers: neighbouring notes with equal whole onset / divider."""
    beat = floor_div("onset", divider)
    return f"""select seq_id, pos, pitch, sum(fresh) over (partition by seq_id order by pos rows between unbounded preceding and current row) as chord
 from (select seq_id, pos, pitch, case when beat = lag(beat) over (partition by seq_id order by pos) then 0 else 1 end as fresh from (select *, {beat} as beat from {{notes}}) t) u"""


@operator
def without_duplicates(divider: int = 1) -> str:
    """The first note of each channel and pitch in a chord, with the number of those it stands for."""
    by = f"seq_id, {floor_div('onset', divider)}, channel, pitch"
    return f"select seq_id, pos, onset, dur, channel, pitch, velocity, n from (select *, row_number() over (partition by {by} order by pos) as rk, count(*) over (partition by {by}) as n from {{notes}}) t where rk = 1"


def _fixed(by: str, gap: int, least: int, most: int, drums: str) -> str:
    clamp = f"least({most}, greatest({least}, dur))"
    return f"""select seq_id, pos, onset, case when {drums} or next is null then dur when onset + {clamp} + {gap} > next then next - onset - {gap} else {clamp} end as dur, channel, pitch, velocity
 from (select *, lead(onset) over (partition by {by} order by onset, pos) as next from {{notes}}) t where {drums} or next is null or onset + {clamp} + {gap} <= next or next - onset - {gap} >= {least}"""


@operator
def monophonic_durations(gap: int = 0, least: int = 1, most: int = 500) -> str:
    """Durations within [least, most], cut at the next onset less a gap; notes that get too short go, the last stays as it is."""
    return _fixed("seq_id", gap, least, most, "false")


@operator
def fixed_durations(gap: int = 0, least: int = 1, most: int = 500, drums: int = 9) -> str:
    """The same for each channel and pitch apart; drums stay as they are."""
    return _fixed("seq_id, channel, pitch", gap, least, most, f"channel = {drums}")


@operator
def ordered_groups(d) -> str:
    """Channels in the order in which they come first, each with its pitches in order."""
    return f"select seq_id, channel, row_number() over (partition by seq_id order by first) as place, pitches from (select seq_id, channel, min(pos) as first, {d.joined(d.alist('cast(pitch as string)', 'pos'), ' ')} as pitches from {{notes}} group by seq_id, channel) t"


@operator
def first_seen_set(d) -> str:
    """Distinct pitches in the order in which they come first."""
    return f"select seq_id, {d.joined(d.alist('cast(pitch as string)', 'first'), ' ')} as pitches from (select seq_id, pitch, min(pos) as first from {{notes}} group by seq_id, pitch) t group by seq_id"


@operator
def chords(d, single: bool = True, last: bool = True) -> str:
    """Chords by onset with pitches from high to low and mean duration and velocity; optionally without single notes or a sequence's last chord."""
    where = " and ".join((["n > 1"] if not single else []) + (["after is not null"] if not last else [])) or "true"
    return f"""select seq_id, onset, n, pitches, dur, velocity from (select *, lead(onset) over (partition by seq_id order by onset) as after from (
 select seq_id, onset, count(*) as n, {d.joined(d.alist('cast(pitch as string)', '-pitch', 'pos'), ' ')} as pitches, round(avg(cast(dur as double)), 6) as dur, round(avg(cast(velocity as double)), 6) as velocity from {{notes}} group by seq_id, onset) t) u where {where}"""


@operator
def chord_pairs(d) -> str:
    """Chords that follow each other."""
    c = chords.text(d, last=True)
    return f"select seq_id, onset, pitches, after from (select seq_id, onset, pitches, lead(pitches) over (partition by seq_id order by onset) as after from ({c}) c) p where after is not null"


@operator
def voices(d, offset: int = 30) -> str:
    """One row an onset: flat chord (high to low), melody (highest), bass (lowest) and the text of the melody's steps as characters."""
    return f"""select seq_id, onset, max(pitch) as melody, min(pitch) as bass, {d.joined(d.alist('cast(pitch as string)', '-pitch', 'pos'), ' ')} as chord, chr(cast({offset} + max(pitch) as int)) as letter from {{notes}} group by seq_id, onset"""


@operator
def slices(size: int = 3) -> str:
    """Tumbling slices of time with their number of notes, highest and lowest pitch."""
    return f"select seq_id, {floor_div('onset', size)} as slice, count(*) as n, max(pitch) as high, min(pitch) as low from {{notes}} group by 1, 2"


@operator
def slice_features(size: int = 3) -> str:
    """Slices with means of melody and bass (highest and lowest of each onset) and the running mean of the melody."""
    return f"""select seq_id, slice, melody, bass, round(avg(melody) over (partition by seq_id order by slice rows between unbounded preceding and current row), 6) as running from (
 select seq_id, {floor_div('onset', size)} as slice, round(avg(cast(high as double)), 6) as melody, round(avg(cast(low as double)), 6) as bass from (select seq_id, onset, max(pitch) as high, min(pitch) as low from {{notes}} group by seq_id, onset) t group by 1, 2) u"""


@operator
def slice_pairs(size: int = 3) -> str:
    return f"select seq_id, slice, after from (select seq_id, slice, lead(slice) over (partition by seq_id order by slice) as after from ({slices.text(size=size)}) s) t where after is not null"


@operator
def last_chord() -> str:
    """The notes of a sequence's last onset."""
    return "select seq_id, pos, pitch from (select *, rank() over (partition by seq_id order by onset desc) as rk from {notes}) t where rk = 1"


@operator
def list_slices(n: int = 3) -> str:
    """Equal parts of n notes by place."""
    return f"select seq_id, pos, {floor_div('pos - 1', n)} as part, {mod('pos - 1', n)} as place from {{notes}}"


@operator
def hop_split(hop: int = 3, skip_inside: bool = False) -> str:
    """Notes by hops of time, cut at the hop's end and set back to its start; optionally not split where a note sounds."""
    if not skip_inside:
        return f"select seq_id, pos, {floor_div('onset', hop)} as part, onset - {hop} * {floor_div('onset', hop)} as onset, least(onset + dur, {hop} * ({floor_div('onset', hop)} + 1)) - onset as dur, pitch from {{notes}}"
    return f"""with s as (select distinct seq_id, {hop} * {floor_div('onset', hop)} as t from {{notes}}),
 fine as (select seq_id, t from s where not exists (select 1 from {{notes}} n where n.seq_id = s.seq_id and n.onset < s.t and n.onset + n.dur > s.t))
 select n.seq_id, n.pos, n.pitch, count(f.t) as part from {{notes}} n left join fine f on f.seq_id = n.seq_id and f.t <= n.onset group by n.seq_id, n.pos, n.pitch"""


@operator
def silence_sessions(gap: float = 0.0, dur: str = "dur % 2") -> str:
    """Sessions that a silence of over ``gap`` after all that sounded before begins."""
    return f"""select seq_id, pos, sum(fresh) over (partition by seq_id order by onset, pos rows between unbounded preceding and current row) as session
 from (select seq_id, pos, onset, case when onset > coalesce(max(onset + {dur}) over (partition by seq_id order by onset, pos rows between unbounded preceding and 1 preceding), onset) + {gap} then 1 else 0 end as fresh from {{notes}}) t"""


@operator
def change_sections(kind: str = "tempo") -> str:
    """Sections that begin where a state really changes."""
    return f"""with c as (select seq_id, time from (select *, lag(value) over (partition by seq_id, kind order by time, pos) as prev from {{states}} where kind = '{kind}') t where prev is not null and prev <> value)
 select n.seq_id, n.pos, n.pitch, count(distinct c.time) as section from {{notes}} n left join c on c.seq_id = n.seq_id and c.time <= n.onset group by n.seq_id, n.pos, n.pitch"""


@operator
def sustained(pedal: int = 64) -> str:
    """Ends of notes under a pedal: the next note of the pitch or the pedal's release, whichever is first, if the pedal is down when the note ends."""
    return """with downs as (select seq_id, time as down, lead(time) over (partition by seq_id order by time) as up, value from {pedals}),
 held as (select seq_id, down, up from downs where value >= 64 and up is not null)
 select n.seq_id, n.pos, n.onset, n.pitch, max(case when h.up is null then n.stop else least(h.up, coalesce(n.next, h.up)) end) as stop from (
 select *, onset + dur as stop, lead(onset) over (partition by seq_id, pitch order by onset, pos) as next from {notes}) n left join held h on h.seq_id = n.seq_id and h.down <= n.stop and n.stop < h.up and (n.next is null or n.next > n.stop)
 group by n.seq_id, n.pos, n.onset, n.pitch"""


@operator
def quantised(d, steps: float = 2.5) -> str:
    """Starts and ends in steps, halves up; notes of no length last one step."""
    a, b = (d.trunc(f"{x} * cast({steps} as double) + 0.5") for x in ("onset", "(onset + dur)"))
    return f"select seq_id, pos, {a} as start, case when {b} = {a} then {b} + 1 else {b} end as stop, pitch from {{notes}}"


@operator
def quantised_relative(d, per_quarter: int = 4, qpm: float = 120.0) -> str:
    """The same in steps of a quarter at a tempo."""
    return quantised.text(d, steps=per_quarter * qpm / 60.0)


@operator
def concatenated() -> str:
    """Sequences one after the other (within a thousand of them), each after the lengths of those before."""
    return """with l as (select seq_id, max(onset + dur) as length from {notes} group by seq_id),
 o as (select seq_id, coalesce(sum(length) over (partition by cast(floor(seq_id / 1000.0) as bigint) order by seq_id rows between unbounded preceding and 1 preceding), 0) as offset_ from l)
 select n.seq_id, n.pos, n.onset + offset_ as onset, n.pitch from {notes} n join o on o.seq_id = n.seq_id"""


@operator
def repeated(d, duration: int = 100) -> str:
    """Copies of a sequence until a duration is full, cut there."""
    copies = d.range(0, f"cast(ceil({duration} / cast(length as double)) as int) - 1")
    return f"""select seq_id, pos, copy, onset + copy * length as onset, least(onset + dur + copy * length, {duration}) as stop, pitch from (
 select seq_id, pos, onset, dur, pitch, length, {d.explode}({copies}) as copy from (select *, max(onset + dur) over (partition by seq_id) as length from {{notes}}) t) u where onset + copy * length < {duration}"""


@operator
def expanded_sections(d) -> str:
    """Sections (seq_id, section, times) played as often as they say, in order."""
    return f"select seq_id, section, turn, row_number() over (partition by seq_id order by section, turn) as place from (select seq_id, section, {d.explode}({d.range(1, 'times')}) as turn from {{sections}}) t"


@operator
def melody_events() -> str:
    """The skyline per step until the first long gap: the highest note of a step, and whether a bar of silence came before."""
    return """select seq_id, onset, pitch from (select seq_id, onset, pitch, sum(cut) over (partition by seq_id order by onset rows between unbounded preceding and current row) as broken from (
 select seq_id, onset, pitch, case when onset - lag(stop) over (partition by seq_id order by onset) >= 16 then 1 else 0 end as cut from (
 select seq_id, onset, pitch, onset + dur as stop, row_number() over (partition by seq_id, onset order by pitch desc, pos) as rk from {notes}) t where rk = 1) u) v where broken = 0"""


@operator
def filled_states(d, kind: str = "chord") -> str:
    """The last state of a kind at each note."""
    return f"""select seq_id, pos, onset, {d.last('state', 'partition by seq_id order by onset, tie, pos rows between unbounded preceding and current row')} as state, tie from (
 select seq_id, pos, onset, cast(null as int) as state, 1 as tie from {{notes}} union all select seq_id, pos, time as onset, value as state, 0 as tie from {{states}} where kind = '{kind}') t"""


@operator
def finer(d, k: int = 3) -> str:
    """Each event k times."""
    return f"select seq_id, (pos - 1) * {k} + copy as pos, pitch from (select seq_id, pos, pitch, {d.explode}({d.range(1, k)}) as copy from {{notes}}) t"


@operator
def fixed_length(d, steps: int = 5, from_left: bool = False, fill: int = -2) -> str:
    """Sequences cut or filled to a length, at the end or at the start."""
    a = d.alist("pitch", "pos")
    filled = d.map(d.range(1, steps), "k", str(fill))
    body = d.part(d.concat(filled, "a"), f"{d.size}(a) + 1", steps) if from_left else d.part(d.concat("a", filled), 1, steps)
    return f"select seq_id, {d.joined(d.map(body, 'x', 'cast(x as string)'), ' ')} as pitches from (select seq_id, {a} as a from {{notes}} group by seq_id) t"


@operator
def beats(d, tempo: str = "96 + seq_id % 3 * 12", seconds: int = 4) -> str:
    """Times of beats until an end, every 60 / tempo seconds."""
    return f"select seq_id, beat, round(beat * 60.0 / ({tempo}), 6) as time from (select seq_id, {d.explode}({d.range(0, f'cast(ceil({seconds} * ({tempo}) / 60.0) as int) - 1')}) as beat from (select distinct seq_id from {{notes}}) s) t"


@operator
def downbeats(d, numerator: int = 4, tempo: str = "96 + seq_id % 3 * 12", seconds: int = 4) -> str:
    """Every numerator-th beat (every third of it in compound time)."""
    step = numerator // 3 if numerator % 3 == 0 and numerator != 3 else numerator
    return f"select seq_id, beat, time from ({beats.text(d, tempo=tempo, seconds=seconds)}) b where beat % {step} = 0"


@operator
def onsets() -> str:
    return "select seq_id, onset, row_number() over (partition by seq_id order by onset, pos) as place from {notes}"


@operator
def piano_roll(d, per_frame: int = 10) -> str:
    """Velocities summed over the notes that sound in each frame and pitch (only cells that are not zero)."""
    frames = d.range(floor_div("onset", 1), floor_div(f"onset + dur / {per_frame}.0", 1))
    return f"select seq_id, frame, pitch, cast(sum(velocity) as bigint) as velocity from (select seq_id, pitch, velocity, {d.explode}({frames}) as frame from {{notes}}) t group by seq_id, frame, pitch"


@operator
def chroma(d, per_frame: int = 10) -> str:
    """The roll by pitch class."""
    return f"select seq_id, frame, pitch % 12 as pc, cast(sum(velocity) as bigint) as velocity from ({piano_roll.text(d, per_frame=per_frame)}) r group by seq_id, frame, pitch % 12"


@operator
def label_rolls(d, per_frame: int = 10) -> str:
    """Active, onset and offset cells with the velocity of the latest note."""
    first, last = floor_div("onset", 1), floor_div(f"onset + dur / {per_frame}.0", 1)
    return f"""select seq_id, frame, pitch, max(on_) as onset, max(off_) as offset_, max(case when rk = 1 then velocity end) as velocity from (
 select *, row_number() over (partition by seq_id, frame, pitch order by onset desc, pos desc) as rk, case when frame = first then 1 else 0 end as on_, case when frame = last then 1 else 0 end as off_ from (
 select seq_id, pos, onset, pitch, velocity, {first} as first, {last} as last, {d.explode}({d.range(first, last)}) as frame from {{notes}}) t) u group by seq_id, frame, pitch"""


@operator
def notes_of_roll(least: int = 1) -> str:
    """Notes from a roll (seq_id, frame, pitch): runs of neighbouring frames."""
    return f"""select seq_id, pitch, min(frame) as start, max(frame) + 1 as stop from (select seq_id, pitch, frame, frame - row_number() over (partition by seq_id, pitch order by frame) as island from {{roll}}) t
 group by seq_id, pitch, island having count(*) >= {least}"""


@operator
def notes_of_onsets(length: float = 0.05, per_second: int = 20) -> str:
    """A note of fixed length at each onset cell."""
    return f"select seq_id, pitch, cast(frame as double) / {per_second} as start, cast(frame as double) / {per_second} + {length} as stop from {{roll}}"


@operator
def sounding_sets(d) -> str:
    """The pitch classes that sound between neighbouring starts and ends, where three or more do."""
    return f"""with edges as (select distinct seq_id, t from (select seq_id, onset as t from {{notes}} union all select seq_id, onset + dur as t from {{notes}}) e),
 spans as (select seq_id, t as a, lead(t) over (partition by seq_id order by t) as b from edges)
 select s.seq_id, a, b, {d.joined(d.map(d.sorted_set('pitch % 12'), 'x', 'cast(x as string)'), ' ')} as tones from spans s join {{notes}} n on n.seq_id = s.seq_id and n.onset <= s.a and n.onset + n.dur >= s.b
 where b is not null group by s.seq_id, a, b having count(distinct pitch % 12) >= 3"""


@operator
def pitch_vectors(d, frame: int = 10) -> str:
    """Time that each pitch class sounds in each frame, scaled to a vector of length 1."""
    frames = d.range(floor_div("onset", frame), floor_div("onset + dur - 1", frame))
    return f"""select seq_id, frame, pc, round(w / sqrt(sum(w * w) over (partition by seq_id, frame)), 6) as weight from (select seq_id, frame, pitch % 12 as pc, sum(cast(least(onset + dur, (frame + 1) * {frame}) - greatest(onset, frame * {frame}) as double)) as w from (
 select seq_id, onset, dur, pitch, {d.explode}({frames}) as frame from {{notes}}) t group by seq_id, frame, pitch % 12) u"""


@operator
def note_frames() -> str:
    """Between neighbouring starts and ends: which pitches sound, and which begin there."""
    return """with edges as (select distinct seq_id, t from (select seq_id, onset as t from {notes} union all select seq_id, onset + dur as t from {notes}) e),
 spans as (select seq_id, t as a, lead(t) over (partition by seq_id order by t) as b from edges)
 select s.seq_id, a, pitch, max(case when n.onset = a then 1 else 0 end) as begins from spans s join {notes} n on n.seq_id = s.seq_id and n.onset <= s.a and n.onset + n.dur >= s.b where b is not null group by s.seq_id, a, pitch"""


def _sets(d) -> str:
    return f"select seq_id, onset, {d.joined(d.map(d.sorted_set('pitch'), 'x', 'cast(x as string)'), ' ')} as tones, row_number() over (partition by seq_id order by onset) as i from {{notes}} group by seq_id, onset"


@operator
def note_sets(d) -> str:
    """Sets of pitches that begin together, in order."""
    return _sets(d)


@operator
def matching_runs(d, least: int = 1) -> str:
    """Runs of equal note sets at a distance: (first place, distance, length)."""
    return f"""with s as ({_sets(d)}), m as (select a.seq_id, a.i, b.i - a.i as dist from s a join s b on a.seq_id = b.seq_id and a.tones = b.tones and a.i < b.i),
 r as (select seq_id, dist, i, i - row_number() over (partition by seq_id, dist order by i) as island from m)
 select seq_id, dist, min(i) as first, count(*) as length from r group by seq_id, dist, island having count(*) >= {least}"""


@operator
def loops(d, least: int = 1, least_sets: int = 1, most: int = 32) -> str:
    """Runs that come back right after themselves: loops of ``dist`` sets with their number of repeats."""
    return f"select seq_id, first, dist, length, cast(floor(length / cast(dist as double)) as bigint) + 1 as times from ({matching_runs.text(d, least=least)}) r where length >= dist and dist between {least_sets} and {most}"


@operator
def merged_spans() -> str:
    """Overlapping or touching notes of one channel merged."""
    return """select seq_id, channel, min(onset) as start, max(stop) as stop, count(*) as n from (select seq_id, channel, onset, stop, sum(fresh) over (partition by seq_id, channel order by onset, pos rows between unbounded preceding and current row) as island from (
 select seq_id, channel, pos, onset, onset + dur % 3 as stop, case when onset <= max(onset + dur % 3) over (partition by seq_id, channel order by onset, pos rows between unbounded preceding and 1 preceding) then 0 else 1 end as fresh from {notes}) t) u
 group by seq_id, channel, island"""


@operator
def beats_between(quarter: int = 4) -> str:
    return f"select seq_id, pos, round(dur / {float(quarter)}, 6) as beats from {{notes}}"


@operator
def event_tokens(d, most: int = 100) -> str:
    """Notes as tokens: 0-127 on, 128-255 off, 256-355 time shifts of 1 to 100 (the largest repeated), 356-387 velocity."""
    shift = d.concat(d.map(d.range(1, f"cast(floor((gap - 1) / {float(most)}) as int)"), "k", str(255 + most)), f"case when gap > 0 then {d.array(f'cast(255 + (gap - 1) % {most} + 1 as int)')} else {d.range(1, 0)} end")
    loud = f"case when on_ = 1 and (vel <> coalesce(before, -1)) then {d.array('cast(356 + vel as int)')} else {d.range(1, 0)} end"
    last = d.last("case when on_ = 1 then vel end", "partition by seq_id order by time, on_, pitch, pos rows between unbounded preceding and 1 preceding")
    return f"""select seq_id, k, {d.joined(d.map(d.concat(shift, loud, d.array('cast(case when on_ = 1 then pitch else 128 + pitch end as int)')), 'x', 'cast(x as string)'), ' ')} as tokens from (
 select *, row_number() over (partition by seq_id order by time, on_, pitch, pos) as k, time - lag(time, 1, 0) over (partition by seq_id order by time, on_, pitch, pos) as gap, {last} as before from (
 select seq_id, pos, onset as time, pitch, cast(floor(velocity / 4.0) as int) as vel, 1 as on_ from {{notes}} union all select seq_id, pos, onset + dur as time, pitch, 0 as vel, 0 as on_ from {{notes}}) t) u"""
