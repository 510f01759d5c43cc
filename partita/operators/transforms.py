"""Projections, filters and repairs of notes (seq_id, pos, onset, dur, channel, pitch, velocity)."""

from __future__ import annotations

import re

from partita.operators import floor_div, mod, operator

DRUMS = 9
_ALL = "seq_id, pos, onset, dur, channel, pitch, velocity"


@operator
def keep_channels(channels: tuple = (0, 1, 2)) -> str:
    """Notes on the channels; events without a channel pass, and no channels keep nothing."""
    listed = ", ".join(map(str, channels))
    return f"select {_ALL} from {{notes}} where " + (f"channel is null or channel in ({listed})" if channels else "false")


@operator
def score_kind() -> str:
    """Per sequence: 'score' if the first event that tells is a note, 'opus' if it is a note_on, else ''."""
    return """select seq_id, coalesce(max(case when rk = 1 then case kind when 'note' then 'score' else 'opus' end end), '') as kind
 from (select seq_id, kind, case when kind in ('note', 'note_on') then row_number() over (partition by seq_id, kind in ('note', 'note_on') order by pos) end as rk from {events}) t group by seq_id"""


@operator
def transpose(amount: int = 7, low: int = 0, high: int = 127, drums: int = DRUMS) -> str:
    """Moves pitches; notes that leave [low, high] are deleted, drums stay as they are."""
    return f"""select seq_id, pos, onset, dur, channel, case when channel = {drums} then pitch else pitch + {amount} end as pitch, velocity
 from {{notes}} where channel = {drums} or pitch + {amount} between {low} and {high}"""


@operator
def transpose_melody(amount: int = 3) -> str:
    """Adds to every pitch, with no bounds."""
    return f"select seq_id, pos, onset, dur, channel, pitch + {amount} as pitch, velocity from {{notes}}"


@operator
def transpose_folded(amount: int = 7, low: int = 48, high: int = 84) -> str:
    """Transposes a melody and folds pitches by octaves into [low, high)."""
    p = f"(pitch + {amount})"
    return f"""select seq_id, pos, onset, case when {p} < {low} then {low} + {mod(f'{p} - {low}', 12)}
 when {p} >= {high} then {high} - 12 + {mod(f'{p} - {high}', 12)} else {p} end as pitch from {{notes}}"""


@operator
def squash(low: int = 48, high: int = 72, key: int = 0) -> str:
    """Moves each sequence to a key and to the octaves nearest the middle of [low, high), then folds it in."""
    shift = f"({key} - home + 12 * cast(floor(({low} + {high}) / 24.0 - (mean + {key} - home) / 12.0 + 0.5) as int))"
    p = f"(pitch + {shift})"
    return f"""with tones as (select seq_id, pitch % 12 as pc, count(*) as n from {{notes}} group by seq_id, pitch % 12),
 home as (select seq_id, pc as home from (select seq_id, pc, row_number() over (partition by seq_id order by n desc, pc) as rk from tones) t where rk = 1),
 means as (select seq_id, avg(cast(pitch as double)) as mean from {{notes}} group by seq_id)
 select n.seq_id, pos, case when {p} < {low} then {low} + {mod(f'{p} - {low}', 12)} when {p} >= {high} then {high} - 12 + {mod(f'{p} - {high}', 12)} else {p} end as pitch
 from {{notes}} n join home h on n.seq_id = h.seq_id join means m on n.seq_id = m.seq_id"""


@operator
def flip_melody(d) -> str:
    """Mirrors pitches (127 - pitch) and moves them back by the difference of the means, cut to a whole number."""
    mean = "avg(cast(pitch as double)) over (partition by seq_id)"
    return f"select seq_id, pos, 127 - pitch + {d.trunc(f'({mean}) - (127 - {mean})')} as pitch from {{notes}}"


@operator
def reverse_melody(full: bool = True) -> str:
    """Reverses a sequence in time, or only its pitches over the same times."""
    back = "row_number() over (partition by seq_id order by pos desc)"
    if full:
        return f"select seq_id, {back} as pos, max(onset + dur) over (partition by seq_id) - onset - dur as onset, dur, pitch from {{notes}}"
    return f"""select a.seq_id, a.pos, a.onset, a.dur, b.pitch from (select seq_id, pos, onset, dur, row_number() over (partition by seq_id order by pos) as k from {{notes}}) a
 join (select seq_id, pitch, {back} as k from {{notes}}) b on a.seq_id = b.seq_id and a.k = b.k"""


@operator
def scale_timings(d, average: int = 10) -> str:
    """Scales onsets and durations so that a sequence's mean duration comes to ``average``."""
    ratio = f"({average} / nullif(avg(cast(dur as double)) over (partition by seq_id), 0))"
    return f"select seq_id, pos, {d.trunc(f'onset * {ratio}')} as onset, {d.trunc(f'dur * {ratio}')} as dur, pitch from {{notes}}"


@operator
def replace_values(threshold: int = 64, value: int = 0, above: bool = False) -> str:
    """Replaces velocities over (or under) a threshold."""
    return f"select seq_id, pos, case when velocity {'>' if above else '<'} {threshold} then {value} else velocity end as velocity from {{notes}}"


@operator
def drop_outliers(z: float = 1.3) -> str:
    """Rows whose duration and pitch are within z population deviations of the sequence's means."""
    parts = [f"round(abs({c} - avg(cast({c} as double)) over (partition by seq_id)), 6) < round({z} * stddev_pop(cast({c} as double)) over (partition by seq_id), 6)" for c in ("dur", "pitch")]
    return f"select seq_id, pos, dur, pitch from (select *, {' and '.join(parts)} as fine from {{notes}}) t where fine"


@operator
def drop_invalid() -> str:
    """Notes that end after they begin."""
    return f"select {_ALL} from {{notes}} where dur > 0"


@operator
def drop_redundant() -> str:
    """State events that differ from the one before of their kind and channel in more than the time."""
    w = "partition by seq_id, kind, channel order by time, pos"
    return f"""select seq_id, pos, time, kind, channel, value from (select *, lag(value) over ({w}) as prev, row_number() over ({w}) as rk from {{states}}) t
 where rk = 1 or not (value is not distinct from prev)"""


@operator
def shift_times(seconds: float = 1.5) -> str:
    """Adds to all times; only forward."""
    if seconds <= 0:
        raise ValueError("a shift must be over 0")
    return f"select seq_id, pos, onset + {seconds} as onset, dur, pitch from {{notes}}"


@operator
def stretch(factor: float = 1.5) -> str:
    """Multiplies times; a tempo of 120 a minute is divided by the same."""
    return f"select seq_id, pos, onset * cast({factor} as double) as onset, dur * cast({factor} as double) as dur, pitch, 120 / cast({factor} as double) as qpm from {{notes}}"


@operator
def adjust_times(function: str = "t * t / 10.0", least: float | None = 0.1) -> str:
    """Applies a monotone function of t (SQL) to starts and ends; notes that come to nothing last ``least`` or go."""
    start, stop = (re.sub(r"\bt\b", x, function) for x in ("cast(onset as double)", "cast(onset + dur as double)"))
    end, keep = (f"case when b <= a then a + {least} else b end", "") if least is not None else ("b", " where b > a")
    return f"select seq_id, pos, a as start, {end} as stop, pitch from (select seq_id, pos, pitch, {start} as a, {stop} as b from {{notes}}) n{keep}"


@operator
def rectify_beats(bpm: float = 60.0) -> str:
    """Warps onsets so that beats (seq_id, time; the first of all at 0) fall every 60 / bpm seconds, straight between them."""
    return f"""with b as (select seq_id, time, row_number() over (partition by seq_id order by time) - 1 as k, lead(time) over (partition by seq_id order by time) as next from {{beats}})
 select n.seq_id, n.pos, n.pitch, (k + (cast(onset as double) - time) / (next - time)) * 60.0 / {bpm} as onset from {{notes}} n join b on n.seq_id = b.seq_id and n.onset >= b.time and n.onset < b.next"""


@operator
def augment(stretch: tuple = (0.9, 1.1), shift: tuple = (-3, 3), low: int = 0, high: int = 127, seed: int = 7) -> str:
    """Stretches and transposes each sequence by amounts that follow its number and the seed, kept so that every pitch stays in range."""
    u = lambda k: f"((seq_id * {2 * k + 1}0007 + {seed * 101 + k * 577}) % 1000) / 1000.0"
    amount = f"cast(floor(greatest({shift[0]}, {low} - lowest) + ({u(2)}) * (least({shift[1]}, {high} - highest) - greatest({shift[0]}, {low} - lowest) + 1)) as int)"
    return f"""select seq_id, pos, round(onset * factor, 6) as onset, round(dur * factor, 6) as dur, pitch + case when top >= bottom then amount else 0 end as pitch from (
 select *, {stretch[0]} + ({u(1)}) * {stretch[1] - stretch[0]} as factor, {amount} as amount, least({shift[1]}, {high} - highest) as top, greatest({shift[0]}, {low} - lowest) as bottom from (
 select *, min(pitch) over (partition by seq_id) as lowest, max(pitch) over (partition by seq_id) as highest from {{notes}}) t) u"""


@operator
def retarget(to_pitch: int = 60, to_velocity: int = -1) -> str:
    """Moves each sequence's lower median pitch (and velocity, where asked for) to a target."""
    median = lambda c: f"max(case when rk_{c} = floor((n + 1) / 2.0) then {c} end) over (partition by seq_id)"
    velocity = f"velocity + {to_velocity} - mv" if to_velocity >= 0 else "velocity"
    return f"""select seq_id, pos, pitch + {to_pitch} - mp as pitch, {velocity} as velocity from (select *, {median('pitch')} as mp, {median('velocity')} as mv from (
 select *, count(*) over (partition by seq_id) as n, row_number() over (partition by seq_id order by pitch, pos) as rk_pitch, row_number() over (partition by seq_id order by velocity, pos) as rk_velocity from {{notes}}) t) u"""


@operator
def rebase_timings(d, max_delta: int = 1, fixed: int = 300, start: int = 0, multiplier: int = 10) -> str:
    """New onsets from the gaps: a gap over ``max_delta`` becomes ``fixed``; onsets and durations come in tens."""
    gap = "onset - lag(onset) over (partition by seq_id order by pos)"
    return f"""select seq_id, pos, cast({d.bround(f'sum(step) over (partition by seq_id order by pos rows between unbounded preceding and current row)', -1)} as bigint) as onset,
 cast({d.bround(f'dur * {multiplier}', -1)} as bigint) as dur, pitch from (select seq_id, pos, dur, pitch, case when gap is null then {start} when gap > {max_delta} then {fixed} else gap * {multiplier} end as step
 from (select *, {gap} as gap from {{notes}}) t) u"""


@operator
def timeshift(shift: int = -2, from_time: int = 2) -> str:
    """Moves events from ``from_time`` on; moving back deletes what would be overrun, and nothing goes under 0."""
    gone = f" where not (onset >= {from_time} + ({shift}) and onset < {from_time})" if shift < 0 else ""
    return f"select seq_id, pos, greatest(0, case when onset >= {from_time} then onset + ({shift}) else onset end) as onset, dur, pitch from {{notes}}{gone}"


@operator
def scale_velocities(d, most: int = 124, threshold: int = 56) -> str:
    """Quiet sequences (mean velocity under the threshold) are scaled to a largest velocity, cut to whole numbers."""
    return f"""select seq_id, pos, case when mean < {threshold} then {d.trunc(f'velocity * (cast({most} as double) / top)')} else velocity end as velocity
 from (select *, avg(cast(velocity as double)) over (partition by seq_id) as mean, max(velocity) over (partition by seq_id) as top from {{notes}}) t"""


@operator
def repair_flat_dynamics(threshold: float = 0.95, drums: int = DRUMS) -> str:
    """Where one velocity has over a share of a channel's notes, velocities follow pitch: clamp(pitch + shift, 36, 124)."""
    return f"""with v as (select seq_id, channel, velocity, count(*) as n from {{notes}} group by seq_id, channel, velocity),
 c as (select seq_id, channel, cast(max(n) as double) / sum(n) as share from v group by seq_id, channel),
 m as (select seq_id, channel, avg(cast(pitch as double)) as mean from {{notes}} group by seq_id, channel)
 select n.seq_id, n.pos, case when share > {threshold} then greatest(36, least(124, case when n.channel = {drums} then 70 else pitch + cast(case when mean < 48 then 48 else floor(mean / 4.0) end as int) end)) else velocity end as velocity
 from {{notes}} n join c on n.seq_id = c.seq_id and n.channel = c.channel join m on n.seq_id = m.seq_id and n.channel = m.channel"""


@operator
def selected_notes(channel: int = -1, transposed: int = 0, flipped: int = 0, drums: int = DRUMS) -> str:
    """Channel -1: all but drums, 16: all, else that one; pitches moved and, if asked, mirrored; rests and silent notes go."""
    where = {-1: f"channel <> {drums}", 16: "true"}.get(channel, f"channel = {channel}")
    pitch = f"{'127 - ' if flipped else ''}(pitch + {transposed})" if flipped else f"pitch + {transposed}"
    return f"select seq_id, pos, onset, dur, channel, {pitch} as pitch, velocity from {{notes}} where {where} and pitch > 0 and velocity > 0"


@operator
def hop_pitches(d, times: float = 1.0) -> str:
    """Onsets in whole steps by rounding halves up, as int(x * steps + 0.5)."""
    return f"select seq_id, pos, {d.trunc(f'onset * cast({times} as double) + 0.5')} as step from {{notes}}"


@operator
def valid_sentences(d) -> str:
    """Texts of documents that are not empty and have no quote or bracket that is not closed at a word."""
    bad = r"""(^\x27)|(\x27$)|\s\x27|\x27\s|["()\[\]]"""
    return f"select doc_id, {d.matches('text', chr(92) + 'S')} and not {d.matches('text', bad)} as fine from {{docs}} where text is not null"


@operator
def wrap_midi(channels: int = 16, values: int = 128) -> str:
    """Channels, pitches and velocities brought into their ranges by remainders."""
    return f"select seq_id, pos, {mod('channel + 20', channels)} as channel, {mod('pitch + 200', values)} as pitch, {mod('velocity', values)} as velocity, {floor_div('pitch + 200', values)} as wraps from {{notes}}"
