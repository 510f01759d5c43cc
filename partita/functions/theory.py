"""Music theory: pitch-class sets, note names, spelled chords, scales and intervals, chord symbols.

The first part is SQL over columns; the second part are functions of plain values with frames of
them at the end, for which small tables are made by rule and joined.
"""

from __future__ import annotations

import re
from functools import lru_cache
from itertools import product

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partita.operators import mod, operator

# Note letters, scale degrees, program families
LETTERS = "cdefgab"
STEPS = {"c": 0, "d": 2, "e": 4, "f": 5, "g": 7, "a": 9, "b": 11}
NAMES = ("C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B")
FAMILIES = ("Piano", "Chromatic Percussion", "Organ", "Guitar", "Bass", "Strings", "Ensemble", "Brass", "Reed", "Pipe", "Synth Lead", "Synth Pad", "Synth Effects", "Ethnic", "Percussive", "Sound Effects")
KEYS = ("C", "Db", "D", "Eb", "E", "F", "Gb", "G", "Ab", "A", "Bb", "B")


# --- columns -----------------------------------------------------------------------------------


def note_number_to_hz(n: Column) -> Column:
    return 440.0 * F.pow(F.lit(2.0), (n - 69) / 12.0)


def hz_to_note_number(hz: Column) -> Column:
    return 12 * (F.log2(hz) - F.log2(F.lit(440.0))) + 69


def note_number_to_name(n: Column) -> Column:
    return F.concat(F.get(F.array(*map(F.lit, NAMES)), F.pmod(n, F.lit(12)).cast("int")), (F.floor(n / 12) - 1).cast("string"))


def note_name_to_number(name: Column) -> Column:
    """C4 is 60; sharps and flats add; null where it is no name."""
    parts = r"^([A-Ga-g])([#b!]*)(-?[0-9]+)$"
    letter, signs, octave = (F.regexp_extract(name, parts, k) for k in (1, 2, 3))
    base = F.create_map(*[x for k, v in STEPS.items() for x in (F.lit(k), F.lit(v))])
    sharp, flat = (F.length(signs) - F.length(F.translate(signs, c, "")) for c in ("#", "b!"))
    return F.when(F.regexp_like(name, F.lit(parts)), F.try_element_at(base, F.lower(letter)) + sharp - flat + 12 * (F.try_to_number(octave, F.lit("S99")).cast("int") + 1))


def pitch_bend_to_semitones(bend: Column, reach: float = 2.0) -> Column:
    return bend * reach / 8192.0


def qpm_to_bpm(qpm: Column, numerator: Column, denominator: Column) -> Column:
    """Beats a minute of a quarter tempo: compound time counts three as one; other denominators change nothing."""
    scaled = qpm * denominator / 4.0
    return F.when(~denominator.isin(1, 2, 4, 8, 16, 32), qpm).when((numerator != 3) & (numerator % 3 == 0), scaled / 3.0).otherwise(scaled)


# --- SQL operators over notes --------------------------------------------------------------------


@operator
def hz() -> str:
    return "select distinct pitch, round(440.0 * power(cast(2 as double), cast(pitch - 69 as double) / 12), 4) as hz, round(12 * (ln(440.0 * power(cast(2 as double), cast(pitch - 69 as double) / 12) / 440.0) / ln(2.0)) + 69, 4) as back from {notes}"


@operator
def note_names(d) -> str:
    return f"select distinct pitch, {d.at(d.array(*(repr(n) for n in NAMES)), 'pitch % 12 + 1')} || cast(cast(floor(pitch / 12.0) as int) - 1 as string) as name from {{notes}}"


@operator
def families(d) -> str:
    return f"select pitch as program, {d.at(d.array(*(repr(n) for n in FAMILIES)), 'cast(floor(pitch / 8.0) as int) + 1')} as family, count(*) as n from {{notes}} group by pitch"


@operator
def key_names(d) -> str:
    """Key numbers (0-11 major, 12-23 minor) with names."""
    return f"select distinct pitch % 24 as key, case when pitch % 24 < 12 then {d.at(d.array(*(repr(n) for n in KEYS)), 'pitch % 12 + 1')} || ' Major' else {d.at(d.array(*(repr(n.lower()) for n in KEYS)), 'pitch % 12 + 1')} || ' minor' end as name from {{notes}}"


@operator
def bends() -> str:
    return "select seq_id, pos, round((velocity * 64 - 4096) * 2.0 / 8192, 6) as semitones from {notes}"


@operator
def beat_tempo(qpm: float = 120.0) -> str:
    """Beats a minute for a few time signatures (channel as numerator, powers of two as denominator)."""
    return f"select distinct channel as numerator, d.x as denominator, round(case when d.x = 64 then {qpm} when channel <> 3 and channel % 3 = 0 then {qpm} * d.x / 4.0 / 3 else {qpm} * d.x / 4.0 end, 6) as bpm from {{notes}} cross join (select 2 as x union all select 4 union all select 8 union all select 64) d where channel > 0"


@operator
def tone_kind() -> str:
    return "select pitch % 12 as tone, case when pitch % 12 in (1, 3, 6, 8, 10) then 'BLACK' else 'WHITE' end as kind, count(*) as n from {notes} group by pitch % 12"


@operator
def chord_colour() -> str:
    """Colour class of each onset's pitch classes: only black, only white, or mixed."""
    return """select seq_id, onset, case when n = 1 then case when black = 1 then 'BLACK' else 'WHITE' end when black = 0 then 'WHITES' when black = n then 'BLACKS' else 'MIXED' end as colour from (
 select seq_id, onset, count(distinct pitch % 12) as n, count(distinct case when pitch % 12 in (1, 3, 6, 8, 10) then pitch % 12 end) as black from {notes} group by seq_id, onset) t"""


@operator
def hsv_to_rgb(s: float = 0.5, v: float = 0.8) -> str:
    """Colours of pitches: hue by pitch class."""
    h = "(pitch % 12) / 12.0 * 6"
    part = lambda n: f"round({v} - {v} * {s} * greatest(0.0, least(least(cast(({h} + {n}) as double) - 6 * floor(({h} + {n}) / 6), 4 - (cast(({h} + {n}) as double) - 6 * floor(({h} + {n}) / 6))), 1.0)), 6)"
    return f"select distinct pitch % 12 as pc, {part(5)} as r, {part(3)} as g, {part(1)} as b from {{notes}}"


def _classes(d) -> str:
    return f"select seq_id, {d.sorted_set('cast(pitch % 12 as int)')} as a from {{notes}} group by seq_id"


def _spell(d, a: str) -> str:
    return d.joined(d.map(a, "x_", "cast(x_ as string)"), " ")


def _rotations(d, a: str) -> str:
    """All rotations of a sorted set: [span, next-to-last span, first note, intervals over the first...]."""
    size = f"{d.size}({a})"
    step = mod(f"{d.at(a, f'1 + (i + j) % {size}')} - {d.at(a, 'i + 1')}", 12)
    intervals = d.map(d.range(0, f"{size} - 1"), "j", step)
    last = lambda k: mod(f"{d.at(a, f'1 + (i + {size} - {k}) % {size}')} - {d.at(a, 'i + 1')}", 12)
    return d.map(d.range(0, f"{size} - 1"), "i", d.concat(d.array(f"cast({last(1)} as int)", f"cast(case when {size} > 1 then {last(2)} else 0 end as int)", "cast(i as int)"), d.map(intervals, "y", "cast(y as int)")))


def _least(d, a: str) -> str:
    return f"list_min({a})" if d.name == "duck" else f"array_min({a})"


def _normal(d, a: str) -> str:
    """The tightest rotation (by span, then next-to-last span, then place) as intervals over its first note."""
    return d.part(_least(d, _rotations(d, a)), 4, f"{d.size}({a})")


@operator
def normal_forms(d) -> str:
    """The tightest rotation of each sequence's pitch classes."""
    first = d.at("a", f"{d.at(_least(d, _rotations(d, 'a')), 3)} + 1")
    body = d.map(_normal(d, "a"), "x", mod(f"x + {first}", 12))
    return f"select seq_id, {_spell(d, body)} as form from ({_classes(d)}) t"


@operator
def prime_forms(d) -> str:
    """The tighter of the normal form and its inversion's, from 0."""
    inverse = d.sort(d.map("f", "x", mod("12 - x", 12)))
    tie = lambda x: f"case when {d.size}({x}) > 1 then {d.at(x, f'{d.size}({x}) - 1')} else 0 end"
    return f"""select seq_id, case when {tie('f')} <= {tie('g')} then {_spell(d, 'f')} else {_spell(d, 'g')} end as form from (select seq_id, f, {_normal(d, 'inv')} as g from (
 select seq_id, f, {inverse} as inv from (select seq_id, {_normal(d, 'a')} as f from ({_classes(d)}) t) u) v) w"""


@operator
def twelve_tone_matrix(d) -> str:
    """Row and column of each sequence's matrix over its distinct tones in order: inversions down, the row across."""
    row = f"select seq_id, {d.alist('pc', 'first')} as a from (select seq_id, cast(pitch % 12 as int) as pc, min(pos) as first from {{notes}} group by seq_id, pitch % 12) t group by seq_id"
    line = d.map("a", "x", mod(f"x - y + {d.at('a', 1)}", 12))
    return f"select seq_id, i, {_spell(d, 'line')} as tones from (select seq_id, i, {line} as line from (select seq_id, a, {d.numbered('a', 'i', 'y')} from ({row}) r) t) u"


@operator
def transposed_set(d, index: int = 5) -> str:
    return f"select seq_id, {_spell(d, d.map('a', 'x', mod(f'x + {index}', 12)))} as tones from ({_classes(d)}) t"


@operator
def inverted_set(d, index: int = 0) -> str:
    return f"select seq_id, {_spell(d, d.map('a', 'x', mod(f'{index} - x', 12)))} as tones from ({_classes(d)}) t"


@operator
def rotated(d, n: int = 1) -> str:
    size = f"{d.size}(a)"
    return f"select seq_id, {_spell(d, d.concat(d.part('a', f'1 + {n} % {size}', size), d.part('a', 1, f'{n} % {size}')))} as tones from ({_classes(d)}) t"


@operator
def related_sets(d) -> str:
    """Neighbouring sequences (by number) whose pitch-class sets are transpositions of each other."""
    return f"select a.seq_id, b.seq_id as other from (select seq_id, {_spell(d, _normal(d, 'a'))} as f from ({_classes(d)}) t) a join (select seq_id, {_spell(d, _normal(d, 'a'))} as f from ({_classes(d)}) t) b on a.seq_id + 1 = b.seq_id and a.f = b.f"


@operator
def scale_steps(d) -> str:
    """Gaps between neighbouring pitch classes of a sequence."""
    return f"select seq_id, {_spell(d, d.map(d.range(1, f'{d.size}(a) - 1'), 'i', d.at('a', 'i + 1') + ' - ' + d.at('a', 'i')))} as steps from ({_classes(d)}) t"


@operator
def scales_that_hold(d, altered: int = 1) -> str:
    """Major scales that hold all of a sequence's pitch classes, or all but so many that lie a semitone beside one."""
    rows = "select * from (values " + ", ".join(f"({k}, {(k + p) % 12})" for k in range(12) for p in (0, 2, 4, 5, 7, 9, 11)) + ") as v_(k, pc)"
    return f"""with p as (select distinct seq_id, pitch % 12 as pc from {{notes}}), n as (select seq_id, count(*) as n from p group by seq_id)
 select p.seq_id, s.k as scale, max(n.n) - count(*) as altered from p join ({rows}) s on p.pc = s.pc join n on n.seq_id = p.seq_id where n.n >= 2 group by p.seq_id, s.k having max(n.n) - count(*) <= {altered}"""


@operator
def negative_harmony(key: int = 0) -> str:
    """Pitch classes mirrored about the axis between a key's tonic and dominant."""
    return f"select seq_id, pos, {mod(f'{2 * key + 7} - pitch', 12)} as tone from {{notes}}"


@operator
def fixed_chords(d) -> str:
    """Onsets' chords brought to the largest part, first by pitch class, that has no two semitone steps in a row."""
    near = f"({mod('b.pc - a.pc', 12)}) = 1"
    return f"""with p as (select distinct seq_id, onset, pitch % 12 as pc from {{notes}}),
 bad as (select distinct b.seq_id, b.onset, b.pc from p a join p b on a.seq_id = b.seq_id and a.onset = b.onset and {near} join p c on c.seq_id = b.seq_id and c.onset = b.onset and ({mod('c.pc - b.pc', 12)}) = 1)
 select p.seq_id, p.onset, {_spell(d, d.sorted_set('cast(p.pc as int)'))} as tones from p left join bad on bad.seq_id = p.seq_id and bad.onset = p.onset and bad.pc = p.pc where bad.pc is null group by p.seq_id, p.onset"""


# --- spelled notes -----------------------------------------------------------------------------------


class NoMatch(ValueError):
    """A name that cannot be spelled or is not known."""


# Accidentals by half steps, and the notes on c with the names that they are known by
_SIGNS = {-2: "bb", -1: "b", 0: "", 1: "#", 2: "x"}
CHORDS = """c e g =
c g a = 6
c e g b = Maj7
c e f# b = Maj7(#11)
c e g d = add(9)
c d e b = Maj7(9)
c d e a = 6(9)
c e g# = aug or +
c eb g = m
c eb g d = madd(9)
c eb g bb = m7
c d eb bb = m7(9)
c eb g b = mMaj7
c d eb b = mMaj7(9)
c eb f# = dim
c eb f# a = dim7
c e g bb = 7
c e bb = 7
c f g bb = 7sus4
c e f# bb = 7(b5)
c d e bb = 7(9)
c e a bb = 7(13)
c c# e bb = 7(b9)
c e g# bb = 7(b13)
c eb e bb = 7(#9)
c f g = sus4
c e g a d = 6/9
c e g b d = Maj9
c e g bb d = 9
c e g bb d a = 13
c eb g a = m6
c eb g a d = m6/9
c eb a d = m6/9
c eb g a bb = m7add(13)
c eb g bb d = m9
c eb g bb d f = m11
c eb g bb d f a = m13
c eb g b d = m9Maj7
c eb gb bb d = m9(b5)
c eb gb bb d f = m11(b5)
c e g# b = Maj7(#5)
c e g b f# = Maj7(#11)
c e g b d f# = Maj9(#11)
c e g bb db = 7(b9)
c e g bb d# = 7(#9)
c e g# bb d# = 7(#5)(#9)
c e g bb f# = 7(#11)
c e g bb d f# = 9(#11)
c e g bb db f# = 7(b9)(#11)
c e g bb d# f# = 7(#9)(#11)
c e gb bb d a = 13(b5)
c e g bb db a = 13(b9)
c e g bb d f# a = 13(#11)
c g bb = 7(omit3)
c e b = Maj7(omit5)"""
SCALES = {
    "major": ("c d e f g a b", "ionian dorian phrygian lydian mixolydian aeolian locrian".split()),
    "harmonic minor": ("a b c d e f g#", [f"harmonic minor mode {k}" for k in range(1, 8)]),
    "melodic minor": ("a b c d e f# g#", ["minor-major", "minor-major mode 2", "lydian augmented", "lydian dominant", "minor-major mode 5", "half-diminished", "altered"]),
    "diminished": ("g ab a# b c# d e f", ["half step/whole step"]),
    "diminished ": ("c d eb f gb ab a b", ["whole step/half step"]),
    "whole tone": ("c d e f# g# a#", [""]),
    "blues": ("c eb f f# g bb", [f"blues mode {k}" for k in range(1, 7)]),
}
INTERVALS = ("unison", "second", "third", "fourth", "fifth", "sixth", "seventh", "octave")
_TIMES = {1: "", 2: "doubly ", 3: "triply ", 4: "quadruply "}


def half_steps(note: str) -> int:
    """Half steps of a spelled note over c, not folded: cb is -1."""
    if not note or note[0] not in STEPS:
        raise NoMatch(note)
    return STEPS[note[0]] + sum({"#": 1, "x": 2, "b": -1}[c] for c in note[1:])


def gap(low: str, high: str) -> int:
    return (half_steps(high) - half_steps(low)) % 12


def spelled(letter: str, tone: int) -> str:
    """A letter with the accidentals that bring it to a tone; at most double ones."""
    signs = (tone - STEPS[letter] + 6) % 12 - 6
    if signs not in _SIGNS:
        raise NoMatch(f"{letter}{signs:+d}")
    return letter + _SIGNS[signs]


def interval_pattern(notes: list[str]) -> list[int]:
    return [gap(a, b) for a, b in zip(notes, notes[1:], strict=False)]


def without_duplicates(notes: list[str]) -> list[str]:
    return list(dict.fromkeys(notes))


def inversions(notes: list[str]) -> list[list[str]]:
    return [notes[i:] + notes[:i] for i in range(len(notes))]


def sorted_from_first(notes: list[str]) -> list[str]:
    """Upwards from the first note; of equal tones, the later letter first by its distance in letters."""
    first = notes[0]
    return sorted(notes, key=lambda n: (gap(first, n), (LETTERS.index(n[0]) - LETTERS.index(first[0])) % 7))


def canonic(notes: list[str]) -> list[str]:
    """The inversion whose notes lie closest, by the smallest interval pattern on a tie."""
    each = inversions(sorted_from_first(without_duplicates(notes)))
    return min(each, key=lambda c: (sum(interval_pattern(c)), interval_pattern(c)))


def transpose_to(notes: list[str], root: str) -> list[str]:
    """The same intervals, in letters and half steps, over another first note."""
    up, letters = half_steps(root) - half_steps(notes[0]), LETTERS.index(root[0]) - LETTERS.index(notes[0][0])
    return [spelled(LETTERS[(LETTERS.index(n[0]) + letters) % 7], (half_steps(n) + up) % 12) for n in notes]


@lru_cache(1)
def _chord_table() -> dict[tuple, tuple[str, int]]:
    table = {}
    for line in CHORDS.splitlines():
        notes, name = line.split(" =")
        form = canonic(notes.split())
        table[tuple(interval_pattern(form))] = name.strip(), form.index("c")
    return table


def recognise_chord(notes: list[str]) -> tuple[str, str, str]:
    """(root, kind, lowest note) of spelled notes from the lowest up."""
    form = canonic(notes)
    found = _chord_table().get(tuple(interval_pattern(form)))
    if found is None:
        raise NoMatch(" ".join(notes))
    return form[found[1]], found[0], notes[0]


@lru_cache(1)
def _scale_table() -> dict[tuple, tuple[str, str, int]]:
    """interval pattern -> (kind, mode, place of the root among the notes from the mode's first)."""
    table = {}
    for kind, (notes, modes) in SCALES.items():
        notes = notes.split()
        for k, mode in enumerate(modes):
            table[tuple(interval_pattern(notes[k:] + notes[:k]))] = kind.strip(), mode, (len(notes) - k) % len(notes)
    return table


def recognise_scale(notes: list[str]) -> tuple[str, str, str, str]:
    """(root, kind, mode's root, mode) of a scale from its first note."""
    notes = sorted_from_first(without_duplicates(notes))
    found = _scale_table().get(tuple(interval_pattern(notes)))
    if found is None:
        raise NoMatch(" ".join(notes))
    kind, mode, at = found
    return notes[at], kind, notes[0] if mode else "", mode


def recognise_interval(low: str, high: str) -> tuple[str, str]:
    """(name, modifier) of two spelled notes."""
    letters = (LETTERS.index(high[0]) - LETTERS.index(low[0])) % 7
    off = gap(low, high) - STEPS[LETTERS[letters]]
    if off > 6:
        letters, off = 7, off - 12
    pure = letters in (0, 3, 4, 7)
    names = {0: "perfect"} if pure else {0: "major", -1: "minor"}
    names |= {k: f"{t}augmented" for k, t in _TIMES.items()} | {-k - (not pure): f"{t}diminished" for k, t in _TIMES.items() if k + (not pure) <= 4}
    if off not in names:
        raise NoMatch(f"{low} {high}")
    return INTERVALS[letters], names[off]


# --- chord symbols -------------------------------------------------------------------------------------

# Degrees of each pitch class over a root, and kinds of chords with their abbreviations
DEGREES = (("1",), ("b2", "b9"), ("2", "9"), ("b3", "#9"), ("3",), ("4", "11"), ("b5", "#11"), ("5",), ("#5", "b13"), ("6", "bb7", "13"), ("b7",), ("7",))
KINDS = """1 3 5 =  maj M
1 b3 5 = m min -
1 3 #5 = + aug
1 b3 b5 = o dim
1 3 5 b7 = 7
1 3 5 7 = maj7 M7
1 b3 5 b7 = m7 min7 -7
1 b3 b5 bb7 = o7 dim7
1 3 #5 b7 = +7 aug7
1 b3 b5 b7 = m7b5 -7b5 /o /o7
1 b3 5 7 = mmaj7 mM7 minmaj7 minM7 -maj7 -M7 m(maj7) m(M7) min(maj7) min(M7) -(maj7) -(M7)
1 3 5 6 = 6
1 b3 5 6 = m6 min6 -6
1 3 5 b7 9 = 9
1 3 5 7 9 = maj9 M9
1 b3 5 b7 9 = m9 min9 -9
1 3 #5 b7 9 = +9 aug9
1 3 5 6 9 = 6/9
1 3 5 b7 9 11 = 11
1 3 5 7 9 11 = maj11 M11
1 b3 5 b7 9 11 = m11 min11 -11
1 3 5 b7 9 11 13 = 13
1 3 5 7 9 11 13 = maj13 M13
1 b3 5 b7 9 11 13 = m13 min13 -13
1 2 5 = sus2
1 4 5 = sus sus4
1 4 5 b7 = sus7 7sus
1 = ped
1 5 = 5"""
_KINDS = [(line.split(" = ")[1].split(" "), line.split(" = ")[0].split(" ")) for line in KINDS.splitlines()]
_BY_NAME = {name: degrees for names, degrees in _KINDS for name in names}
_SYMBOL = re.compile(r"^([A-G])(#*|b*)(" + "|".join(sorted((re.escape(n) for n in _BY_NAME), key=len, reverse=True)) + r")((?:\(?(?:add|no|b|#)+[0-9]+\)?)*)(?:/([A-G])(#*|b*))?$")
_CHANGE = re.compile(r"(add|no)?([b#]*)([0-9]+)")
_OFFSETS = {1: 0, 2: 2, 3: 4, 4: 5, 5: 7, 6: 9, 7: 11}


def _signs(text: str) -> int:
    return text.count("#") - text.count("b")


def _degree(text: str) -> tuple[int, int]:
    return int(text.lstrip("b#")), _signs(text)


def _tone(degree: int, alter: int) -> int:
    return (_OFFSETS[(degree - 1) % 7 + 1] + alter) % 12


def parse_symbol(figure: str) -> tuple[int, list[tuple[int, int]], int]:
    """(root, degrees with alterations, bass) of a chord symbol."""
    found = _SYMBOL.match(figure)
    if not found:
        raise NoMatch(figure)
    letter, signs, kind, changes, bass, bass_signs = found.groups()
    root = (STEPS[letter.lower()] + _signs(signs)) % 12
    degrees = dict(_degree(x) for x in _BY_NAME[kind])
    for what, alter, number in _CHANGE.findall(changes):
        if what == "no":
            degrees.pop(int(number), None)
        else:
            degrees[int(number)] = _signs(alter)
    return root, sorted(degrees.items()), (STEPS[bass.lower()] + _signs(bass_signs)) % 12 if bass else root


def symbol_pitches(figure: str) -> list[int]:
    """Pitch classes of a symbol: the bass first, then the root's degrees in order."""
    root, degrees, bass = parse_symbol(figure)
    tones = [(root + _tone(*x)) % 12 for x in degrees]
    return list(dict.fromkeys(([bass] if bass != root else []) + tones))


def symbol_quality(figure: str) -> str:
    """major, minor, augmented, diminished or other, by third and fifth."""
    degrees = dict(parse_symbol(figure)[1])
    return {(0, 0): "major", (-1, 0): "minor", (0, 1): "augmented", (-1, -1): "diminished"}.get((degrees.get(3, 9), degrees.get(5, 9)), "other")


def _moved(letter: str, alter: int, amount: int) -> str:
    """A root moved up by whole letters as far as they go, the rest as accidentals."""
    letter = letter.lower()
    for _ in range(12):
        step = (STEPS[LETTERS[(LETTERS.index(letter) + 1) % 7]] - STEPS[letter]) % 12
        if amount < step:
            break
        amount, letter = amount - step, LETTERS[(LETTERS.index(letter) + 1) % 7]
    if amount and alter >= 0:
        nxt = LETTERS[(LETTERS.index(letter) + 1) % 7]
        alter, letter = alter - ((STEPS[nxt] - STEPS[letter]) % 12 - amount), nxt
    elif amount:
        alter += amount
    return letter.upper() + ("#" if alter >= 0 else "b") * abs(alter)


def transpose_symbol(figure: str, amount: int) -> str:
    """Root and bass moved, the kind left as it is written."""
    found = _SYMBOL.match(figure)
    if not found:
        raise NoMatch(figure)
    letter, signs, kind, changes, bass, bass_signs = found.groups()
    low = "/" + _moved(bass, _signs(bass_signs), amount % 12) if bass else ""
    return _moved(letter, _signs(signs), amount % 12) + kind + changes + low


def _best_kind(tones: frozenset[int]) -> tuple[str, list[str], tuple[str, ...]] | None:
    """The largest kind whose degrees the tones over a root can be read as, and that reading."""
    best = None
    for reading in product(*(DEGREES[t] for t in sorted(tones))):
        steps = [_degree(x)[0] for x in reading]
        if len(steps) > len(set(steps)):
            continue
        for names, degrees in _KINDS:
            if set(degrees) <= set(reading) and (best is None or len(degrees) > len(best[1])):
                best = names[0], degrees, reading
    return best


@lru_cache(65536)
def name_chord(tones: frozenset[int], bass: int) -> str:
    """The symbol of pitch classes over a bass: each tone as a root, the largest kind that fits; the rest as additions."""
    if not tones:
        return "N.C."
    best = None
    for root in [bass, *sorted(tones - {bass})]:
        found = _best_kind(frozenset((t - root) % 12 for t in tones))
        if found and (best is None or len(found[1]) > len(best[1][1])):
            best = root, found
    if best is None:
        raise NoMatch(str(sorted(tones)))
    root, (kind, degrees, reading) = best
    have, want, text = dict(map(_degree, degrees)), dict(map(_degree, reading)), ""
    over = (bass - root) % 12
    if not set(DEGREES[over]) & set(degrees):  # a bass outside the chord needs no addition
        want = {k: v for k, v in want.items() if not any(_degree(x) == (k, v) for x in DEGREES[over])}
    for number, alter in want.items():
        sign = ("#" if alter >= 0 else "b") * abs(alter)
        if number not in have:
            text += f"({sign}{number})" if alter and number > 7 else f"(add{sign}{number})"
        elif have[number] != alter:
            text += f"({sign}{number})"
    text += "".join(f"(no{k})" for k in have if k not in want)
    return _moved("C", 0, root) + kind + text + ("" if bass == root else "/" + _moved("C", 0, bass))


# --- frames --------------------------------------------------------------------------------------------


def name_chords(sets: DataFrame) -> DataFrame:
    """sets (pitches array<int>, from the lowest) with ``symbol``; null where no kind fits.  Distinct sets are named once a batch."""

    def one(pitches):
        try:
            return name_chord(frozenset(p % 12 for p in pitches or []), min(pitches) % 12 if pitches else 0)
        except NoMatch:
            return None

    def run(batches):
        for batch in batches:
            known: dict[tuple, str | None] = {}
            out = []
            for p in batch["pitches"].to_pylist():
                key = tuple(p or [])
                if key not in known:
                    known[key] = one(p)
                out.append(known[key])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], [*batch.schema.names, "symbol"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sets.schema)
    return sets.mapInArrow(run, f"{fields}, symbol string")


def chord_dimension() -> list[tuple[str, str, list[int], str]]:
    """(root, kind, pitch classes, quality) of every root and kind, by rule."""
    out = []
    for k in range(12):
        root = _moved("C", 0, k)
        for names, _ in _KINDS:
            out.append((root, names[0], symbol_pitches(root + names[0]), symbol_quality(root + names[0])))
    return out


def recognised(frame: DataFrame, what: str = "chord") -> DataFrame:
    """frame (notes array<string>) with ``name``: chords, scales or intervals, null where nothing is known."""
    read = {"chord": recognise_chord, "scale": recognise_scale, "interval": lambda n: recognise_interval(*n[:2])}[what]

    def one(notes):
        try:
            return " ".join(x for x in read(notes) if x)
        except (NoMatch, TypeError, IndexError):
            return None

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([one(n) for n in batch["notes"].to_pylist()], pa.string())], [*batch.schema.names, "name"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema)
    return frame.mapInArrow(run, f"{fields}, name string")
