"""MIDI and MusicXML files made by hand, and folds of sequences."""

import struct

import numpy as np

from partita.operators import inference, joins, mining
from partita.sources import midi, musicxml


def file(*tracks, name=b"MTrk", size=6):
    out = b"MThd" + struct.pack(">IHHH", size, 1, len(tracks), 96)
    return out + b"".join(name + struct.pack(">I", len(t)) + t for t in tracks)


END = b"\x00\xff\x2f\x00"


def test_running_status_offs_and_ends():
    ticks, tracks, corrupt = midi.decode(file(b"\x00\x90\x3c\x40\x60\x3c\x00\x00\x3e\x40" + b"\x81\x00\xff\x2f\x00"))
    assert (ticks, corrupt) == (96, False)
    assert tracks[0] == [(0, "note_on", 0, 60, 64, None), (96, "note_on", 0, 60, 0, None), (0, "note_on", 0, 62, 64, None), (128, "text_event", None, None, None, b"")]


def test_bad_files():
    assert midi.decode(b"RIFF" + bytes(20)) == (1000, [], True)
    assert midi.decode(file(END, size=7)) == (1000, [], True)
    good = file(END)
    assert midi.decode(good[:14] + b"MTrk" + struct.pack(">I", 99) + END)[1:] == ([], True)
    assert midi.decode(file(END, name=b"XXXX"))[1:] == ([[]], False)  # a chunk's name is not looked at
    assert midi.decode(file(b"\x00\x3c\x40" + END))[2]  # no status yet
    assert midi.decode(b"")[2]


def test_encode_gives_back_what_was_read():
    events = [(0, "set_tempo", None, None, 500000, None), (0, "time_signature", None, 3, 2, b"\x18\x08"), (0, "key_signature", None, -3, 1, None), (5, "patch_change", 2, 40, None, None), (0, "control_change", 2, 64, 127, None), (300, "pitch_wheel_change", 2, None, -100, None), (0, "lyric", None, None, None, b"la"), (0, "sysex_f0", None, None, None, b"\x43\xf7"), (1, "note_on", 9, 35, 100, None), (20000, "note_off", 9, 35, 0, None)]
    assert midi.decode(midi.encode(480, [events, []])) == (480, [events, []], False)
    assert [e[1] for e in midi.decode(midi.encode(480, [events]), exclude=["lyric"])[1][0]].count("lyric") == 0
    assert {e[1] for e in midi.decode(midi.encode(480, [events]), include=["note_on"])[1][0]} == {"note_on"}


def test_pairing_rules(spark):
    rows = [(0, 0, "note_on", 60, 90), (1, 10, "note_on", 60, 80), (2, 20, "note_off", 60, 0), (3, 30, "note_on", 60, 0), (4, 40, "note_off", 60, 0), (5, 50, "note_on", 61, 70), (6, 60, "note_off", 62, 0)]
    events = spark.createDataFrame([("p", 0, i, t, k, 0, n, v) for i, t, k, n, v in rows], "path string, track int, idx int, tick long, kind string, channel int, num int, value int")
    fifo = sorted((r.onset, r.dur, r.pitch) for r in joins.paired(events).collect())
    assert fifo == [(0, 20, 60), (10, 20, 60), (50, 10, 61)]  # the spare off counts for nothing, an open note lasts to the end
    assert sorted((r.onset, r.dur, r.pitch) for r in joins.paired(events, "all").collect()) == [(0, 20, 60), (10, 10, 60)]


def test_midi_data_source(spark, tmp_path):
    midi.register(spark)
    (tmp_path / "a.mid").write_bytes(midi.encode(96, [[(0, "note_on", 0, 60, 64, None), (96, "note_off", 0, 60, 0, None)]]))
    (tmp_path / "b.mid").write_bytes(b"no")
    got = spark.read.format("midi").load(str(tmp_path)).collect()
    assert sorted((r.path.rsplit("/", 1)[1], r.corrupt, r.kind) for r in got if r.kind) == [("a.mid", False, "note_off"), ("a.mid", False, "note_on")]
    assert [r.corrupt for r in got if r.path.endswith("b.mid")] == [True]
    files = midi.encoded(midi.read_events(spark, str(tmp_path)).where("track is not null"))
    files.write.format("midi").mode("append").save(str(tmp_path / "out"))
    assert (tmp_path / "out" / "a.mid").read_bytes() == (tmp_path / "a.mid").read_bytes()


def test_music_xml():
    note = lambda step, dur, more="": f"<note>{more}<pitch><step>{step}</step><octave>4</octave></pitch><duration>{dur}</duration></note>"
    body = "<attributes><divisions>2</divisions></attributes>" + note("C", 2) + note("E", 2, "<chord/>") + "<note><rest/><duration>2</duration></note><backup><duration>4</duration></backup>" + note("G", 1)
    score = f'<score-partwise><part id="P1"><measure>{body}</measure><measure>{note("A", 4)}</measure></part></score-partwise>'.encode()
    got = [(n[3], n[4], n[5]) for n in musicxml.parse(score)]
    assert got == [(0.0, 1.0, 60), (0.0, 1.0, 64), (1.0, 1.0, None), (0.0, 0.5, 67), (2.0, 2.0, 69)]
    assert musicxml.playable(musicxml.parse(score), melody=True) == [("P1", 0.0, 0.5, 67), ("P1", 2.0, 4.0, 69)]


def test_chord_path_is_the_likeliest():
    prior = inference.key_chord_prior()
    vectors = np.random.default_rng(1).random((5, 12))
    vectors /= np.sqrt((vectors**2).sum(axis=1, keepdims=True))
    near = 100 * np.einsum("fp,cp->fc", vectors, inference._chord_tones())
    plain = inference.viterbi(np.log(prior.reshape(-1) / 12), np.log(inference.transitions(prior).reshape(prior.size, prior.size)), np.tile(near, (1, 12)))
    assert (inference.key_chord_path(near, 0.01, 0.001, 0.5) == plain).all()
    triad = np.zeros((3, 12))
    triad[:, [0, 4, 7]] = 1 / np.sqrt(3)
    assert {c for _, c in inference.chords_of_frames(triad)} == {"C"}


def test_folds():
    assert mining.merge_pair([1, 1, 1, 2], (1, 1), 9) == [9, 1, 2]
    assert mining.repeats([1, 2, 3, 1, 2, 3, 4], 2) == [([1, 2, 3], [0, 3])]
    assert mining.expansions([(0, 1, 4), (4, 4, 5)])[5] == [0, 1, 0, 1]
    assert inference.harmonised([0, 4, 1, 7], frozenset({(0, 4), (0,), (4,), (1,), (7,), (1, 4)})) == [(0,), (0, 4), (1, 4), (7,)]
    assert inference.melody_of([(0, 10, 60), (0, 10, 48), (10, 20, 62)]) == [(0, 10, 60), (10, 20, 62)]
    tempo, share = inference.tempi([0, 0.5, 1.0, 1.5, 2.0])[0]
    assert (round(tempo), share) == (120, 1.0)
