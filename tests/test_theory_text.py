"""Chords, scales, intervals, chord symbols, titles, words and syllables by hand."""

import pytest

from partita.functions import text, theory

CHORDS = [
    ("c e g c", ("c", "", "c")), ("c g e c", ("c", "", "c")), ("e g# b d", ("e", "7", "e")), ("g# b d e", ("e", "7", "g#")), ("a c e", ("a", "m", "a")), ("d f a c", ("d", "m7", "d")), ("d f c", ("f", "6", "d")),
    ("b d f", ("b", "dim", "b")), ("e a d", ("a", "sus4", "e")), ("c g a", ("c", "6", "c")), ("g a c", ("c", "6", "g")), ("b# e# gx", ("e#", "", "b#")), ("d eb g", ("eb", "Maj7(omit5)", "d")),
    ("c db f", ("db", "Maj7(omit5)", "c")), ("f gb bb", ("gb", "Maj7(omit5)", "f")), ("c f bb", ("f", "sus4", "c")), ("c f g bb d", ("bb", "6/9", "c")), ("c g bb", ("c", "7(omit3)", "c")), ("f a c e", ("f", "Maj7", "f")),
]
INTERVALS = [("c c", "unison perfect"), ("c e", "third major"), ("e g", "third minor"), ("g d", "fifth perfect"), ("gx dbb", "fifth quadruply diminished"), ("d bb", "sixth minor"), ("c f", "fourth perfect"), ("c e#", "third augmented"), ("dbb f", "third augmented"), ("dbb e#", "second triply augmented"), ("a# a", "octave diminished"), ("ax a", "octave doubly diminished")]
SCALES = [
    ("c d e f g a b", ("c", "major", "c", "ionian")), ("d e f g a b c", ("c", "major", "d", "dorian")), ("d e f# g a b c#", ("d", "major", "d", "ionian")), ("e f# g# a b c# d", ("a", "major", "e", "mixolydian")),
    ("c d e f# g# a#", ("c", "whole tone", "", "")), ("d e f# g# a# b#", ("d", "whole tone", "", "")), ("c d eb f gb ab a b", ("c", "diminished", "c", "whole step/half step")),
    ("e f g# a b c d", ("a", "harmonic minor", "e", "harmonic minor mode 5")), ("db d e f g ab bb b", ("db", "diminished", "db", "half step/whole step")),
]


@pytest.mark.parametrize(("notes", "name"), CHORDS)
def test_chords(notes, name):
    assert theory.recognise_chord(notes.split()) == name


@pytest.mark.parametrize(("notes", "name"), SCALES)
def test_scales(notes, name):
    assert theory.recognise_scale(notes.split()) == name


@pytest.mark.parametrize(("notes", "name"), INTERVALS)
def test_intervals(notes, name):
    assert " ".join(theory.recognise_interval(*notes.split())) == name


def test_chord_forms():
    assert theory.interval_pattern("c e g c".split()) == [4, 3, 5]
    assert theory.without_duplicates("c e g c g b".split()) == "c e g b".split()
    assert theory.inversions("c e g".split()) == [["c", "e", "g"], ["e", "g", "c"], ["g", "c", "e"]]
    assert theory.canonic("g c f".split()) == "f g c".split()
    assert theory.canonic("c f g b d".split()) == "b c d f g".split()
    assert theory.transpose_to("c e g".split(), "f") == "f a c".split()
    assert theory.transpose_to("c e g".split(), "e#") == "e# gx b#".split()
    with pytest.raises(theory.NoMatch):
        theory.transpose_to("c e g".split(), "ex")
    assert theory.transpose_to("c d eb f g ab bb".split(), "gb") == "gb ab bbb cb db ebb fb".split()


def test_symbols():
    name = lambda *p: theory.name_chord(frozenset(x % 12 for x in p), p[0] % 12)
    assert [name(60, 64, 67), name(57, 60, 64), name(64, 67, 72), name(55, 59, 62, 65), name(60, 63, 66)] == ["C", "Am", "C/E", "G7", "Co"]
    assert theory.symbol_pitches("Am7b5/G") == [7, 9, 0, 3]
    assert theory.transpose_symbol("Bbm7/F", 3) == "Dbm7/Ab"
    assert theory.symbol_quality("Caug") == "augmented" and theory.symbol_quality("F#m") == "minor"
    with pytest.raises(theory.NoMatch):
        theory.parse_symbol("H")


def test_titles_and_artists():
    assert text.same_title("Summer", "[www.midi.com] Summer (Radio Edit) _v2.mid")
    assert text.same_artist("Taylor Swift", "Swift Taylor feat. Ed Sheeran")
    assert not text.same_title("Summer", "Winter")
    assert text.split_name("x/Abba - Dancing Queen.mid") == ("Abba", "Dancing Queen")
    assert text.clean_artist("B & The A") == "a b"


def test_words_and_sentences():
    model = text.WordModel("the cat sat on a mat 1 2 's".split())
    assert model.part("thecatsatona") == ["the", "cat", "sat", "on", "a"]
    assert model.part("cat12") == ["cat", "12"]
    assert text.sentences("He met Dr. Who. They left! ok") == ["He met Dr. Who.", "They left! ok"] or text.sentences("He met Dr. Who. They left! Ok") == ["He met Dr. Who.", "They left!", "Ok"]
    assert text.merge_short(["a", "bc", "d"], 2) == ["abc"[:3] + "d"] or text.merge_short(["a", "bc", "d"], 2) == ["abc", "d"]
    assert "".join(text.syllable_parts("banana")) == "banana" and len(text.syllable_parts("banana")) == 3
    assert len(text.even_parts("banana", 2)) == 2 and text.syllables("cat") == 1
