"""Hidden-state inference per sequence: chords and keys, melody; and folds that carry a state along."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from partita.operators.stats import MAJOR

# The intervals of the chord kinds that are inferred
CHORD_KINDS = {"": (0, 4, 7), "m": (0, 3, 7), "+": (0, 4, 8), "dim": (0, 3, 6), "7": (0, 4, 7, 10), "maj7": (0, 4, 7, 11), "m7": (0, 3, 7, 10), "m7b5": (0, 3, 6, 10), "sus": (0, 5, 7), "sus2": (0, 2, 7), "6": (0, 4, 7, 9), "dim7": (0, 3, 6, 9)}
NO_CHORD = "N.C."


@lru_cache(1)
def chord_names() -> list[tuple[str, tuple[int, ...]]]:
    """No chord, and each root and kind with its pitch classes."""
    roots = ("C", "C#", "D", "Eb", "E", "F", "F#", "G", "Ab", "A", "Bb", "B")
    return [(NO_CHORD, ())] + [(roots[r] + k, tuple((r + i) % 12 for i in ps)) for r in range(12) for k, ps in CHORD_KINDS.items()]


def key_chord_prior(out_of_key: float = 0.01) -> np.ndarray:
    """How likely each chord is in each of the twelve major keys: a factor for each tone in the key and out of it; rows sum to 1."""
    prior = np.zeros((12, len(chord_names())))
    for key in range(12):
        inside = {(key + p) % 12 for p in MAJOR}
        for c, (_, tones) in enumerate(chord_names()):
            n_out = sum(t not in inside for t in tones)
            prior[key, c] = (1 - out_of_key) ** (len(tones) - n_out) * out_of_key**n_out
    return prior / prior.sum(axis=1, keepdims=True)


def transitions(prior: np.ndarray, key_change: float = 0.001, chord_change: float = 0.5) -> np.ndarray:
    """(key, chord, key, chord): staying, changing the chord within a key, or the key with the chord."""
    keys, chords = prior.shape
    out = np.zeros((keys, chords, keys, chords))
    for a in range(keys):
        for b in range(keys):
            if a != b:
                out[a, :, b, :] = key_change / (keys - 1) * prior[b][None, :]
                continue
            move = prior[a][None, :] + prior[a][:, None] / (chords - 1)
            out[a, :, a, :] = (1 - key_change) * chord_change * move
            out[a, np.arange(chords), a, np.arange(chords)] = (1 - key_change) * (1 - chord_change)
    return out


def viterbi(start: np.ndarray, move: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """The likeliest states: start (s), move (s, s) and seen (frames, s) as logarithms; the first state on a tie."""
    best, back = start + seen[0], np.zeros(seen.shape, dtype=np.int64)
    for t in range(1, len(seen)):
        total = best[:, None] + move
        back[t] = total.argmax(axis=0)
        best = total[back[t], np.arange(total.shape[1])] + seen[t]
    path = np.zeros(len(seen), dtype=np.int64)
    path[-1] = best.argmax()
    for t in range(len(seen) - 1, 0, -1):
        path[t - 1] = back[t, path[t]]
    return path


@lru_cache(4)
def _key_chord_model(out_of_key: float, key_change: float, chord_change: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Logarithms of the start, of the moves within each key and of the way into each state from other keys."""
    prior = key_chord_prior(out_of_key)
    within = np.stack([transitions(prior[[a, a]], 0.5, chord_change)[0, :, 0, :] * 2 * (1 - key_change) for a in range(len(prior))])
    return np.log(prior / len(prior)), np.log(within), np.log(key_change / (len(prior) - 1)) + np.log(prior)


def key_chord_path(seen: np.ndarray, out_of_key: float, key_change: float, chord_change: float) -> np.ndarray:
    """``viterbi`` over (key, chord) with ``transitions``, whose two parts are taken apart: within a key all chords
    are compared; from other keys only the best state of each matters, as the way in is the same for all."""
    start, within, across = _key_chord_model(out_of_key, key_change, chord_change)
    keys, chords = start.shape
    best, back = start + seen[0][None, :], np.zeros((len(seen), keys, chords), dtype=np.int64)
    for t in range(1, len(seen)):
        total = best[:, :, None] + within
        came = total.argmax(axis=1)
        stay = np.take_along_axis(total, came[:, None, :], axis=1)[:, 0, :]
        top, at = best.max(axis=1), best.argmax(axis=1)
        masked = np.where(np.eye(keys, dtype=bool), -np.inf, top[None, :])
        other = masked.argmax(axis=1)
        move = masked.max(axis=1)[:, None] + across
        go = move > stay
        back[t] = np.where(go, (other * chords + at[other])[:, None], np.arange(keys)[:, None] * chords + came)
        best = np.where(go, move, stay) + seen[t][None, :]
    path = np.zeros(len(seen), dtype=np.int64)
    path[-1] = best.argmax()
    for t in range(len(seen) - 1, 0, -1):
        path[t - 1] = back[t].reshape(-1)[path[t]]
    return path


@lru_cache(1)
def _chord_tones() -> np.ndarray:
    tones = np.zeros((len(chord_names()), 12))
    for c, (_, ps) in enumerate(chord_names()):
        tones[c, list(ps)] = 1 / np.sqrt(max(1, len(ps)))
    return tones


def chords_of_frames(vectors: np.ndarray, concentration: float = 100.0, out_of_key: float = 0.01, key_change: float = 0.001, chord_change: float = 0.5) -> list[tuple[int, str]]:
    """(key, chord) of each frame of unit pitch-class vectors."""
    near = concentration * np.einsum("fp,cp->fc", vectors, _chord_tones())
    path, n = key_chord_path(near, out_of_key, key_change, chord_change), len(chord_names())
    return [(int(s // n), chord_names()[int(s % n)][0]) for s in path]


@lru_cache(4)
def _classes(out_of_key: float, key_change: float, chord_change: float):
    """Chords of a key fall into few classes of equal prior, and a move's value depends on the class it comes from and
    the chord it goes to.  Chords in order of class (flat over keys), where classes begin, their key and moves; None
    where a chord's own move could lose to the move of its class, which the plain way must tell."""
    start, within, across = _key_chord_model(out_of_key, key_change, chord_change)
    keys, chords = start.shape
    order, begins, of_key, moves = [], [], [], []
    stay = within[:, np.arange(chords), np.arange(chords)]
    for a in range(keys):
        for value in np.unique(start[a]):
            members = np.flatnonzero(start[a] == value)
            begins.append(len(order))
            of_key.append(a)
            order += (a * chords + members).tolist()
            # the move from any member but the chord itself; with one member its own place is never asked for
            move = within[a, members[0]].copy()
            move[members[0]] = within[a, members[1], members[0]] if len(members) > 1 else -np.inf
            if len(members) > 1 and (move[members] >= stay[a, members]).any():
                return None
            if any((np.delete(within[a, m], m) != np.delete(move, m)).any() for m in members):
                return None
            moves.append(move)
    most = max(of_key.count(a) for a in range(keys))
    pick, table = np.zeros((keys, most), dtype=np.int64), np.full((keys, most, chords), -np.inf)
    for a in range(keys):
        mine = [k for k, b in enumerate(of_key) if b == a]
        pick[a, : len(mine)], pick[a, len(mine) :] = mine, mine[0]
        table[a, : len(mine)] = [moves[k] for k in mine]
    return np.array(order), np.array(begins), pick, table, stay


def key_chord_paths(seen: np.ndarray, out_of_key: float, key_change: float, chord_change: float) -> np.ndarray:
    """``key_chord_path`` of many sequences of one length at once: seen (sequences, frames, chords)."""
    known = _classes(out_of_key, key_change, chord_change)
    if known is None:
        return np.stack([key_chord_path(x, out_of_key, key_change, chord_change) for x in seen])
    order, begins, pick, table, stay_move = known
    start, _, across = _key_chord_model(out_of_key, key_change, chord_change)
    (keys, chords), (n, frames) = start.shape, seen.shape[:2]
    chord, sizes = order % chords, np.diff(np.r_[begins, len(order)])
    best, back = start[None] + seen[:, 0][:, None, :], np.zeros((frames, n, keys * chords), dtype=np.int32)
    own = np.arange(chords, dtype=np.int64)[None, :]
    for t in range(1, frames):
        flat = best.reshape(n, -1)[:, order]
        tops = np.maximum.reduceat(flat, begins, axis=1)
        firsts = np.minimum.reduceat(np.where(flat == np.repeat(tops, sizes, axis=1), chord, chords), begins, axis=1)
        stay, came = best + stay_move[None], np.repeat(own, n * keys, axis=0).reshape(n, keys, chords)
        for k in range(pick.shape[1]):
            total, first = tops[:, pick[:, k]][:, :, None] + table[None, :, k], firsts[:, pick[:, k]][:, :, None]
            better, tied = total > stay, total == stay
            if tied.any():
                better |= tied & (first < came)
            np.copyto(stay, total, where=better)
            np.copyto(came, first, where=better)
        top, at = best.max(axis=2), best.argmax(axis=2)
        masked = np.where(np.eye(keys, dtype=bool)[None], -np.inf, top[:, None, :])
        other = masked.argmax(axis=2)
        move = masked.max(axis=2)[:, :, None] + across[None]
        go = move > stay
        back[t] = np.where(go, (other * chords + np.take_along_axis(at, other, axis=1))[:, :, None], np.arange(keys)[None, :, None] * chords + came).reshape(n, -1)
        best = np.where(go, move, stay) + seen[:, t][:, None, :]
    paths = np.zeros((n, frames), dtype=np.int64)
    paths[:, -1] = best.reshape(n, -1).argmax(axis=1)
    for t in range(frames - 1, 0, -1):
        paths[:, t - 1] = back[t, np.arange(n), paths[:, t]]
    return paths


_CHORD_FRAMES = 64  # frames whose states are held at once


def _chord_rows(table: pa.Table, limit: int, concentration: float = 100.0, out_of_key: float = 0.01, key_change: float = 0.001, chord_change: float = 0.5) -> pa.RecordBatch:
    """Chord changes of whole sequences that stand together by seq_id."""
    seqs = table["seq_id"].to_pylist()
    frame, pc, weight = (table[c].to_numpy() for c in ("frame", "pc", "weight"))
    at = [0] + [i for i in range(1, len(seqs)) if seqs[i] != seqs[i - 1]]
    first, last = np.minimum.reduceat(frame, at).astype(np.int64), np.maximum.reduceat(frame, at).astype(np.int64)
    if (over := np.flatnonzero(last - first >= limit)).size:
        raise ValueError(f"sequence {seqs[at[over[0]]]} has over {limit} frames")
    length = last - first + 1
    place = np.cumsum(length) - length
    row = np.repeat(np.arange(len(at)), np.diff([*at, len(seqs)]))
    vectors = np.zeros((int(length.sum()), 12))
    np.add.at(vectors, (place[row] + frame.astype(np.int64) - first[row], pc.astype(np.int64)), weight.astype(float))
    norm = np.sqrt((vectors**2).sum(axis=1, keepdims=True))
    near = concentration * np.einsum("fp,cp->fc", np.divide(vectors, norm, out=np.zeros_like(vectors), where=norm > 0), _chord_tones())
    states = np.zeros(len(vectors), dtype=np.int64)
    for size in np.unique(length):
        alike = np.flatnonzero(length == size)
        step = max(1, _CHORD_FRAMES // int(size))
        for k in range(0, len(alike), step):
            cells = place[alike[k : k + step]][:, None] + np.arange(size)[None, :]
            states[cells] = key_chord_paths(near[cells], out_of_key, key_change, chord_change)
    key, chord = np.divmod(states, len(chord_names()))
    changes = np.r_[True, chord[1:] != chord[:-1]]
    changes[place] = True
    which = np.repeat(np.arange(len(at)), length)[changes]
    names = pa.array([c for c, _ in chord_names()])
    ids = pa.array([seqs[i] for i in at], pa.int64()).take(pa.array(which))
    return pa.RecordBatch.from_arrays([ids, pa.array((np.arange(len(states)) - place.repeat(length) + first.repeat(length))[changes], pa.int64()), pa.array(key[changes], pa.int32()), names.take(pa.array(chord[changes]))], ["seq_id", "frame", "key", "chord"])


def infer_chords(frames: DataFrame, **parameters) -> DataFrame:
    """(seq_id, frame, key, chord) of frames (seq_id, frame, pc, weight), many sequences of a task at once; where the chord changes or the sequence begins."""
    limit = parameters.pop("most", 1000)

    def run(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            seqs = held["seq_id"].to_pylist()
            cut = len(seqs) - next((i for i, x in enumerate(reversed(seqs)) if x != seqs[-1]), len(seqs))
            if cut:
                yield _chord_rows(held.slice(0, cut), limit, **parameters)
                held = held.slice(cut)
        if held is not None:
            yield _chord_rows(held, limit, **parameters)

    return frames.select("seq_id", "frame", "pc", "weight").repartition("seq_id").sortWithinPartitions("seq_id").mapInArrow(run, "seq_id long, frame long, key int, chord string")


def melody_of(notes: list[tuple[int, int, int]], scale: float = 2.0, rest: float = 0.1, not_top: float = 1e-15, missing: float = 1e-15) -> list[tuple[int, int, int]]:
    """(start, stop, pitch) of the melody of notes (onset, stop, pitch): a chain of rest, begun and held pitches over
    the spans between edges; a step d is worth 1 / (1 + (d / scale)^2), and the highest sounding pitch is preferred."""
    edges = sorted({t for a, b, _ in notes for t in (a, b)})
    spans, pitches = list(zip(edges, edges[1:], strict=False)), sorted({p for *_, p in notes})
    if not spans:
        return []
    k = len(pitches)
    place = {p: i for i, p in enumerate(pitches)}
    steps = 1 / (1 + ((np.array(pitches)[:, None] - np.array(pitches)[None, :]) / scale) ** 2)
    steps = (1 - rest) * steps / steps.sum(axis=1, keepdims=True)
    size = 1 + 2 * k  # rest, on, held
    move = np.full((size, size), 1e-300)
    move[0, 0], move[0, 1 : 1 + k] = rest, (1 - rest) / k
    for half in (1, 1 + k):
        move[half : half + k, 0] = rest
        move[half : half + k, 1 : 1 + k] = steps
        move[np.arange(half, half + k), np.arange(1 + k, size)] = 1.0
    seen = np.zeros((len(spans), size))
    for f, (a, b) in enumerate(spans):
        sounding = {p for s, e, p in notes if s <= a and e >= b}
        begins = {p for s, _, p in notes if s == a}
        top = max(sounding, default=None)
        seen[f, 0] = 1.0 if not sounding else 1e-3
        for p, i in place.items():
            value = missing if p not in sounding else (1.0 if p == top else not_top)
            seen[f, 1 + i] = value if p in begins else missing
            seen[f, 1 + k + i] = value if p in sounding and p not in begins else missing
    start = np.full(size, 1e-300)
    start[0], start[1 : 1 + k] = rest, (1 - rest) / k
    path, out = viterbi(np.log(start), np.log(move), np.log(np.maximum(seen, 1e-300))), []
    for state, (a, b) in zip(path.tolist(), spans, strict=True):
        if 1 <= state <= k:
            out.append((a, b, pitches[state - 1]))
        elif state > k and out and out[-1][2] == pitches[state - 1 - k] and out[-1][1] == a:
            out[-1] = (out[-1][0], b, out[-1][2])
    return out


def infer_melody(notes: DataFrame, **parameters) -> DataFrame:
    """(seq_id, start, stop, pitch) of each sequence's melody."""

    def run(table):
        seq = table["seq_id"][0].as_py()
        found = melody_of(list(zip(*(table[c].to_pylist() for c in ("onset", "stop", "pitch")), strict=True)), **parameters)
        return pa.table({"seq_id": pa.array([seq] * len(found), pa.int64()), **{n: pa.array([f[j] for f in found], pa.int64()) for j, n in enumerate(("start", "stop", "pitch"))}})

    return notes.selectExpr("seq_id", "cast(onset as bigint) onset", "cast(onset + dur as bigint) stop", "cast(pitch as bigint) pitch").groupBy("seq_id").applyInArrow(run, "seq_id long, start long, stop long, pitch long")


def harmonised(tones: list[int], allowed: frozenset[tuple[int, ...]]) -> list[tuple[int, ...]]:
    """The tones heard so far as a chord at each note: a new tone joins, the oldest leave until the set is allowed."""
    held: list[int] = []
    out = []
    for t in tones:
        held = [x for x in held if x != t] + [t]
        while len(held) > 1 and tuple(sorted(held)) not in allowed:
            held.pop(0)
        out.append(tuple(sorted(held)))
    return out


def harmonise(sequences: DataFrame, allowed: list[tuple[int, ...]]) -> DataFrame:
    """sequences (seq_id, tokens) with ``chords``, an array of the chords' tones as texts."""
    known = frozenset(tuple(sorted(a)) for a in allowed)

    def run(batches):
        for batch in batches:
            made = [[" ".join(map(str, c)) for c in harmonised([x % 12 for x in t or []], known)] for t in batch["tokens"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["seq_id"].cast(pa.int64()), pa.array(made, pa.list_(pa.string()))], ["seq_id", "chords"])

    return sequences.select("seq_id", "tokens").mapInArrow(run, "seq_id long, chords array<string>")


def tempi(onsets: list[float], width: float = 0.025) -> list[tuple[float, float]]:
    """(tempo, share): gaps of 0.05 to 2 s, doubled until 0.2 s, in clusters whose mean lies within ``width``; the commonest first."""
    clusters: list[list[float]] = []
    for a, b in zip(sorted(onsets), sorted(onsets)[1:], strict=False):
        gap = b - a
        if not 0.05 < gap < 2:
            continue
        while gap < 0.2:
            gap *= 2
        near = min(clusters, key=lambda c: abs(sum(c) / len(c) - gap), default=None)
        if near is not None and abs(sum(near) / len(near) - gap) <= width:
            near.append(gap)
        else:
            clusters.append([gap])
    total = sum(map(len, clusters))
    return [(60 * len(c) / sum(c), len(c) / total) for c in sorted(clusters, key=lambda c: -len(c))]


def estimate_tempi(onsets: DataFrame) -> DataFrame:
    """(seq_id, tempo, share) of onsets (seq_id, time)."""

    def run(table):
        seq, found = table["seq_id"][0].as_py(), tempi(table["time"].to_pylist())
        return pa.table({"seq_id": pa.array([seq] * len(found), pa.int64()), "tempo": pa.array([round(f[0], 6) for f in found], pa.float64()), "share": pa.array([round(f[1], 6) for f in found], pa.float64())})

    return onsets.selectExpr("seq_id", "cast(time as double) time").groupBy("seq_id").applyInArrow(run, "seq_id long, tempo double, share double")


def generated(counts: DataFrame, start: list[int], length: int = 24, memory: int = 2, seed: int = 1) -> list[int]:
    """Tokens drawn one by one from a context table (context, next, n), shorter contexts where one is not known.  Each step reads one context's rows; a step brings at most the vocabulary to the driver."""
    import random

    draw, out = random.Random(seed), list(start)
    while len(out) < length:
        rows = []
        for size in range(min(memory, len(out)), 0, -1):
            rows = counts.where(counts["context"].endswith(" ".join(map(str, out[-size:])))).groupBy("next").sum("n").orderBy("next").collect()
            if rows:
                break
        if not rows:
            break
        out.append(draw.choices([r[0] for r in rows], [r[1] for r in rows])[0])
    return out
