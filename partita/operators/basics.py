"""Small operators on lists and chords, and the repair pipeline made of the others."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partita.operators import mod, operator, transforms, windows

# Roman numerals of the degrees of a major scale, and the chord kinds that functions are told for
NUMERALS = ("I", "bII", "II", "bIII", "III", "IV", "#IV", "V", "bVI", "VI", "bVII", "VII")
TRIADS = {"": (0, 4, 7), "m": (0, 3, 7), "dim": (0, 3, 6), "aug": (0, 4, 8), "sus4": (0, 5, 7), "sus2": (0, 2, 7)}


@operator
def tail(n: int = 2) -> str:
    """The last n notes of each sequence."""
    return f"select seq_id, pos, pitch from (select *, row_number() over (partition by seq_id order by pos desc) as back from {{notes}}) t where back <= {n}"


@operator
def running_repeats() -> str:
    """How often each pitch has come again in a row: 0 at a change, then 1, 2 and on."""
    return """select seq_id, pos, row_number() over (partition by seq_id, island order by pos) - 1 as again from (select *, sum(fresh) over (partition by seq_id order by pos rows between unbounded preceding and current row) as island from (
 select seq_id, pos, case when pitch % 4 = lag(pitch % 4) over (partition by seq_id order by pos) then 0 else 1 end as fresh from {notes}) t) u"""


@operator
def dot_products() -> str:
    """The product sum of a sequence's pitches and durations."""
    return "select seq_id, cast(sum(pitch * dur) as bigint) as product from {notes} group by seq_id"


@operator
def flattened(d) -> str:
    """Chords one after the other as one list."""
    inner = f"select seq_id, onset, {d.alist('pitch', 'pitch', 'pos')} as a from {{notes}} group by seq_id, onset"
    flat = "flatten({0})".format(d.alist("a", "onset"))
    return f"select seq_id, {d.joined(d.map(flat, 'x', 'cast(x as string)'), ' ')} as pitches from ({inner}) t group by seq_id"


@operator
def all_equal() -> str:
    return "select seq_id, count(distinct pitch % 12) <= 1 as equal from {notes} group by seq_id"


@operator
def quantified(predicate: str = "pitch >= 64") -> str:
    """How many notes a predicate (SQL) holds for."""
    return f"select seq_id, sum(case when {predicate} then 1 else 0 end) as n from {{notes}} group by seq_id"


@operator
def round_robin() -> str:
    """The channels of a sequence taken in turn."""
    return "select seq_id, pos, row_number() over (partition by seq_id order by k, channel) as place from (select *, row_number() over (partition by seq_id, channel order by pos) as k from {notes}) t"


@operator
def subsets(d, most: int = 3) -> str:
    """All sets of up to ``most`` of a sequence's pitch classes, by joins of rising classes."""
    p = "select distinct seq_id, pitch % 12 as pc from {notes}"
    out, joins, cols = [], "p a0", "cast(a0.pc as string)"
    for k in range(most):
        if k:
            joins += f" join p a{k} on a{k}.seq_id = a0.seq_id and a{k - 1}.pc < a{k}.pc"
            cols += f" || ' ' || cast(a{k}.pc as string)"
        out.append(f"select a0.seq_id, {cols} as tones from {joins}")
    return f"with p as ({p}) {' union all '.join(out)}"


@operator
def chord_functions(key: int = 0) -> str:
    """Roman numerals, in a key, of onsets whose pitch classes are just a triad; the kind follows the numeral."""
    rows = "select * from (values " + ", ".join(f"('{NUMERALS[(r - key) % 12]}{kind}', {sum(1 << (r + i) % 12 for i in ps)})" for r in range(12) for kind, ps in TRIADS.items()) + ") as v_(name, mask)"
    return f"""select c.seq_id, c.onset, min(r.name) as name from (select seq_id, onset, cast(sum(bit_) as bigint) as mask from (select distinct seq_id, onset, cast(power(2, pitch % 12) as bigint) as bit_ from {{notes}}) t group by seq_id, onset) c
 join ({rows}) r on r.mask = c.mask group by c.seq_id, c.onset"""


@operator
def likest_chords(least: float = 0.6) -> str:
    """For each onset of three tones or more the triad that shares most tones with it, as a share of all tones of both; at least a share."""
    rows = "select * from (values " + ", ".join(f"('{r} {kind}', {(r + i) % 12})" for r in range(12) for kind, ps in TRIADS.items() for i in ps) + ") as v_(name, pc)"
    return f"""with p as (select distinct seq_id, onset, pitch % 12 as pc from {{notes}}), n as (select seq_id, onset, count(*) as n from p group by seq_id, onset having count(*) >= 3)
 select seq_id, onset, name, round(share, 6) as share from (select *, row_number() over (partition by seq_id, onset order by share desc, name) as rk from (
 select p.seq_id, p.onset, r.name, count(*) / cast(max(n.n) + 3 - count(*) as double) as share from p join n on n.seq_id = p.seq_id and n.onset = p.onset join ({rows}) r on r.pc = p.pc group by p.seq_id, p.onset, r.name) t) u where rk = 1 and share >= {least}"""


@operator
def closest_points() -> str:
    """For each note the nearest other of its sequence in onset and pitch, the first by place on a tie."""
    return """select seq_id, pos, other, round(dist, 6) as dist from (select a.seq_id, a.pos, b.pos as other, sqrt(cast((a.onset - b.onset) * (a.onset - b.onset) + (a.pitch - b.pitch) * (a.pitch - b.pitch) as double)) as dist,
 row_number() over (partition by a.seq_id, a.pos order by (a.onset - b.onset) * (a.onset - b.onset) + (a.pitch - b.pitch) * (a.pitch - b.pitch), b.pos) as rk from {notes} a join {notes} b on a.seq_id = b.seq_id and a.pos <> b.pos) t where rk = 1"""


@operator
def mirrored_tones(axis: int = 7) -> str:
    return f"select seq_id, pos, {mod(f'{axis} - pitch', 12)} as tone from {{notes}}"


def decoded_text(events: DataFrame, charset: str = "ISO-8859-1") -> DataFrame:
    """Events with their bytes as ``text``; those without any keep null."""
    return events.withColumn("text", F.decode("data", F.lit(charset)))


def healed(notes: DataFrame, least: int = 1, most: int = 500, quiet: int = 56, flat: float = 0.95) -> tuple[DataFrame, DataFrame]:
    """(notes, counts): duplicates dropped, durations fixed, quiet and flat dynamics repaired, one step after the
    other; counts are notes per sequence before and after, with the velocities that changed."""
    columns = ["seq_id", "pos", "onset", "dur", "channel", "pitch", "velocity"]
    step = windows.without_duplicates(notes).select(*columns)
    step = windows.fixed_durations(step, least=least, most=most).select(*columns)
    for repair in (lambda f: transforms.scale_velocities(f, threshold=quiet), lambda f: transforms.repair_flat_dynamics(f, threshold=flat)):
        step = step.join(repair(step).withColumnRenamed("velocity", "new"), ["seq_id", "pos"]).withColumn("velocity", F.col("new").cast("int")).select(*columns)
    before = notes.select("seq_id", "pos", F.col("velocity").alias("was"))
    counts = before.join(step.select("seq_id", "pos", "velocity"), ["seq_id", "pos"], "left").groupBy("seq_id").agg(F.count("*").alias("n_before"), F.count("velocity").alias("n_after"), F.sum(F.when(F.col("velocity") != F.col("was"), 1).otherwise(0)).alias("n_changed"))
    return step, counts


def progression(chunks: DataFrame, length: int = 8, overlap: int = 1, seed: int = 1) -> list[int]:
    """Chunk numbers (chunk_id, tokens) of a walk in which each chunk begins as the one before ends; a dead end is
    taken back, and the longest walk is kept.  Each step brings only the chunks that fit to the driver."""
    import random

    draw, seen, walk, best = random.Random(seed), set(), [], []
    keyed = chunks.select("chunk_id", F.slice("tokens", 1, overlap).alias("head"), F.slice("tokens", F.greatest(F.lit(1), F.size("tokens") - overlap + 1), overlap).alias("tail"))
    while len(walk) < length:
        fits = keyed if not walk else keyed.where(F.col("head") == F.array(*map(F.lit, walk[-1][1])))
        found = [(r["chunk_id"], r["tail"]) for r in fits.orderBy(F.xxhash64("chunk_id", F.lit(seed + len(seen)))).limit(64).collect() if r["chunk_id"] not in seen]
        if found:
            pick = draw.choice(found)
            seen.add(pick[0])
            walk.append(pick)
            best = max(best, list(walk), key=len)
        elif walk:
            walk.pop()
        else:
            break
    return [c for c, _ in best]
