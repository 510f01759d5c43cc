"""Files' events as note sequences: one nested row a file, instruments, number rows, and back."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from partita.operators.iterate import checkpointed
from partita.operators.joins import paired, to_millis


def notes_of(events: DataFrame, rule: str = "fifo") -> DataFrame:
    """Notes of events with channels and values brought into their ranges."""
    found = paired(events, rule)
    return found.withColumns({"channel": F.pmod("channel", F.lit(16)), "pitch": F.pmod("pitch", F.lit(128)), "velocity": F.pmod("velocity", F.lit(128))})


def ms_notes(events: DataFrame, default: int = 500_000) -> DataFrame:
    """Notes with onsets and durations in milliseconds: events are timed first and then paired."""
    timed = to_millis(events, default)
    return paired(timed.withColumn("tick", F.bround("ms").cast("long")))


def note_sequences(events: DataFrame) -> DataFrame:
    """One row a file: ticks, notes, tempos, time and key signatures, bends, controls and the end of the last note, times in seconds.

    Events are read many times here, so they are written once first, at which a corrupt file raises unless corrupt files are filtered before."""
    good = checkpointed(events.where(F.assert_true(~F.col("corrupt"), F.concat(F.lit("corrupt file "), F.col("path"))).isNull()))
    timed = to_millis(good.where(F.col("track").isNotNull())).withColumn("time", F.col("ms") / 1000.0)
    notes = paired(timed.withColumn("tick", F.bround(F.col("ms") * 1000).cast("long")))
    each = notes.select("path", F.struct((F.col("onset") / 1e6).alias("start"), ((F.col("onset") + F.col("dur")) / 1e6).alias("stop"), "pitch", "velocity", F.col("track").alias("instrument"), (F.col("channel") == 9).alias("drum")).alias("n"))
    rolled = each.groupBy("path").agg(F.array_sort(F.collect_list("n")).alias("notes"), F.max("n.stop").alias("total_time"))
    kind = lambda k, *cols: F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.struct("time", *cols))))
    state = timed.groupBy("path", "ticks").agg(
        kind("set_tempo", (60_000_000.0 / F.col("value")).alias("qpm")).alias("tempos"), kind("time_signature", F.col("num").alias("numerator"), F.pow(F.lit(2), F.col("value")).cast("int").alias("denominator")).alias("time_signatures"),
        kind("key_signature", F.pmod(F.col("num") * 7, F.lit(12)).cast("int").alias("key"), F.col("value").alias("minor")).alias("key_signatures"),
        kind("pitch_wheel_change", "track", "channel", F.col("value").alias("bend")).alias("bends"), kind("control_change", "track", "channel", F.col("num").alias("control"), "value").alias("controls"),
    )
    return state.join(rolled, "path", "left")


def instruments(events: DataFrame) -> DataFrame:
    """(path, track, channel, program, drum, n): a track's channels with the program that holds when a note begins; open notes of a pitch all end with an off."""
    w = Window.partitionBy("path", "track", "channel").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    on = events.withColumn("program", F.coalesce(F.last(F.when(F.col("kind") == "patch_change", F.col("num")), ignorenulls=True).over(w), F.lit(0))).where((F.col("kind") == "note_on") & (F.col("value") > 0))
    return on.groupBy("path", "track", "channel", "program").agg(F.count("*").alias("n")).withColumn("drum", F.col("channel") == 9)


def number_rows(notes: DataFrame) -> DataFrame:
    """(path, k, row): notes in order as eight numbers: channel, pitch, velocity, duration and gap as pairs of seven-bit numbers, 255."""
    w = Window.partitionBy("path").orderBy("onset", "channel", "pitch", "velocity", "dur")
    gap = (F.col("onset") - F.lag("onset", 1, 0).over(w)).cast("int")
    part = lambda c: (F.least(F.floor(c / 128), F.lit(127)).cast("int"), F.pmod(c, F.lit(128)).cast("int"))
    return notes.withColumn("gap", gap).withColumn("k", F.row_number().over(w)).select("path", "k", F.array(F.col("channel").cast("int"), F.col("pitch").cast("int"), F.col("velocity").cast("int"), *part(F.col("dur")), *part(F.col("gap")), F.lit(255)).alias("row"))


def notes_of_rows(rows: DataFrame) -> DataFrame:
    """The inverse of ``number_rows`` for durations and gaps under 16,384."""
    w = Window.partitionBy("path").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    at = lambda i: F.col("row")[i]
    return rows.select("path", "k", (F.sum(at(5) * 128 + at(6)).over(w)).alias("onset"), (at(3) * 128 + at(4)).alias("dur"), at(0).alias("channel"), at(1).alias("pitch"), at(2).alias("velocity"))


def cropped_rows(rows: DataFrame, length: int = 8, seed: int = 1) -> DataFrame:
    """(path, rows): each file's rows as texts, a window of a length that begins where the file and the seed say; short files are filled."""
    listed = rows.groupBy("path").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "row"))), lambda x: F.array_join(F.transform(x["row"], lambda v: v.cast("string")), " ")).alias("a"))
    start = F.pmod(F.xxhash64("path", F.lit(seed)), F.greatest(F.size("a") - length + 1, F.lit(1))).cast("int") + 1
    return listed.select("path", F.slice(F.concat("a", F.array_repeat(F.lit("131 130 130 130 130 130 130 130"), length)), start, length).alias("rows"))


def without_late_events(events: DataFrame, seconds: float) -> DataFrame:
    """Events that come no later than so long after the last note's end."""
    timed = to_millis(events)
    last = timed.where(F.col("kind").isin("note_on", "note_off")).groupBy("path").agg(F.max("ms").alias("end"))
    return timed.join(last, "path").where(F.col("ms") <= F.col("end") + 1000 * seconds).drop("ms", "end")


def merged(scores: DataFrame) -> DataFrame:
    """Notes of several scores of one piece (piece, score, channel, ...) with channels that do not clash: a channel that an
    earlier score has takes the lowest free one that is not 9; beyond 15 free ones it is kept."""
    used = scores.select("piece", "score", "channel").distinct()
    w = Window.partitionBy("piece").orderBy("score", "channel")
    first = used.withColumn("rk", F.row_number().over(Window.partitionBy("piece", "channel").orderBy("score"))).withColumn("clash", F.col("rk") > 1)
    taken = first.where(~F.col("clash")).groupBy("piece").agg(F.collect_set("channel").alias("taken"))
    free = F.array_except(F.array([F.lit(c) for c in range(16) if c != 9]), "taken")
    moved = first.where("clash").withColumn("k", F.row_number().over(w)).join(taken, "piece").select("piece", "score", "channel", F.coalesce(F.get(free, F.col("k") - 1), F.col("channel")).alias("new"))
    return scores.join(moved, ["piece", "score", "channel"], "left").withColumn("channel", F.coalesce("new", "channel")).drop("new")


def same_ticks(scores: DataFrame) -> DataFrame:
    """Scores of one piece brought to milliseconds (1000 ticks a second) where their ticks differ."""
    w = Window.partitionBy("piece")
    differ = F.min("ticks").over(w) != F.max("ticks").over(w)
    out = scores.withColumn("differ", differ)
    scaled = {c: F.when(F.col("differ"), F.bround(F.col(c) * F.lit(500.0) / F.col("ticks")).cast("long")).otherwise(F.col(c)) for c in ("onset", "dur")}
    return out.withColumns({**scaled, "ticks": F.when(F.col("differ"), 1000).otherwise(F.col("ticks"))}).drop("differ")


def safely(files: DataFrame) -> DataFrame:
    """(path, n_events, corrupt) of every file; one that cannot be read gives a row and does not stop the others."""
    from partita.sources.midi import decoded

    return decoded(files).groupBy("path").agg(F.count("track").alias("n_events"), F.max("corrupt").alias("corrupt"))
