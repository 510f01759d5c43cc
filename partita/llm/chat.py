"""Event-sourced chat formatting.

A log of events (conv_id, seq, msg, op, role, payload) is partitioned by conversation and sorted
by sequence number; ``open`` begins a message, ``delta`` adds to it, ``edit`` replaces its text
and ``regen`` empties it for a new attempt.  Partitions are streamed, so only one conversation is
held at a time.  Null payloads count as empty, null roles as the empty string; equal sequence
numbers keep the order of msg, op, payload and role; unknown operations are ignored.

Each row of a finished conversation is a message of its own, numbered by turn (null last), role
and text, so that tied turns and repeated rows keep their texts apart.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BEGIN, MIDDLE, END = "<s>[INST] ", " [/INST]", "</s>\n"
_MARK = re.compile(r"[\\<>\[\]]")
_TURN = re.compile(r"<s>\[INST\] ((?:[^\\<>\[\]]|\\.)*) \[/INST\]((?:[^\\<>\[\]]|\\.)*)</s>\n", re.S)
SCHEMA = "conv_id long, formatted string, loss array<struct<first: long, last: long>>"


def escape(text: str) -> str:
    return _MARK.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[dict]]:
    """The formatted conversation and the spans (code points) of the assistant's texts."""
    out, at, loss = [], 0, []
    for role, text in turns:
        head, body = BEGIN + escape(role) + MIDDLE, escape(text)
        if role == "assistant":
            loss.append({"first": at + len(head), "last": at + len(head) + len(body)})
        out += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(out), loss


def parse(formatted: str) -> list[tuple[str, str]]:
    return [(unescape(m[1]), unescape(m[2])) for m in _TURN.finditer(formatted)]


def events(conversations: DataFrame, size: int = 64) -> DataFrame:
    """A streamed log for finished turns: each message is opened and then sent in pieces."""
    text = F.coalesce(F.col("text"), F.lit(""))
    pieces = F.expr(f"transform(sequence(0, cast(floor(length(t) / {size}) as int)), i -> substring(t, i * {size} + 1, {size}))")
    place = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_last(), F.coalesce(F.col("role"), F.lit("")), "t")
    return (
        conversations.withColumn("t", text)
        .withColumn("msg", F.row_number().over(place).cast("long"))
        .select("conv_id", "msg", "role", F.posexplode(F.concat(F.array(F.lit("")), pieces)).alias("k", "payload"))
        .select("conv_id", "msg", "role", F.col("k").alias("seq"), F.when(F.col("k") == 0, "open").otherwise("delta").alias("op"), "payload")
    )


def formatted(log: DataFrame) -> DataFrame:
    def fold(batches):
        now, turns, seen = None, [], False
        for batch in batches:
            out = []
            for e in batch.to_pylist():
                if seen and e["conv_id"] != now:
                    out.append((now, turns))
                    turns = []
                now, seen, text = e["conv_id"], True, e["payload"] or ""
                if e["op"] == "open":
                    turns.append([e["role"] or "", [text]])
                elif e["op"] == "delta" and turns:
                    turns[-1][1].append(text)
                elif e["op"] == "edit" and turns:
                    turns[-1][1] = [text]
                elif e["op"] == "regen" and turns:
                    turns[-1][1] = []
            yield from made(out)
        if seen:
            yield from made([(now, turns)])

    def made(done):
        if done:
            both = [render([(r, "".join(x)) for r, x in turns]) for _, turns in done]
            yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in done], pa.int64()), pa.array([f for f, _ in both], pa.string()), pa.array([s for _, s in both], pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())])))], ["conv_id", "formatted", "loss"])

    order = ["conv_id", "msg", "seq", "op", "payload", "role"]
    return log.select("conv_id", "msg", "seq", "op", "role", "payload").repartition("conv_id").sortWithinPartitions(*order).mapInArrow(fold, SCHEMA)


def report(conversations: DataFrame) -> DataFrame:
    def read(batches):
        for batch in batches:
            rows = []
            for x in batch.to_pylist():
                turns = parse(x["formatted"])
                said = "".join(unescape(x["formatted"][s["first"] : s["last"]]) for s in x["loss"])
                digest = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
                rows.append({"conv_id": x["conv_id"], "n_turns": len(turns), "turns_sha256": digest, "loss_chars": len(said), "loss_sha256": hashlib.sha256(said.encode()).hexdigest(), "formatted_chars": len(x["formatted"])})
            if rows:
                yield pa.RecordBatch.from_pylist(rows)

    return formatted(events(conversations)).mapInArrow(read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
