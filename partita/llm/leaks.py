"""Benchmark decontamination by pigeonhole edit matching.

An item may occur with up to ``budget`` edits.  It is split into budget + 1 pieces, of which one
at least must then occur unchanged; an automaton finds all pieces in one pass over a text, and
Myers' bit-parallel distance verifies the text around each hit.  Texts are compared in lower
case with runs of white space as one space.

Null and empty texts match nothing; null and empty items match nothing; items of under
``SHORTEST`` characters match without edits and at word bounds only; equal items count once each.
Items are used in blocks of ``BLOCK``, so that what each task holds is bounded; all items are
compared with all documents.
"""

from __future__ import annotations

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partita.llm.blocks import short_batches

RATE, SHORTEST, BLOCK = 0.05, 40, 20_000


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def distance(item: str, text: str, most: int) -> int | None:
    """The least edit distance of item to any part of text, if at most ``most`` (Myers 1999)."""
    m = len(item)
    peq: dict[str, int] = {}
    for i, c in enumerate(item):
        peq[c] = peq.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best = full, 0, m, m
    for c in text:
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | ~(xh | pv) & full, pv & xh
        score += bool(ph & top) - bool(mh & top)
        ph, mh = ph << 1 & full, mh << 1 & full
        pv, mv = mh | ~(xv | ph) & full, ph & xv
        best = min(best, score)
    return best if best <= most else None


def pieces(item: str, budget: int) -> list[tuple[int, str]]:
    n = budget + 1
    cuts = [len(item) * k // n for k in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def bounded(text: str, begin: int, end: int) -> bool:
    """Whether no word goes on over either end of text[begin:end]."""
    inside = lambda at: 0 < at < len(text) and all(c.isalnum() or c == "_" for c in text[at - 1 : at + 1])
    return not inside(begin) and not inside(end)


class Matcher:
    def __init__(self, items: list[tuple[int, str]], rate: float = RATE):
        self.items = [(k, t, int(len(t) * rate) if len(t) >= SHORTEST else 0) for k, t in items if t]
        at: dict[str, list] = {}
        for i, (_, text, budget) in enumerate(self.items):
            for start, piece in pieces(text, budget):
                at.setdefault(piece, []).append((i, start))
        self.auto = ahocorasick.Automaton()
        for piece, places in at.items():
            self.auto.add_word(piece, (len(piece), places))
        if at:
            self.auto.make_automaton()

    def find(self, text: str | None) -> list[tuple[int, int]]:
        """(item id, least distance) of each item that occurs."""
        text, found, tried = normal(text), {}, set()
        for end, (length, places) in self.auto.iter(text) if self.items else ():
            for i, start in places:
                begin = end + 1 - length - start
                if (i, begin) in tried or found.get(i) == 0:
                    continue
                tried.add((i, begin))
                _, item, budget = self.items[i]
                if len(item) < SHORTEST and not bounded(text, begin, begin + len(item)):
                    continue
                exact = text.startswith(item, begin) if begin >= 0 else False
                d = 0 if exact else distance(item, text[max(0, begin - budget) : max(0, begin + len(item) + budget)], budget)
                if d is not None:
                    found[i] = min(d, found.get(i, d))
        return sorted((self.items[i][0], d) for i, d in found.items())


def matches(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """(doc_id, n_items, items, distance, kept) for every row of docs; each block of items adds to the columns of the last."""
    short_batches(docs.sparkSession)
    items, block = benchmark.select(F.col("item_id").cast("long"), "text").where(F.col("item_id").isNotNull()).orderBy("item_id").toLocalIterator(), []
    out, before = docs.select("doc_id", F.col("text").cast("string")), None

    def searched(frame, block):
        def run(batches):
            matcher = Matcher(block, rate)
            for batch in batches:
                texts, hits = batch["text"].to_pylist(), []
                old = zip(*(batch[c].to_pylist() for c in ("items", "n_items", "distance")), strict=True) if "items" in batch.schema.names else [("", 0, None)] * len(texts)
                for text, (line, n, least) in zip(texts, old, strict=True):
                    found = matcher.find(text)
                    hits.append((",".join([line] * bool(line) + [str(k) for k, _ in found]), n + len(found), min([d for _, d in found] + [least] * (least is not None), default=None)))
                columns = [pa.array([h[k] for h in hits], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64()))]
                yield pa.RecordBatch.from_arrays([batch["doc_id"].cast(pa.int64()), batch["text"], *columns], ["doc_id", "text", "items", "n_items", "distance"])

        return frame.mapInArrow(run, "doc_id long, text string, items string, n_items long, distance long")

    for row in items:
        block.append((row.item_id, normal(row.text)))
        if len(block) == BLOCK:
            out, before, block = searched(out, block), True, []
    if block or not before:
        out = searched(out, block)
    return out.select("doc_id", "n_items", "items", "distance", (F.col("n_items") == 0).alias("kept"))


def stage(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """The rows of docs in which no item occurs, with the columns of docs; a scan for each block of items."""
    short_batches(docs.sparkSession)
    items, block = benchmark.select(F.col("item_id").cast("long"), "text").where(F.col("item_id").isNotNull()).orderBy("item_id").toLocalIterator(), []

    def clean(frame, block):
        def run(batches):
            matcher = Matcher(block, rate)
            for batch in batches:
                yield batch.filter(pa.array([not matcher.find(t) for t in batch["text"].to_pylist()], pa.bool_()))

        return frame.mapInArrow(run, frame.schema)

    for row in items:
        block.append((row.item_id, normal(row.text)))
        if len(block) == BLOCK:
            docs, block = clean(docs, block), []
    return clean(docs, block) if block else docs
