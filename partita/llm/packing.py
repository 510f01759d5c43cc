"""Packing into training sequences by cutting-stock column generation.

A document gives full sequences and one remainder.  Remainders of a chunk of documents form a
histogram over lengths (rounded up to ``UNIT``); a linear program chooses how often to use
patterns, sets of lengths that fit one sequence.  Patterns are found as needed: a knapsack
dynamic program over the program's dual prices finds the pattern that improves it most, until
none does.  Uses are rounded down and remainders, ranked by length and position, are assigned to
the patterns.  Those left over by the rounding are joined and cut at full sequences; what is then
left is cut at powers of two, which need no padding.

A chunk is at most ``CHUNK`` documents of one scan task, so nothing is shuffled, memory is
bounded, and a lost task gives the same rows when it runs again on the same split.  Null texts
count as empty; every document has at least its end id.  Repeated rows are packed one by one.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partita.llm.blocks import rows, short_batches, trimmed

LENGTH, UNIT, CHUNK, END, ROUNDS = 2048, 16, 16_384, 1, 400
RESULT = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
WORD_CACHE = 400_000  # pieces of a generation
TOGETHER = 64  # new pieces that are encoded as one line


def best_pattern(prices: np.ndarray, size: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack: the most valuable pattern of lengths 1..len(prices) that fits ``size``."""
    value, last = np.zeros(size + 1), np.zeros(size + 1, dtype=np.int64)
    for room in range(1, size + 1):
        n = min(room, len(prices))
        gain = prices[:n] + value[room - n : room][::-1]
        k = int(np.argmax(gain))
        if gain[k] > value[room - 1]:
            value[room], last[room] = gain[k], k + 1
        else:
            value[room] = value[room - 1]
    pattern, room = np.zeros(len(prices)), size
    while room > 0:
        if last[room]:
            pattern[last[room] - 1] += 1
            room -= last[room]
        else:
            room -= 1
    return value[size], pattern


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A matrix product without BLAS, whose threads may hang in a process that has forked."""
    return np.einsum("ij,jk->ik", a, b)


def patterns(count: np.ndarray, size: int, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """(patterns as rows, uses): the linear program min sum(uses), patterns.T @ uses >= count."""
    some = np.flatnonzero(count)
    m = len(some)
    demand = count[some].astype(float)
    basis = np.diag(np.floor(size / (some + 1.0)))  # columns are patterns of one length each
    inverse = np.diag(1 / np.diag(basis))
    uses = (inverse * demand).sum(axis=1)
    for turn in range(rounds):
        prices = np.zeros(size)
        prices[some] = np.maximum(inverse.sum(axis=0), 0)
        worth, pattern = best_pattern(prices, size)
        column = pattern[some]
        if worth <= 1 + 1e-7:
            break
        direction = (inverse * column).sum(axis=1)
        able = direction > 1e-9
        if not able.any():
            break
        ratio = np.where(able, uses / np.where(able, direction, 1), np.inf)
        out = int(np.argmin(ratio))
        basis[:, out] = column
        step = ratio[out]
        uses = np.maximum(uses - step * direction, 0)
        uses[out] = step
        row = inverse[out] / direction[out]
        inverse = inverse - direction[:, None] * row
        inverse[out] = row
        if turn % 50 == 49:  # one Newton step takes out what rounding has gathered
            inverse = 2 * inverse - _times(inverse, _times(basis, inverse))
            uses = np.maximum((inverse * demand).sum(axis=1), 0)
    full = np.zeros((m, len(count)))
    full[:, some] = basis.T
    return full.astype(np.int64), np.floor(uses + 1e-9).astype(np.int64)


def layout(lengths: list[int], size: int = LENGTH, unit: int = UNIT) -> list[list[tuple[int, int, int]]]:
    """Sequences as lists of (item, start in the item, length) for items shorter than ``size``."""
    slots = size // unit
    bins = (np.asarray(lengths, dtype=np.int64) + unit - 1) // unit
    ranked = [[] for _ in range(slots + 1)]
    for i in np.lexsort((np.arange(len(bins)), bins)).tolist():
        ranked[bins[i]].append(i)
    for waiting in ranked:
        waiting.reverse()
    out = []
    if len(bins):
        found, uses = patterns(np.bincount(bins, minlength=slots + 1)[1:], slots)
        for pattern, times in zip(found, uses.tolist(), strict=True):
            wanted = [int(b) + 1 for b in np.repeat(np.arange(slots), pattern)]
            for _ in range(times):
                taken = [ranked[b].pop() for b in wanted if ranked[b]]
                if sum(lengths[i] for i in taken) >= size - size // 16:
                    out.append([(i, 0, lengths[i]) for i in taken])
                else:  # a pattern that ran out of items, or a wasteful one: leave its items for the cuts
                    for i in taken:
                        ranked[bins[i]].append(i)
    rest = [(i, lengths[i]) for waiting in reversed(ranked) for i in reversed(waiting)]
    total = sum(n for _, n in rest)
    sizes = [size] * (total // size) + [1 << b for b in range(size.bit_length() - 1, -1, -1) if (total % size) >> b & 1]
    at, used = 0, 0
    for need in sizes:
        sequence = []
        while need:
            item, n = rest[at]
            take = min(need, n - used)
            sequence.append((item, used, take))
            need, used = need - take, used + take
            if used == n:
                at, used = at + 1, 0
        out.append(sequence)
    return out


# Characters whose words the short way below takes apart just as the vocabulary's own rules do: ASCII
# white space and print, Latin-1 print and Latin Extended-A without the dotted capital I.
_PLAIN = re.compile(r"[\t-\r -~\u00a1-\u012f\u0131-\u017f]*")
_DENSE = re.compile(r"[ -~\u00a1-\u012f\u0131-\u017f]*")  # the same without white space but spaces
_LETTERS = r"a-z\u00aa\u00b5\u00ba\u00df-\u00f6\u00f8-\u017f"
_NUMBERS = r"0-9\u00b2\u00b3\u00b9\u00bc-\u00be"
_PIECE = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^\t-\r {_LETTERS}{_NUMBERS}]+")


def split_pieces(text: str) -> list[str]:
    """Pieces that the vocabulary encodes on their own: it lower-cases, drops white space and parts
    letters, single digits and other characters.  Texts with other characters or with its special
    strings are only parted at spaces and line feeds, and the tokenizer does the rest."""
    if _PLAIN.fullmatch(text) and "<|" not in text:
        return _PIECE.findall(text.lower())
    return [p for p in text.replace("\n", " ").split(" ") if p]


@lru_cache(1)  # a Python worker reads the file once, not for each task
def encoder(file: str) -> Callable[[str], np.ndarray]:
    """Ids of a text, piece by piece; pieces that come back are looked up.  The look-up table has two
    generations of ``WORD_CACHE`` pieces, so that common pieces stay when rare ones go."""
    from tokenizers import Tokenizer

    tok, known, older = Tokenizer.from_file(file), {}, {}

    def encode(text: str) -> np.ndarray:
        nonlocal known, older
        pieces = split_pieces(text)
        new = [p for p in set(pieces) if p not in known]
        if len(known) + len(new) > WORD_CACHE:
            known, older = {}, known
            new = list(set(pieces))
        fresh = []
        for p in new:
            if p in older:
                known[p] = older[p]
            else:
                fresh.append(p)
        for i in range(0, len(fresh), TOGETHER):
            some = fresh[i : i + TOGETHER]
            line = " ".join(some)
            if _DENSE.fullmatch(line) and "<|" not in line:
                e = tok.encode(line, add_special_tokens=False)
                sizes = np.bincount(np.array(e.word_ids, dtype=np.int64))
                if len(sizes) == len(some):  # no piece has less than one word, so each has one
                    ids, at = array("I", e.ids).tobytes(), 0
                    for p, n in zip(some, (4 * sizes).tolist(), strict=True):
                        known[p] = ids[at : at + n]
                        at += n
                    continue
            for p, e in zip(some, tok.encode_batch_fast(some, add_special_tokens=False), strict=True):
                known[p] = array("I", e.ids).tobytes()
        return np.frombuffer(b"".join([known[p] for p in pieces]), dtype="<u4")

    return encode


def packed(docs: DataFrame, file: str | None = None, size: int = LENGTH, end: int = END, chunk: int = CHUNK) -> DataFrame:
    """The pieces of all documents; ``file`` is the tokenizer's file."""
    if file is None:
        import public_tokenizers

        file = public_tokenizers.path("word_bpe_49k.json")

    short_batches(docs.sparkSession)

    def run(batches):
        import os

        from partita.llm import packing  # the module's own cache, which outlives this closure

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encode, sequence = packing.encoder(file), TaskContext.get().partitionId() << 32
        heads, tails = [], []

        def flush():
            nonlocal sequence
            columns = {k: [] for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")}

            def add(*row):
                for name, x in zip(columns, row, strict=True):
                    columns[name].append(x)

            for doc, start, crc, tokens in heads:
                add(doc, start, size, crc, tokens, sequence, 0)
                sequence += 1
            for pieces in layout([len(ids) for *_, ids in tails], size):
                offset = 0
                for item, start, n in pieces:
                    doc, before, tokens, ids = tails[item]
                    add(doc, before + start, n, zlib.crc32(ids[start : start + n].astype("<u4").tobytes()), tokens, sequence, offset)
                    offset += n
                sequence += 1
            heads.clear(), tails.clear()
            trimmed()
            return rows(RESULT, **columns)

        for batch in batches:
            for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                ids = np.append(encode(text or ""), np.array([end], dtype="<u4")).astype("<u4")
                whole = len(ids) // size * size
                for start in range(0, whole, size):
                    heads.append((doc, start, zlib.crc32(ids[start : start + size].tobytes()), len(ids)))
                if whole < len(ids):
                    tails.append((doc, whole, len(ids), ids[whole:].astype(np.uint16) if ids.max() < 1 << 16 else ids[whole:]))
                if len(tails) + len(heads) >= chunk:
                    yield flush()
        if heads or tails:
            yield flush()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, RESULT)
