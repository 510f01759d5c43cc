"""Substring dedup of word windows with a count-min prefilter.

Pass one: the partition sketch of a block of documents is a count-min sketch of two rows; as its
width follows the whole input and few of its counters are not zero, only those are kept, sorted.
The sketches are merged by addition, in slabs of neighbouring counters, so no task holds a whole
sketch, and each block learns which of its counters reach two.  A sketch never counts too low, so
no repeated window is lost.  Pass two groups exactly, by 128-bit fingerprints, only the windows
that both rows estimate as repeated, and answers whether a smaller doc_id has the window.

Null texts have no words; a null doc_id counts as larger than all others; rows with equal doc_id
are not smaller than each other, so none removes words of another.  An empty table gives no rows;
columns other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame

from partita.llm.blocks import STATE, Docs, ask, bytes_table, checkpointed, owner_cuts, owners, pack, pack_sorted, plan_bytes, rows, state_row, table_bytes, unique_pairs, unpack, unpack_sorted
from partita.llm.words import Words

WINDOW, CELLS_PER_BYTE = 13, 2
RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"
_LAST = np.iinfo(np.int64).max


def _ids(table) -> np.ndarray:
    return np.array([_LAST if x is None else x for x in table["doc_id"].to_pylist()], dtype=np.int64)


def dedup(docs: DataFrame, window: int = WINDOW, per_owner: int | None = None) -> DataFrame:
    n = per_owner or owners(docs)
    bits = max(10, int(np.ceil(np.log2(CELLS_PER_BYTE * max(1, plan_bytes(docs))))))
    bits = min(bits, 60)

    def cells(words, at):
        """The two rows' cells, in the upper bits so that owners get even shares."""
        return [words.window_hash(at, window, second) >> np.uint64(64 - bits) << np.uint64(64 - bits) for second in (False, True)]

    def count(block, data):
        words = Words(bytes_table(data), lower=False)
        found = [np.unique(c, return_counts=True) for c in cells(words, words.windows(window))]
        cuts = [owner_cuts(u, n) for u, _ in found]
        for k in np.flatnonzero(np.any([np.diff(c) for c in cuts], axis=0)).tolist():
            yield k, pack(*(x for (u, m), c in zip(found, cuts, strict=True) for x in (pack_sorted(u[c[k] : c[k + 1]]), np.packbits(m[c[k] : c[k + 1]] > 1), np.array([c[k + 1] - c[k]]))))

    def merge(owner, messages):
        told, many = [unpack(m) for _, m in messages], []
        for row in (0, 3):
            sizes = [int(t[row + 2][0]) for t in told]
            cell = np.concatenate([unpack_sorted(t[row]) for t in told])
            twice = np.concatenate([np.unpackbits(t[row + 1], count=m) for t, m in zip(told, sizes, strict=True)])
            order = np.argsort(cell)
            ordered = cell[order]
            heads = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(cell) else np.zeros(0, np.int64)
            total = np.add.reduceat(1 + twice[order].astype(np.int64), heads) if len(cell) else heads
            high = np.zeros(len(cell), dtype=bool)
            high[order] = np.repeat(total > 1, np.diff(heads, append=len(cell)))
            many.append(np.split(high, np.cumsum(sizes)[:-1]))
        for (block, _), a, b in zip(messages, *many, strict=True):
            yield block, pack(np.packbits(a), np.packbits(b), np.array([len(a), len(b)]))

    def estimated(block, data, replies):
        words = Words(bytes_table(data), lower=False)
        at = words.windows(window)
        high = np.ones(len(at), dtype=bool)
        told = [unpack(replies[k]) for k in sorted(replies)]
        for row, c in enumerate(cells(words, at)):
            _, back = np.unique(c, return_inverse=True)
            if len(at):
                high &= np.concatenate([np.unpackbits(t[row], count=int(t[2][row])) for t in told]).astype(bool)[back]
        flags = pack(pack_sorted(at[high].astype(np.uint32)))
        yield state_row(block, len(flags).to_bytes(8, "little") + flags + (data if isinstance(data, bytes) else table_bytes(data)))

    def opened(data):
        """The block's windows that are estimated as repeated: their order and numbers by fingerprint, the
        first of each number, documents and each number's smallest document."""
        size = int.from_bytes(data[:8], "little")
        table = bytes_table(data[8 + size :])
        words, at = Words(table, lower=False), unpack_sorted(unpack(data[8 : 8 + size])[0]).astype(np.int64)
        a, b = words.window_hash(at, window), words.window_hash(at, window, True)
        order, number = unique_pairs(a, b)
        heads = np.flatnonzero(np.diff(number, prepend=-1))
        doc = _ids(table)[words.doc[at]]
        least = np.minimum.reduceat(doc[order], heads) if len(at) else doc
        return table, words, at, (a[order[heads]], b[order[heads]]), order, number, doc, least

    def offer(block, data):
        *_, (a, b), _, _, _, least = opened(data)
        cuts = owner_cuts(a, n)
        for k in np.flatnonzero(np.diff(cuts)):
            part = slice(cuts[k], cuts[k + 1])
            yield int(k), pack(pack_sorted(a[part]), b[part], least[part])

    def smallest(owner, messages):
        told = [unpack(m) for _, m in messages]
        order, number = unique_pairs(np.concatenate([unpack_sorted(t[0]) for t in told]), np.concatenate([t[1] for t in told]))
        mine = np.concatenate([t[2] for t in told])
        least = np.minimum.reduceat(mine[order], np.flatnonzero(np.diff(number, prepend=-1)))
        smaller, at = np.zeros(len(mine), dtype=bool), 0
        smaller[order] = least[number] < mine[order]
        for (block, _), t in zip(messages, told, strict=True):
            yield block, pack(np.packbits(smaller[at : at + len(t[0])]), np.array([len(t[0])]))
            at += len(t[0])

    def removed(block, data, replies):
        table, words, at, _, order, number, doc, least = opened(data)
        cover = np.zeros(len(words.start) + 1, dtype=np.int64)
        if len(at):
            elsewhere = np.concatenate([np.unpackbits(bits, count=int(m[0])) for bits, m in (unpack(replies[k]) for k in sorted(replies))]).astype(bool)
            hit = at[order[elsewhere[number] | (least[number] < doc[order])]]
            np.add.at(cover, hit, 1)
            np.add.at(cover, hit + window, -1)
        gone = np.cumsum(cover[:-1]) > 0
        # the kept words, each with one space behind
        data, keep = words.data.copy(), np.flatnonzero(~gone)
        data[words.end] = 32
        inside = np.zeros(len(data) + 1, dtype=np.int8)
        inside[words.start[keep]] = 1
        inside[words.end[keep] + 1] -= 1
        inside = np.cumsum(inside[:-1], dtype=np.int8).view(bool)
        at = np.concatenate([[0], np.cumsum(inside)])[np.append(words.starts, len(data))]
        kept = data[inside].tobytes()
        hashes = [hashlib.sha256(kept[a : max(a, b - 1)]).hexdigest() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        lost = np.concatenate([[0], np.cumsum(gone)])
        yield rows(RESULT, doc_id=table["doc_id"].to_pylist(), n_words=words.count, n_removed=lost[words.first + words.count] - lost[words.first], kept_sha256=hashes)

    marked = checkpointed(ask(Docs(docs), n, count, merge, estimated, STATE))
    return ask(marked, n, offer, smallest, removed, RESULT)
