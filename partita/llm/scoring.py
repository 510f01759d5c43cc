"""Language-model scores by deleted interpolation.

Words and word pairs are counted exactly over all training documents in one block round.  A
token's probability mixes its pair's and its own maximum-likelihood estimates and the uniform
one; the weights depend on the bucket (power of two) of how often the context was seen, and
expectation-maximisation learns them on held-out counts: each training token is scored with its
own occurrence deleted from the counts.  The statistics of that are counts of events on a grid of
estimate ratios (``GRID`` steps to a doubling), whose size does not depend on the corpus.

Null and empty texts are one end token.  A null doc_id is taken as the empty string by the split
and returned as null.  Repeated rows are scored one by one and each counts in training.  Without
training tokens the pair and word estimates are zero.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partita.llm.blocks import GOLDEN, STATE, ask, bytes_table, checkpointed, Docs, mix, owner_cuts, owners, pack, pack_sorted, rows, state_row, table_bytes, unpack, unpack_sorted
from partita.llm.words import Words

FOLDS, HELD, GRID, EM_STEPS, LEAST_UNIFORM = 7, 2, 4, 200, 1e-4
RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
_END = np.uint64(0x5851F42D4C957F2D)
_NONE = -(1 << 20)  # the grid's place of an estimate of zero


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % FOLDS == HELD


class _Tokens:
    def __init__(self, table: pa.Table):
        words = Words(table, lower=True)
        at = words.first + words.count
        self.ids = table["doc_id"].to_pylist()
        self.doc = np.insert(words.doc, at, np.arange(words.n_docs))
        token = np.insert(words.hash, at, _END)
        before = np.concatenate([[_END], token[:-1]]).astype(np.uint64)  # a document begins after an end
        train = np.array([not held_out(i) for i in self.ids], dtype=bool)[self.doc]
        self.keys, self.back, self.counts = [], [], []
        for key in (token, mix(before * GOLDEN + token)):
            unique, back = np.unique(key, return_inverse=True)
            self.keys.append(unique)
            self.back.append(back)
            self.counts.append(np.bincount(back[train], minlength=len(unique)).astype(np.uint64))


def _counted(docs: DataFrame, n: int) -> DataFrame:
    """State of each block: documents' ids, tokens' documents and counts, its training tokens and its share
    of the distinct ones (a word is counted where it is met first)."""

    def send(block, data):
        t = _Tokens(bytes_table(data))
        cuts = [owner_cuts(u, n) for u in t.keys]
        for k in np.flatnonzero(np.any([np.diff(c) for c in cuts], axis=0)).tolist():
            yield k, pack(*(x for u, m, c in zip(t.keys, t.counts, cuts, strict=True) for x in (pack_sorted(u[c[k] : c[k + 1]]), m[c[k] : c[k + 1]])))

    def answer(owner, messages):
        got = [unpack(m) for _, m in messages]
        told = [[] for _ in got]
        for row in (0, 2):
            keys = [unpack_sorted(g[row]) for g in got]
            source = np.repeat(np.arange(len(got)), [len(k) for k in keys])
            unique, first, back = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
            total = np.bincount(back, weights=np.concatenate([g[row + 1] for g in got]), minlength=len(unique)).astype(np.uint64)
            for part, out in zip(np.split(total[back], np.cumsum([len(k) for k in keys])[:-1]), told, strict=True):
                out.append(part)
            if row == 0:
                share = np.bincount(source[first[total > 0]], minlength=len(got))
        for (block, _), t, mine in zip(messages, told, share.tolist(), strict=True):
            yield block, pack(*t, np.array([mine]))

    def fold(block, data, replies):
        replies = [unpack(replies[k]) for k in sorted(replies)]
        t = _Tokens(bytes_table(data))
        words, pairs = (np.concatenate([r[j] for r in replies]) if replies else np.zeros(0, np.uint64) for j in (0, 1))
        ids = table_bytes(pa.table({"doc_id": pa.array(t.ids, pa.int64())}))
        totals = np.array([sum(int(r[2][0]) for r in replies), int(t.counts[0].sum())])
        yield state_row(block, len(ids).to_bytes(8, "little") + ids + pack(np.bincount(t.doc, minlength=len(t.ids)), words[t.back[0]], pairs[t.back[1]], totals))

    return checkpointed(ask(Docs(docs), n, send, answer, fold, STATE))


def _totals(state: DataFrame) -> tuple[int, int]:
    """Distinct training tokens, and all."""

    def told(batches):
        for batch in batches:
            found = [_unpacked(d.as_py())[3].tolist() for d in batch["data"]]
            yield rows("v long, n long", v=[sum(x for x, _ in found)], n=[sum(x for _, x in found)])

    return tuple(x or 0 for x in state.mapInArrow(told, "v long, n long").agg(F.sum("v"), F.sum("n")).first())


def _unpacked(data: bytes) -> list[np.ndarray]:
    return unpack(data[8 + int.from_bytes(data[:8], "little") :])


def _opened(data: bytes):
    """(doc ids, tokens' documents, counts of words, of pairs, of contexts)."""
    size = int.from_bytes(data[:8], "little")
    ids = bytes_table(data[8 : 8 + size])["doc_id"].to_pylist()
    length, words, pairs, _ = _unpacked(data)
    doc = np.repeat(np.arange(len(ids)), length)
    context = np.concatenate([words[-1:], words[:-1]]).astype(float)  # the block's last token is an end, as is each document's
    return ids, doc, words.astype(float), pairs.astype(float), context


def _bucket(context: np.ndarray) -> np.ndarray:
    return np.where(context > 0, 1 + np.floor(np.log2(np.maximum(context, 1))), 0).astype(np.int64)


def _ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.divide(a, b, out=np.zeros(len(a)), where=np.asarray(b) > 0)


def weights(events: np.ndarray) -> dict[int, np.ndarray]:
    """Mixture weights (pair, word, uniform) of each bucket, from rows (bucket, pair, word, n); bucket -1 is all."""

    def learned(part):
        estimate = np.stack([*(np.where(part[:, j] == _NONE, 0.0, 2.0 ** (part[:, j] / GRID)) for j in (1, 2)), np.ones(len(part))], axis=1)
        w, n = np.full(3, 1 / 3), part[:, 3].astype(float)
        for _ in range(EM_STEPS):
            share = estimate * w
            share /= share.sum(axis=1, keepdims=True)
            w = (share * n[:, None]).sum(axis=0) / n.sum()
            w[2] = max(w[2], LEAST_UNIFORM)
            w /= w.sum()
        return w

    out = {-1: learned(events) if len(events) else np.array([0.0, 0.0, 1.0])}
    return out | {int(b): learned(events[events[:, 0] == b]) for b in np.unique(events[:, 0])}


def scores(docs: DataFrame, n_owners: int | None = None) -> DataFrame:
    state = _counted(docs, n_owners or owners(docs))
    distinct, number = _totals(state)

    def gather(batches):
        for batch in batches:
            for data in batch["data"]:
                ids, doc, words, pairs, context = _opened(data.as_py())
                train = np.array([not held_out(i) for i in ids], dtype=bool)[doc]
                words, pairs, context = words[train] - 1, pairs[train] - 1, context[train] - 1
                place = lambda p: np.where(p > 0, np.round(GRID * np.log2(np.maximum(p, 1e-300) * (distinct + 1))), _NONE).astype(np.int64)
                cells = np.stack([_bucket(context), place(_ratio(pairs, context)), place(words / max(number - 1, 1))], axis=1)
                found, n = np.unique(cells, axis=0, return_counts=True)
                yield rows("b long, p long, w long, n long", b=found[:, 0], p=found[:, 1], w=found[:, 2], n=n)

    seen = state.mapInArrow(gather, "b long, p long, w long, n long").groupBy("b", "p", "w").agg(F.sum("n").alias("n")).orderBy("b", "p", "w").collect()
    mixture = weights(np.array([tuple(r) for r in seen], dtype=np.int64).reshape(-1, 4))
    table = np.stack([mixture.get(b, mixture[-1]) for b in range(66)])

    def score(batches):
        for batch in batches:
            for data in batch["data"]:
                ids, doc, words, pairs, context = _opened(data.as_py())
                w = table[_bucket(context)]
                p = w[:, 0] * _ratio(pairs, context) + w[:, 1] * words / max(number, 1) + w[:, 2] / (distinct + 1)
                total = lambda x: np.bincount(doc, weights=x, minlength=len(ids))  # noqa: B023, E731
                yield rows(
                    RESULT, doc_id=ids, held_out=[held_out(i) for i in ids], n_tokens=np.bincount(doc, minlength=len(ids)), n_known=total(words > 0).astype(np.int64), train_tokens=[number] * len(ids),
                    base_score=total(np.log10((words + 1) / (number + distinct + 1))), score=total(np.log10(p)),
                )

    return state.mapInArrow(score, RESULT)
