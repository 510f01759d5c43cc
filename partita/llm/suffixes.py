"""Substring dedup by suffix arrays: Larsson-Sadakane refinement, Kasai prefixes, merging by binary search.

Each ``window``-byte string of a document belongs to the least hash among its ``gram``-byte
strings; equal strings have equal such anchors, wherever they lie.  Neighbouring strings of one
anchor form a *context*.  In round one a block tells each anchor's owner the fingerprints of its
distinct contexts.  An anchor with one context that is met once and holds it once repeats nowhere; a
context met twice repeats in whole.  In round two, all other contexts are sorted: one block sends
each context's bytes, the owner puts whole anchors into shards of a bounded size, builds each
shard's suffix array and common prefixes, and, where an anchor spans shards, merges their sorted
windows by binary search.  An anchor with more than ``HOT`` contexts would make its owner grow
with the data: its windows are dealt and grouped by their own 128-bit fingerprints instead, which
are even.

Null and empty texts have no bytes and lose none.  Repeated rows are documents of their own, so
both lose what they share; a null doc_id is kept as null.  Matches never cross documents.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame

from partita.llm.blocks import STATE, ask, bytes_table, checkpointed, Docs, mix, owner_cuts, owners, pack, pack_sorted, rows, state_row, unpack, unpack_sorted
from partita.llm.words import _BASES, _BYTES, Prefix, joined

WINDOW, GRAM, RUN, SHARD, HOT, BLOCK = 400, 48, 512, 1 << 20, 2000, 2 << 20
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
REPEATED, SEVERAL, SENDER, MANY = 1, 2, 4, 8
_PAIR = [("a", np.uint64), ("b", np.uint64)]


# --- suffix arrays -----------------------------------------------------------------------


def suffix_array(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, rank) of all suffixes of the strings data[start : start + size], each ended by a
    mark of its own; sorted groups are left alone while the compared depth doubles."""
    n, m = len(data), len(start)
    string = np.repeat(np.arange(m), size)
    left = (start + size)[string] - np.arange(n)
    key = np.minimum(left, 7).astype(np.uint64)
    padded = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    for k in range(7):
        key |= np.where(k < left, padded[k : k + n], np.uint64(0)) << np.uint64(8 * (7 - k))
    order = np.argsort(key, kind="stable")
    rank, slots, group, depth = np.empty(n, np.int64), np.arange(n), key[order], 7
    while len(slots):
        here = order[slots]
        new = np.ones(len(slots), dtype=bool)
        new[1:] = group[1:] != group[:-1]
        heads = np.flatnonzero(new)
        width = np.diff(heads, append=len(slots))
        rank[here] = np.repeat(slots[heads], width)
        open_ = np.repeat(width > 1, width)
        slots = slots[open_]
        here = here[open_]
        beyond = np.where(depth < left[here], rank[np.minimum(here + depth, n - 1)] + m, string[here])
        group = rank[here] * (n + m) + beyond
        by = np.argsort(group, kind="stable")
        order[slots], group = here[by], group[by]
        depth *= 2
    return order, rank


def common_prefixes(data: np.ndarray, start: np.ndarray, size: np.ndarray, order: np.ndarray, rank: np.ndarray, most: int) -> np.ndarray:
    """By position: the common prefix with the suffix sorted just before, up to ``most``.

    A step in the text lowers it by one at most (Kasai); one pass goes along all strings at once."""
    n = len(data)
    words = np.zeros(n + 8, dtype=np.uint64)
    padded = np.concatenate([data, np.zeros(16, np.uint8)])
    for k in range(8):
        words |= padded[k : k + n + 8].astype(np.uint64) << np.uint64(8 * k)
    left = np.repeat(start + size, size) - np.arange(n)
    before = np.full(n, -1, dtype=np.int64)
    before[order[1:]] = order[:-1]
    out = np.zeros(n, dtype=np.int64)
    by = np.argsort(-size, kind="stable")
    first, depth = start[by], np.zeros(len(start), dtype=np.int64)
    alive = np.searchsorted(-size[by], -np.arange(int(size.max(initial=0))), side="left")
    for step, m in enumerate(alive.tolist()):
        p = first[:m] + step
        q = before[p]
        limit = np.where(q < 0, 0, np.minimum(np.minimum(left[p], left[q]), most))
        depth = np.maximum(depth[:m] - 1, 0)
        go = np.flatnonzero(depth < limit)
        while len(go):
            x = words[p[go] + depth[go]] ^ words[q[go] + depth[go]]
            equal = np.where(x == 0, 8, np.log2((x & (~x + np.uint64(1))).astype(np.float64), where=x != 0, out=np.zeros(len(x))).astype(np.int64) >> 3)
            depth[go] = np.minimum(depth[go] + equal, limit[go])
            go = go[(equal == 8) & (depth[go] < limit[go])]
        out[p] = depth
    return out


def _compare(words: np.ndarray, p: np.ndarray, q: np.ndarray, size: int) -> np.ndarray:
    """Signs of the comparison of the windows at p and q; ``words`` are 8 bytes from each position."""
    sign, open_ = np.zeros(len(p), dtype=np.int8), np.arange(len(p))
    for k in [*range(0, size - 7, 8), size - 8]:
        a, b = words[p[open_] + k], words[q[open_] + k]
        sign[open_] = (a > b).astype(np.int8) - (a < b)
        open_ = open_[a == b]
        if not len(open_):
            break
    return sign


def merged(words: np.ndarray, run: np.ndarray, more: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two sorted runs of distinct windows merged by binary search: (run, members of run and of more that are in both)."""
    low, high = np.zeros(len(more), np.int64), np.full(len(more), len(run))
    while (open_ := np.flatnonzero(low < high)).size:
        middle = (low[open_] + high[open_]) >> 1
        less = _compare(words, run[middle], more[open_], size) < 0
        low[open_[less]], high[open_[~less]] = middle[less] + 1, middle[~less]
    inside = np.flatnonzero(low < len(run))
    same = inside[_compare(words, run[low[inside]], more[inside], size) == 0]
    new = np.ones(len(more), dtype=bool)
    new[same] = False
    return np.insert(run, low[new], more[new]), run[low[same]], more[same]


def repeated_windows(data: np.ndarray, size: np.ndarray, anchor: np.ndarray, window: int, shard: int = SHARD) -> np.ndarray:
    """By position of the strings in ``data``: whether its window also starts elsewhere.  Strings of one anchor are neighbours."""
    flag = np.zeros(len(data), dtype=bool)
    if not len(size):
        return flag
    ends = np.cumsum(size)
    heads = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    weight = np.diff(np.concatenate([[0], ends])[np.append(heads, len(size))])
    shards, filled = [], shard
    for head, nxt, w in zip(heads.tolist(), [*heads[1:].tolist(), len(size)], weight.tolist(), strict=True):
        if w > shard:  # an anchor that spans shards
            part = (ends[head:nxt] - (ends[head] - size[head])) // shard
            cuts = [head, *(head + 1 + np.flatnonzero(np.diff(part))).tolist(), nxt]
            shards += [(a, b, head) for a, b in zip(cuts, cuts[1:], strict=False)]
            filled = shard
        elif filled + w > shard:
            shards.append((head, nxt, -1))
            filled = w
        else:
            shards[-1] = (shards[-1][0], nxt, -1)
            filled += w
    run, spans, words = np.zeros(0, np.int64), -1, None
    for a, b, anchor_of in shards:
        base, end = int(ends[a] - size[a]), int(ends[b - 1])
        own = np.concatenate([[0], np.cumsum(size[a:b])])[:-1]
        order, rank = suffix_array(data[base:end], own, size[a:b])
        prefix = common_prefixes(data[base:end], own, size[a:b], order, rank, window)
        left = np.repeat(own + size[a:b], size[a:b]) - np.arange(end - base)
        at = order[left[order] >= window]
        like = prefix[at] >= window
        many = like.copy()
        many[:-1] |= like[1:]
        flag[base + at[many]] = True
        if anchor_of < 0:
            continue
        group = np.cumsum(~like) - 1
        distinct = base + at[~like]
        if anchor_of != spans:
            run, spans = distinct, anchor_of
        else:
            if words is None:
                padded = np.concatenate([data, np.zeros(8, np.uint8)])
                words = np.zeros(len(data), dtype=np.uint64)
                for k in range(8):
                    words |= padded[k : k + len(data)].astype(np.uint64) << np.uint64(8 * (7 - k))
            run, old, mine = merged(words, run, distinct, window)
            flag[old] = True
            flag[base + at[np.isin(distinct, mine)[group]]] = True
    return flag


# --- contexts ----------------------------------------------------------------------------


class Contexts:
    """Runs of windows of a block that share an anchor: first window, number, anchor, fingerprint."""

    def __init__(self, table, window: int):
        self.data, self.starts, self.ends = joined(table)
        n, gram = len(self.data), min(GRAM, window)
        span = window - gram + 1
        self.one = Prefix(_BYTES[0][self.data], int(_BASES[0]))
        self.two = Prefix(_BYTES[1][self.data], int(_BASES[1]))
        able = np.zeros(n + 1, dtype=np.int64)
        long = self.ends - self.starts >= window
        np.add.at(able, self.starts[long], 1)
        np.add.at(able, self.ends[long] - window + 1, -1)
        at = np.flatnonzero(np.cumsum(able[:n]) > 0)
        if not len(at):
            self.first, self.number = np.zeros(0, np.int64), np.zeros(0, np.int64)
            self.key, self.inner = np.zeros(0, dtype=_PAIR), np.zeros(0, dtype=bool)
            return
        p = np.arange(n - gram + 1)
        grams = self.one.of(p, p + gram)
        least, width = grams, 1
        while 2 * width <= span:
            least = np.minimum(least[: len(least) - width], least[width:])
            width *= 2
        m = least[at] if width == span else np.minimum(least[at], least[at + span - width])
        new = np.ones(len(at), dtype=bool)
        new[1:] = (m[1:] != m[:-1]) | (np.diff(at) != 1)
        heads = np.flatnonzero(new)
        new |= (np.arange(len(at)) - np.repeat(heads, np.diff(heads, append=len(at)))) % RUN == 0
        heads = np.flatnonzero(new)
        self.first, self.number = at[heads], np.diff(heads, append=len(at))
        self.key = np.empty(len(heads), dtype=_PAIR)
        self.key["a"] = mix(m[heads])  # minima alone are not even
        self.key["b"] = self.two.of(self.first, self.first + self.number - 1 + window)
        # an anchor that a context holds twice may make windows repeat inside the context
        room = self.number - 1 + span
        held = grams[_flat(self.first, room)] == np.repeat(m[heads], room)
        self.inner = np.add.reduceat(held, np.cumsum(room) - room, dtype=np.int64) > 1


def _flat(first: np.ndarray, number: np.ndarray) -> np.ndarray:
    return np.repeat(first - np.concatenate([[0], np.cumsum(number)[:-1]]) if len(first) else first, number) + np.arange(int(number.sum()))


def dedup(docs: DataFrame, window: int = WINDOW, n_owners: int | None = None, shard: int = SHARD, hot: int = HOT) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for every row."""
    n = n_owners or owners(docs)

    def offer(block, data):
        c = Contexts(bytes_table(data), window)
        key, one, count = np.unique(c.key, return_index=True, return_counts=True)
        cuts = owner_cuts(key["a"], n)
        for k in np.flatnonzero(np.diff(cuts)):
            part = slice(cuts[k], cuts[k + 1])
            yield int(k), pack(pack_sorted(key["a"][part]), key["b"][part], count[part] > 1, c.inner[one[part]])

    def classed(owner, messages):
        told = [unpack(m) for _, m in messages]
        key = np.empty(sum(len(t[0]) for t in told), dtype=_PAIR)
        key["a"], key["b"] = np.concatenate([unpack_sorted(t[0]) for t in told]), np.concatenate([t[1] for t in told])
        unique, first, back, met = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
        met[back[np.concatenate([t[2] for t in told]).astype(bool)]] = 2
        heads = np.flatnonzero(np.concatenate([[True], unique["a"][1:] != unique["a"][:-1]]))
        kinds = np.diff(heads, append=len(unique))
        kinds = np.repeat(kinds, kinds)
        inner = np.concatenate([t[3] for t in told]).astype(bool)[first]
        code = REPEATED * (met > 1) + SEVERAL * ((kinds > 1) | inner) + MANY * (kinds > hot)
        code = code[back]
        code[first] += SENDER
        at = 0
        for (block, _), t in zip(messages, told, strict=True):
            yield block, pack(code[at : at + len(t[0])].astype(np.uint8))
            at += len(t[0])

    def marked(block, data, replies):
        c = Contexts(bytes_table(data), window)
        key, back = np.unique(c.key, return_inverse=True)
        code = np.concatenate([np.zeros(0, np.uint8), *(unpack(replies[k])[0] for k in sorted(replies))])
        head = pack(c.first, c.number, c.key["a"], back, code)
        yield state_row(block, len(head).to_bytes(8, "little") + head + data)

    def opened(data):
        size = int.from_bytes(data[:8], "little")
        first, number, anchor, back, code = unpack(data[8 : 8 + size])
        table = bytes_table(data[8 + size :])
        # one place of each distinct context that this block sends, in the order of anchors
        place = np.full(len(code), -1, dtype=np.int64)
        place[back[::-1]] = np.arange(len(back))[::-1]
        sent = np.flatnonzero((code & SENDER > 0) & (code & SEVERAL > 0))
        return table, first, number, anchor, back, code, place, sent

    def hot_windows(raw, first, number, place, some):
        at = _flat(first[place[some]], number[place[some]])
        key = np.empty(len(at), dtype=_PAIR)
        if len(at):
            key["a"], key["b"] = (Prefix(_BYTES[i][raw], int(_BASES[i])).of(at, at + window) for i in (0, 1))
        return at, *np.unique(key, return_inverse=True, return_counts=True)

    def ship(block, data):
        table, first, number, anchor, _, code, place, sent = opened(data)
        raw, *_ = joined(table)
        cool, warm = sent[code[sent] & MANY == 0], sent[code[sent] & MANY > 0]
        _, key, _, count = hot_windows(raw, first, number, place, warm)
        cuts, hot_cuts = owner_cuts(anchor[place[cool]], n), owner_cuts(key["a"], n)
        for k in range(n):
            mine, part = place[cool[cuts[k] : cuts[k + 1]]], slice(hot_cuts[k], hot_cuts[k + 1])
            if len(mine) or hot_cuts[k] < hot_cuts[k + 1]:
                size = number[mine] - 1 + window
                yield k, pack(raw[_flat(first[mine], size)], size, anchor[mine], pack_sorted(key["a"][part]), key["b"][part], count[part] > 1)

    def sorted_(owner, messages):
        told = [unpack(m) for _, m in messages]
        size, anchor = np.concatenate([t[1] for t in told]), np.concatenate([t[2] for t in told])
        text = np.concatenate([t[0] for t in told])
        start = np.cumsum(size) - size
        by = np.argsort(anchor, kind="stable")
        flag = np.zeros(len(text), dtype=bool)
        source = _flat(start[by], size[by])
        flag[source] = repeated_windows(text[source], size[by], anchor[by], window, shard)
        key = np.empty(sum(len(t[3]) for t in told), dtype=_PAIR)
        key["a"], key["b"] = np.concatenate([unpack_sorted(t[3]) for t in told]), np.concatenate([t[4] for t in told])
        _, back, met = np.unique(key, return_inverse=True, return_counts=True)
        met[back[np.concatenate([t[5] for t in told]).astype(bool)]] = 2
        again = met[back] > 1
        at = hot_at = 0
        for (block, _), t in zip(messages, told, strict=True):
            yield block, pack(np.packbits(flag[at : at + len(t[0])]), np.packbits(again[hot_at : hot_at + len(t[3])]), np.array([len(t[3])]))
            at, hot_at = at + len(t[0]), hot_at + len(t[3])

    def removed(block, data, replies):
        table, first, number, anchor, back, code, place, sent = opened(data)
        raw, starts, ends = joined(table)
        cover = np.zeros(len(raw) + window + 1, dtype=np.int32)
        whole = code[back] & REPEATED > 0
        np.add.at(cover, first[whole], 1)
        np.add.at(cover, first[whole] + number[whole] - 1 + window, -1)
        cool, warm = sent[code[sent] & MANY == 0], sent[code[sent] & MANY > 0]
        told = {k: unpack(r) for k, r in replies.items()}
        mine = place[cool]
        cuts = owner_cuts(anchor[mine], n)
        for k in np.flatnonzero(np.diff(cuts)).tolist():
            some = mine[cuts[k] : cuts[k + 1]]
            at = _flat(first[some], number[some] - 1 + window)
            hit = at[np.unpackbits(told[k][0], count=len(at)).astype(bool)]
            np.add.at(cover, hit, 1)
            np.add.at(cover, hit + window, -1)
        if len(warm):
            at, _, same, _ = hot_windows(raw, first, number, place, warm)
            again = np.concatenate([np.unpackbits(told[k][1], count=int(told[k][2][0])) for k in sorted(told)]).astype(bool)
            hit = at[again[same]]
            np.add.at(cover, hit, 1)
            np.add.at(cover, hit + window, -1)
        gone = np.cumsum(cover[: len(raw)]) > 0
        spans = np.flatnonzero(gone & ~np.concatenate([[False], gone[:-1]]))
        out = {"n_removed": [], "n_spans": [], "kept_sha256": []}
        for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
            out["n_removed"].append(int(gone[a:b].sum()))
            out["n_spans"].append(int(np.searchsorted(spans, b) - np.searchsorted(spans, a)))
            out["kept_sha256"].append(hashlib.sha256(raw[a:b][~gone[a:b]].tobytes()).hexdigest())
        yield rows(RESULT, doc_id=table["doc_id"].to_pylist(), n_bytes=(ends - starts).tolist(), **out)

    state = checkpointed(ask(Docs(docs, BLOCK), n, offer, classed, marked, STATE))
    return ask(state, n, ship, sorted_, removed, RESULT)
