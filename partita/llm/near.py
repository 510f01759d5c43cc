"""Near-duplicate grouping: SuperMinHash signatures, banding, verification, union-find.

Each shingle has a random rank permutation of the signature's slots (an affine map modulo the
prime number of slots) and puts, rank by rank, a random value into the slot of that rank; a slot
keeps the least (rank, value).  Ranks of one shingle never collide, which lowers the variance
against independent minima, and a document stops at the first rank that fills its last slot.
Bands of ``ROWS`` slots give bucket keys.

Documents with equal shingle sets form a class, represented by its row with the smallest doc_id.
In each bucket hubs are compared with the members that are not yet connected with them: first by
one byte of each slot, which leaves out pairs that share under ``LEAST`` slots (six standard
deviations under those of a pair at 0.75), then on full shingle sets.  The first round asks for the sets
of pairs that are probably linked alone, so a large group of near copies collapses in it.  From the second on
members outside the bucket's largest component become hubs, and each member sends its set as short prints, once to an owner:
equal prints count at least what two sets share, so a pair whose prints cannot reach the threshold is settled
where its bucket is, and full sets go to blocks for the few others only.  Every pair of a bucket is compared, excluded by
its prints or connected, and none is capped; of a family of unlike relatives, whose pairs grow with the square of its size, no sets are sent around.  A bucket of over ``WIDE`` members that stay unlike is split by each other
band in turn: a pair at 0.75 that shares one band shares another with probability
1 - (1 - 0.75**3)**31, as sure as the banding itself, which finds it with 1 - (1 - 0.75**3)**32,
all but 3 in 10**8.

Null and empty texts have no shingles, are linked with nothing and are kept.  Rows are told apart
by their place, so rows that share a doc_id are compared like others.  A null doc_id is larger
than all others and stays null; component_id is null where no row of a component has a doc_id.
An empty table gives no rows; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partita.llm.blocks import GOLDEN, STATE, Docs, ask, bytes_table, checkpointed, forget, fresh, mix, owner_of, owners, pack, pack_sorted, rows, state_row, tabled, unique_pairs, unpack, unpack_sorted
from partita.llm.words import Words

SHINGLE, SLOTS, ROWS = 5, 97, 3
BANDS = SLOTS // ROWS
LEAST, LIKELY = 47, 72  # shared slots of pairs that are compared at all, and of those that are probably linked
WIDE, FIRST_HUBS = 1024, 64
NARROW = 2048  # sets of at most so many shingles send prints of 16 bits, others of 32
RESULT = "doc_id long, n_shingles long, component_id long, kept boolean"
_LAST = np.iinfo(np.int64).max
_FULL = np.iinfo(np.uint64).max
OPEN, HUB, SPLIT = 0, 1, 2


def shingles(words: Words, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of the distinct shingles of a block, sorted."""
    at = words.windows(k)
    short = np.flatnonzero((words.count > 0) & (words.count < k))
    doc = np.concatenate([words.doc[at], short])
    value = words.window_hash(at, k)
    if len(short):
        ends = words.first[short] + words.count[short]
        value = np.concatenate([value, [words.window_hash(words.first[[s]], int(e - words.first[s]))[0] for s, e in zip(short, ends, strict=True)]]).astype(np.uint64)
        order = np.argsort(doc, kind="stable")
        doc, value = doc[order], value[order]
    cuts = np.searchsorted(doc, np.arange(words.n_docs + 1)).tolist()
    for a, b in zip(cuts, cuts[1:], strict=False):
        value[a:b].sort()
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
    return doc[new], value[new]


def signatures(doc: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """n signatures of SLOTS values; documents without shingles keep the largest value."""
    sig = np.full(n * SLOTS, _FULL, dtype=np.uint64)
    shift = (mix(value ^ np.uint64(0xA5A5A5A5A5A5A5A5)) % np.uint64(SLOTS)).astype(np.int64)
    step = 1 + (mix(value + GOLDEN) % np.uint64(SLOTS - 1)).astype(np.int64)
    for rank in range(SLOTS):
        if not len(doc):
            break
        cell = doc * SLOTS + (shift + rank * step) % SLOTS
        free = sig[cell] == _FULL  # slots of lower ranks are final
        salt = np.uint64(int(GOLDEN) * (rank + 2) % (1 << 64))
        np.minimum.at(sig, cell[free], mix(value[free] + salt) >> np.uint64(1))
        open_ = (sig.reshape(n, SLOTS) == _FULL).any(axis=1)[doc]
        doc, value, shift, step = doc[open_], value[open_], shift[open_], step[open_]
    return sig.reshape(n, SLOTS)


def bands(sig: np.ndarray) -> np.ndarray:
    keys = np.zeros((len(sig), BANDS), dtype=np.uint64)
    for band in range(BANDS):
        for slot in range(band * ROWS, band * ROWS + ROWS):
            keys[:, band] = mix(keys[:, band] * GOLDEN + sig[:, slot] + np.uint64(band + 1))
    return keys


def _ids(table) -> np.ndarray:
    return np.array([_LAST if x is None else x for x in table["doc_id"].to_pylist()], dtype=np.int64)


def _places(block: int, n: int) -> np.ndarray:
    """The rows' own keys: scan partition (20 bits), block (26), row (16, as a block's rows take 64 bytes at least)."""
    return ((block >> 32) << 42 | (block & 0xFFFFFFFF) << 16) + np.arange(n, dtype=np.int64)


def _cat(parts: list, kind=np.int64) -> np.ndarray:
    return np.concatenate(parts) if parts else np.zeros(0, kind)


def _parts(sorted_keys: np.ndarray, n: int):
    cuts = np.searchsorted(owner_of(sorted_keys, n), np.arange(n + 1))
    return [(int(k), slice(cuts[k], cuts[k + 1])) for k in np.flatnonzero(np.diff(cuts))]


# --- classes of equal sets, and the buckets that two or more of them share ------------------


def _classes(docs: DataFrame, n: int) -> DataFrame:
    """State of each block: ids, sizes, representatives; sets, signatures and shared keys of candidates."""

    def told(block, data):
        table = bytes_table(data)
        words = Words(table, lower=True)
        doc, value = shingles(words)
        ids, size = _ids(table), np.bincount(doc, minlength=words.n_docs).astype(np.int64)
        cuts = np.concatenate([[0], np.cumsum(size)])
        total = np.concatenate([[np.uint64(0)], np.cumsum(mix(value ^ GOLDEN), dtype=np.uint64)])
        prints = mix(total[cuts[1:]] - total[cuts[:-1]] + size.astype(np.uint64))
        sig = signatures(doc, value, words.n_docs)
        keys, full, place = bands(sig), np.flatnonzero(size), _places(block, len(ids))
        # each class of the block: its row of the smallest id, the first such
        order = np.lexsort((place[full], ids[full], prints[full]))
        own = full[order]
        own = own[np.concatenate([[True], prints[own][1:] != prints[own][:-1]])] if len(own) else own
        by, number = unique_pairs(keys[full].reshape(-1), np.repeat(prints[full], BANDS))
        heads = by[np.flatnonzero(np.diff(number, prepend=-1))]
        pairs = keys[full].reshape(-1)[heads], np.repeat(prints[full], BANDS)[heads]
        return ids, place, value, size, cuts, prints, sig, keys, full, own, pairs

    def send(block, data):
        ids, place, *_, prints, _, _, _, own, (key, whose) = told(block, data)
        by_print, by_key = dict(_parts(prints[own], n)), dict(_parts(key, n))
        for k in sorted(by_print.keys() | by_key.keys()):
            a, b = own[by_print.get(k, slice(0, 0))], by_key.get(k, slice(0, 0))
            yield k, pack(prints[a], ids[a], place[a], key[b], whose[b])

    def answer(owner, messages):
        got = [unpack(m) for _, m in messages]
        prints, ids, place, key, whose = (np.concatenate([g[j] for g in got]) for j in range(5))
        order = np.lexsort((place, ids, prints))
        first = np.concatenate([[True], prints[order][1:] != prints[order][:-1]]) if len(order) else np.zeros(0, bool)
        head = np.empty(len(order), dtype=np.int64)
        head[order] = order[np.flatnonzero(first)][np.cumsum(first) - 1] if len(order) else order
        shared = np.zeros(len(key), dtype=bool)
        if len(key):
            by, number = unique_pairs(key, whose)
            distinct = np.flatnonzero(np.diff(number, prepend=-1))
            named = key[by[distinct]]
            many = np.zeros(len(named), dtype=bool)
            many[1:] = named[1:] == named[:-1]
            many[:-1] |= many[1:]
            shared[by] = many[number]
        a = b = 0
        for (block, _), g in zip(messages, got, strict=True):
            h = head[a : a + len(g[0])]
            yield block, pack(ids[h], place[h], np.packbits(shared[b : b + len(g[3])]), np.array([len(g[3])]))
            a, b = a + len(g[0]), b + len(g[3])

    def fold(block, data, replies):
        ids, place, value, size, cuts, prints, sig, keys, full, own, (key, _) = told(block, data)
        both = [unpack(replies[k]) for k in sorted(replies)]
        rep_id, rep = ids.copy(), place.copy()
        if len(own):
            at = np.searchsorted(prints[own], prints[full])
            rep_id[full], rep[full] = _cat([x[0] for x in both])[at], _cat([x[1] for x in both])[at]
        shared = np.unique(key[_cat([np.unpackbits(x[2], count=int(x[3][0])) for x in both], np.uint8).astype(bool)])
        where = np.searchsorted(shared, keys)
        mine = (shared[np.minimum(where, len(shared) - 1)] == keys if len(shared) else np.zeros(keys.shape, bool)) & ((rep == place) & (size > 0))[:, None]
        cand = np.flatnonzero(mine.any(axis=1))
        owner, band = np.nonzero(mine[cand])
        sets = _cat([value[cuts[i] : cuts[i + 1]] for i in cand], np.uint64)
        s = _State.of(ids, size, rep_id, rep, place[cand], ids[cand], size[cand], sets, (sig[cand] & np.uint64(255)).astype(np.uint8).reshape(-1), owner, keys[cand[owner], band], np.uint32(1) << band.astype(np.uint32))
        yield state_row(block, s.packed())

    return checkpointed(ask(Docs(docs), n, send, answer, fold, STATE))


class _State:
    """A block.  Of all rows: ids, size, rep_id, rep.  Of candidates with open buckets: place, cid, csize,
    values (sets), sig; of their open buckets: owner, keys, used (bands), hubbed; of this round's
    comparisons: asked_at, asked_hub, asked_id; of verified links: link_at, link_hub, link_id, and
    done (pairs of id and place) once their candidate has no open bucket."""

    KEPT = ("ids", "size", "rep_id", "rep", "place", "cid", "csize", "values", "sig", "owner", "keys", "used", "hubbed", "asked_at", "asked_hub", "asked_id", "link_at", "link_hub", "link_id", "done")

    def __init__(self, data: bytes):
        for name, a in zip(self.KEPT, unpack(data), strict=True):
            setattr(self, name, a)
        self.values = unpack_sorted(self.values)
        self.cuts = np.concatenate([[0], np.cumsum(self.csize)])

    @classmethod
    def of(cls, *arrays) -> _State:
        s, none = cls.__new__(cls), np.zeros(0, np.int64)
        for name, a in zip(cls.KEPT, [*arrays, np.zeros(len(arrays[-1]), np.uint8), *[none] * 7], strict=True):
            setattr(s, name, a)
        return s

    def packed(self) -> bytes:
        return pack(*(pack_sorted(self.values) if name == "values" else getattr(self, name) for name in self.KEPT))

    def set_of(self, i: int) -> np.ndarray:
        return self.values[self.cuts[i] : self.cuts[i + 1]]

    def closed(self, entries: np.ndarray) -> None:
        """Keeps the open ``entries`` and the candidates that have one or are compared in this round."""
        self.owner, self.keys, self.used, self.hubbed = (x[entries] for x in (self.owner, self.keys, self.used, self.hubbed))
        stay = np.zeros(len(self.place), dtype=bool)
        stay[self.owner] = stay[self.asked_at] = True
        gone = ~stay[self.link_at]
        at = self.link_at[gone]
        self.done = np.concatenate([self.done, np.stack([self.cid[at], self.place[at], self.link_id[gone], self.link_hub[gone]], axis=1).reshape(-1)])
        to = np.cumsum(stay) - 1
        self.link_at, self.link_hub, self.link_id = to[self.link_at[~gone]], self.link_hub[~gone], self.link_id[~gone]
        self.values = _cat([self.set_of(i) for i in np.flatnonzero(stay)], np.uint64)
        self.sig = self.sig.reshape(-1, SLOTS)[stay].reshape(-1)
        self.place, self.cid, self.csize = self.place[stay], self.cid[stay], self.csize[stay]
        self.owner, self.asked_at = to[self.owner], to[self.asked_at]


# --- rounds -------------------------------------------------------------------------------


def _local_components(place: np.ndarray, at: np.ndarray, hub: np.ndarray) -> np.ndarray:
    """Component numbers of a bucket's members (by sorted place) from links (member, hub's place): the component's
    first member.  A hub connects the members that are linked with it, whether it is in the bucket or not."""
    up = np.arange(len(place))
    if not len(at):
        return up
    hubs, to = np.unique(hub, return_inverse=True)
    where = np.minimum(np.searchsorted(place, hubs), len(place) - 1)
    inside = place[where] == hubs
    least = np.where(inside, where, len(place))
    while True:
        before = up.copy()
        np.minimum.at(least, to, up[at])
        np.minimum.at(up, at, least[to])
        np.minimum.at(up, where[inside], least[inside])
        up = up[up]
        least[inside] = np.minimum(least[inside], up[where[inside]])
        if (up == before).all():
            return up


def _taken(flat: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The pieces of ``flat`` that begin at ``first``, one after the other."""
    return flat[np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())]


class _Prints:
    """The upper bits of members' shingles: 16 of each in sets of at most NARROW, 32 in others."""

    @staticmethod
    def sent(s: _State, who: np.ndarray) -> list[np.ndarray]:
        narrow = s.csize[who] <= NARROW
        short, long = (_taken(s.values, s.cuts[x], s.csize[x]) for x in (who[narrow], who[~narrow]))
        return [pack_sorted((short >> np.uint64(48)).astype(np.uint16)), pack_sorted((long >> np.uint64(32)).astype(np.uint32))]

    def __init__(self, size: np.ndarray, short: list[np.ndarray], long: list[np.ndarray]):
        """size: of the members of all messages; short, long: what ``sent`` gave for each message."""
        self.size, self.narrow = size, size <= NARROW
        self.flat = np.concatenate([*(unpack_sorted(x).astype(np.uint32) for x in short), *(unpack_sorted(x) for x in long)])
        self.first = np.zeros(len(size), dtype=np.int64)
        order = np.concatenate([np.flatnonzero(self.narrow), np.flatnonzero(~self.narrow)])
        self.first[order] = np.cumsum(size[order]) - size[order]
        self.marked = np.zeros(1 << 16, dtype=bool)

    def most(self, hub: int, members: np.ndarray) -> np.ndarray:
        """How many shingles each member shares with the hub at most: those whose prints the hub has."""
        own = self.flat[self.first[hub] : self.first[hub] + self.size[hub]]
        size = self.size[members]
        theirs = _taken(self.flat, self.first[members], size)
        if self.narrow[hub] or self.narrow[members].any():
            own = own if self.narrow[hub] else own >> np.uint32(16)
            theirs = theirs >> np.repeat(np.where(self.narrow[members], 0, 16), size).astype(np.uint32)
            self.marked[own] = True
            hit = self.marked[theirs]
            self.marked[own] = False
        else:
            hit = own[np.minimum(np.searchsorted(own, theirs), len(own) - 1)] == theirs
        return np.add.reduceat(hit, np.cumsum(size) - size, dtype=np.int64)


def _hubs(sig: np.ndarray, free: np.ndarray, waits: np.ndarray):
    """Members that are free and do not wait, those that agree best with the others of them first: each time
    the one that shares most slots with what is commonest in each slot."""
    while len(open_ := np.flatnonzero(free & ~waits)):
        if len(open_) > 2:
            part = sig[open_]
            count = np.zeros((SLOTS, 256), dtype=np.int64)
            np.add.at(count, (np.arange(SLOTS)[None, :], part), 1)
            turn = open_[np.argsort(-(part == count.argmax(axis=1)[None, :]).sum(axis=1), kind="stable")]
        else:
            turn = open_
        for h in turn.tolist():
            if waits[h]:
                continue
            before = waits.sum()
            yield h
            free = free.copy()
            free[h] = False
            if waits.sum() > before + len(open_) // 8:  # many have gone: ask anew what is commonest
                break


def _requests(state: DataFrame, n: int, percent: int, first: bool) -> DataFrame:
    """Buckets choose hubs; each block learns which of its members to compare with which hubs."""

    def send(block, data):
        s = _State(data)
        order = np.argsort(s.keys, kind="stable")
        by = np.argsort(s.link_at, kind="stable")
        at, hub = s.link_at[by], s.link_hub[by]
        for k, part in _parts(s.keys[order], n):
            e = order[part]
            who, mine = np.unique(s.owner[e], return_inverse=True)
            lo, hi = np.searchsorted(at, who), np.searchsorted(at, who, side="right")
            yield k, pack(s.keys[e], e, s.hubbed[e], mine, who, s.place[who], s.cid[who], s.csize[who], s.sig.reshape(-1, SLOTS)[who].reshape(-1), hi - lo, _cat([hub[a:b] for a, b in zip(lo, hi, strict=True)]), *([] if first else _Prints.sent(s, who)))

    def answer(owner, messages):
        got = [unpack(m) for _, m in messages]
        key, entry, hubbed, mine, who, place, cid, size, sig, width, flat = (np.concatenate([g[j] for g in got]) for j in range(11))
        source, base = np.repeat(np.arange(len(got)), [len(g[0]) for g in got]), np.cumsum([0] + [len(g[4]) for g in got])[:-1]
        mine, sig, ends = mine + base[source], sig.reshape(-1, SLOTS), np.cumsum(width)
        prints = None if first else _Prints(size, *([g[j] for g in got] for j in (11, 12)))
        order = np.lexsort((place[mine], key))
        edges = np.flatnonzero(np.diff(key[order])) + 1
        opened, pairs = [np.zeros(0, np.int64)], []
        for group in np.split(order, edges):
            m = mine[group]
            if len(m) < 2:
                continue
            links = [flat[ends[x] - width[x] : ends[x]] for x in m]
            comp = _local_components(place[m], np.repeat(np.arange(len(m)), width[m]), np.concatenate(links))
            names, number = np.unique(comp, return_counts=True)
            if len(names) == 1:
                continue
            code = np.full(len(m), OPEN)
            free = (comp != names[np.argmax(number)]) & (hubbed[group] == 0)
            if not first and free.sum() > WIDE:
                code[:] = SPLIT
            else:
                waits, now = np.zeros(len(m), dtype=bool), np.zeros(len(m), dtype=bool)
                for h in _hubs(sig[m], free, waits):
                    if now.sum() == FIRST_HUBS and first and len(m) > WIDE:
                        break
                    now[h] = True
                    like = (sig[m] == sig[m[h]]).sum(axis=1)
                    like[(comp == comp[h]) | (hubbed[group] != 0) | (code == HUB) | (100 * np.minimum(size[m], size[m[h]]) < percent * np.maximum(size[m], size[m[h]]))] = 0
                    asks = (like >= (LIKELY if first else LEAST)) & ~waits
                    code[h] = OPEN if first and ((like >= LEAST) & ~asks).any() else HUB  # a hub that left out members comes again
                    if first:
                        waits |= like >= LIKELY
                    elif asks.any():
                        some = np.flatnonzero(asks)
                        most = prints.most(m[h], m[some])
                        asks[some[100 * most < percent * (size[m[some]] + size[m[h]] - most)]] = False
                    if asks.any():
                        asks[h] = True  # the hub's own block gives its set
                        pairs.append(m[asks] * len(place) + m[h])
                if not (free & (code != HUB)).any():
                    continue  # every pair is compared or connected
            opened.append(group * 4 + code)
        rows_, both = np.sort(np.concatenate(opened)), np.unique(_cat(pairs))  # by source, as rows and members are
        x, member, hub = rows_ // 4, both // max(len(place), 1), both % max(len(place), 1)
        at, by = np.searchsorted(source[x], np.arange(len(got) + 1)), np.searchsorted(member, np.append(base, len(place)))
        for i, (block, _) in enumerate(messages):
            a, b = slice(at[i], at[i + 1]), slice(by[i], by[i + 1])
            if at[i] < at[i + 1] or by[i] < by[i + 1]:
                yield block, pack(entry[x[a]], rows_[a] % 4, who[member[b]], place[hub[b]], cid[hub[b]])

    def fold(block, data, replies):
        s = _State(data)
        told = [unpack(replies[k]) for k in sorted(replies)]
        entry, code, at, hub, hub_id = (_cat([t[j] for t in told]) for j in range(5))
        pairs = np.unique(np.stack([at, hub, hub_id], axis=1), axis=0) if len(at) else np.zeros((0, 3), np.int64)
        s.asked_at, s.asked_hub, s.asked_id = (np.ascontiguousarray(pairs[:, j]) for j in range(3))
        s.hubbed = s.hubbed.copy()
        s.hubbed[entry[code == HUB]] = 1
        split = entry[code == SPLIT]
        if len(split):
            sig, more = s.sig.reshape(-1, SLOTS), []
            for j in range(BANDS):
                e = split[s.used[split] >> np.uint32(j) & np.uint32(1) == 0]
                part = sig[s.owner[e], j * ROWS : j * ROWS + ROWS].astype(np.uint64)
                value = sum(part[:, i] << np.uint64(8 * i) for i in range(ROWS)) + np.uint64(j << 8 * ROWS)
                more.append((s.owner[e], mix(s.keys[e] * GOLDEN + mix(value + GOLDEN)), s.used[e] | np.uint32(1 << j)))
            keep = np.concatenate([np.sort(entry[code != SPLIT]), np.arange(len(s.keys), len(s.keys) + sum(len(x[0]) for x in more))])
            s.hubbed = np.concatenate([s.hubbed, np.zeros(sum(len(x[0]) for x in more), np.uint8)])
            s.owner, s.keys, s.used = (np.concatenate([old, *(x[i] for x in more)]) for i, old in enumerate((s.owner, s.keys, s.used)))
        else:
            keep = np.sort(entry)
        s.closed(keep)
        yield state_row(block, s.packed())

    return ask(state, n, send, answer, fold, STATE)


def _verified(state: DataFrame, n: int, percent: int) -> DataFrame:
    """Hubs' shingle sets go once to each block that asked; links are confirmed on full sets."""

    def where(hub):
        return mix(hub.astype(np.uint64) + GOLDEN)

    def send(block, data):
        s = _State(data)
        mine = s.place[s.asked_at] == s.asked_hub
        own, want = s.asked_at[mine], np.unique(s.asked_hub[~mine])
        messages = {}
        for h, k in zip(want.tolist(), owner_of(where(want), n).tolist(), strict=True):
            messages.setdefault(k, ([], []))[0].append(h)
        for i, k in zip(own.tolist(), owner_of(where(s.place[own]), n).tolist(), strict=True):
            messages.setdefault(k, ([], []))[1].append(i)
        for k, (asks, gives) in sorted(messages.items()):
            sets = [s.set_of(i) for i in gives]
            yield k, pack(np.array(asks, dtype=np.int64), s.place[np.array(gives, dtype=np.int64)], np.array([len(x) for x in sets], dtype=np.int64), pack_sorted(_cat(sets, np.uint64)))

    def answer(owner, messages):
        got, known = [unpack(m) for _, m in messages], {}
        for _, hubs, size, values in got:
            for h, part in zip(hubs.tolist(), np.split(unpack_sorted(values), np.cumsum(size)[:-1]), strict=False):
                known[h] = part
        for (block, _), (asks, *_) in zip(messages, got, strict=True):
            if len(asks):
                sets = [known[h] for h in asks.tolist()]
                yield block, pack(asks, np.array([len(x) for x in sets], dtype=np.int64), pack_sorted(np.concatenate(sets)))

    def fold(block, data, replies):
        s, known = _State(data), {}
        for i in s.asked_at[s.place[s.asked_at] == s.asked_hub].tolist():
            known[int(s.place[i])] = s.set_of(i)
        for reply in replies.values():
            asks, size, values = unpack(reply)
            for h, part in zip(asks.tolist(), np.split(unpack_sorted(values), np.cumsum(size)[:-1]), strict=True):
                known[h] = part
        found = []
        for i, h, hub_id in zip(s.asked_at.tolist(), s.asked_hub.tolist(), s.asked_id.tolist(), strict=True):
            if s.place[i] == h:
                continue
            a, b = s.set_of(i), known[h]
            if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
                continue
            at = np.searchsorted(a, b)
            common = int((a[np.minimum(at, len(a) - 1)] == b).sum())
            if 100 * common >= percent * (len(a) + len(b) - common):
                found.append((i, h, hub_id))
        pairs = np.unique(np.concatenate([np.stack([s.link_at, s.link_hub, s.link_id], axis=1), np.array(found, dtype=np.int64).reshape(-1, 3)]), axis=0)
        s.link_at, s.link_hub, s.link_id = (np.ascontiguousarray(pairs[:, j]) for j in range(3))
        s.asked_at = s.asked_hub = s.asked_id = np.zeros(0, np.int64)
        yield state_row(block, s.packed())

    return ask(state, n, send, answer, fold, STATE)


def _count(state: DataFrame) -> tuple[int, int]:
    """Comparisons that are asked for and buckets' members that are open, in all blocks."""
    kind = pa.schema([("asked", pa.int64()), ("open", pa.int64())])

    def counted(batches):
        for batch in batches:
            states = [_State(d.as_py()) for d in batch["data"]]
            yield pa.RecordBatch.from_pydict({"asked": [sum(len(s.asked_at) for s in states)], "open": [sum(len(s.keys) for s in states)]}, kind)

    return tuple(x or 0 for x in state.mapInArrow(counted, "asked long, open long").agg(F.sum("asked"), F.sum("open")).first())


_NODES = ("u_id", "u_at", "v_id", "v_at")


def _links(state: DataFrame) -> DataFrame:
    """(u, v): links between rows, each struct<id, at>."""

    def out(batches):
        for batch in batches:
            for d in batch["data"]:
                s = _State(d.as_py())
                found = np.concatenate([s.done.reshape(-1, 4), np.stack([s.cid[s.link_at], s.place[s.link_at], s.link_id, s.link_hub], axis=1)])
                yield pa.RecordBatch.from_pydict({k: found[:, j] for j, k in enumerate(_NODES)}, pa.schema([(k, pa.int64()) for k in _NODES]))

    return state.mapInArrow(out, ", ".join(f"{k} long" for k in _NODES)).select(F.struct(F.col("u_id").alias("id"), F.col("u_at").alias("at")).alias("u"), F.struct(F.col("v_id").alias("id"), F.col("v_at").alias("at")).alias("v"))


def components(links: DataFrame) -> DataFrame:
    """(u, v): v is the smallest node of u's component, for all nodes but the smallest ones (large star, small star)."""
    edges, before = tabled(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()), None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.where("m < u").select("u", F.col("m").alias("v"))).distinct()
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        step = large.join(small, "u")
        old, edges = edges, tabled(step.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(step.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        forget(old)
        now = edges.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long"))).first()
        if now == before:
            return edges
        before = now


def _labelled(state: DataFrame, labels: DataFrame, n: int) -> DataFrame:
    """The result rows: each block asks for its representatives' labels, once for each."""

    def label_blocks(batches):
        first = (1 << 62) + (TaskContext.get().partitionId() << 32)
        for k, b in enumerate(batches):
            yield state_row(first + k, pack(np.asarray(b["at"], dtype=np.int64), np.asarray(b["id"], dtype=np.int64)))

    def keyed(at):
        key = mix(at.astype(np.uint64) + GOLDEN)
        order = np.argsort(key)
        return order, _parts(key[order], n)

    def send(block, data):
        nodes, told = unpack(data)[:2] if block >= 1 << 62 else (np.unique(_State(data).rep), np.zeros(0, np.int64))
        order, parts = keyed(nodes)
        for k, part in parts:
            yield k, pack(nodes[order[part]], told[order[part]] if len(told) else told)

    def answer(owner, messages):
        got = [unpack(m) for _, m in messages]
        at, label = (_cat([g[j] for g in got if len(g[1])]) for j in (0, 1))
        order = np.argsort(at)
        at, label = at[order], label[order]
        for (block, _), (nodes, _) in zip(messages, got, strict=True):
            if block < 1 << 62:
                where = np.minimum(np.searchsorted(at, nodes), max(len(at) - 1, 0))
                known = at[where] == nodes if len(at) else np.zeros(len(nodes), bool)
                yield block, pack(nodes[known], label[where[known]] if len(at) else nodes[known])

    def fold(block, data, replies):
        if block >= 1 << 62:
            return
        s = _State(data)
        told = [unpack(r) for r in replies.values()]
        at, label = (_cat([t[j] for t in told]) for j in (0, 1))
        order = np.argsort(at)
        at, label = at[order], label[order]
        comp = s.rep_id.copy()
        if len(at):
            where = np.minimum(np.searchsorted(at, s.rep), len(at) - 1)
            comp = np.where(at[where] == s.rep, label[where], comp)
        named = lambda x: pa.array(x, pa.int64(), mask=x == _LAST)
        yield rows(RESULT, doc_id=named(s.ids), n_shingles=s.size, component_id=named(comp), kept=s.ids == comp)

    told = labels.select("u.at", "v.id").mapInArrow(label_blocks, STATE)
    return ask(state.unionByName(told), n, send, answer, fold, RESULT)


def groups(docs: DataFrame, percent: int = 75, n_owners: int | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row."""
    n = n_owners or owners(docs)
    state, first = _classes(docs, n), True
    while True:
        old, state = state, checkpointed(_requests(state, n, percent, first))
        forget(old)
        asked, left = _count(state)
        if asked:
            old, state = state, checkpointed(_verified(state, n, percent))
            forget(old)
        if not left:
            break
        first = False
    return _labelled(state, components(_links(state)), n)


def stage(docs: DataFrame, percent: int = 75) -> DataFrame:
    """One document of each group: the row with the smallest doc_id of its component (null last), with rows told apart by a key where doc_ids are repeated or null."""
    row, gone = fresh(docs, "row"), fresh(docs, "gone")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    if docs.groupBy("doc_id").count().where("count > 1 or doc_id is null").limit(1).count():
        keyed = checkpointed(docs.withColumn(row, F.monotonically_increasing_id()))
        found = groups(keyed.select(F.col(row).alias("doc_id"), "text"), percent).select(F.col("doc_id").alias("at"), "component_id")
        first = found.join(keyed.select(F.col(row).alias("at"), "doc_id"), "at").groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "at")).alias("m"))
        return keyed.join(first.select(F.col("m.at").alias(row)), row, "left_semi").select(*columns)
    found = groups(docs, percent).where(~F.col("kept")).select(F.col("doc_id").alias(gone)).distinct()
    return docs.join(found, docs["doc_id"] == found[gone], "left_anti")
