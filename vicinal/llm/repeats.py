"""Removal of repeated byte strings by merging Burrows-Wheeler transforms of shards.

Any `length` bytes that two documents share have the same least hash of a 16-byte string inside. So the
windows of that length are dealt by that hash: a run of neighbouring windows with one least hash becomes a
string, and windows that are equal anywhere in the corpus meet in one bucket. A first pass finds the
hashes that more than one document has; only their strings move.

In a bucket the distinct strings form shards of bounded size. Each shard's transform is built alone. The
transforms are then merged as by Holt and McMillan (2014): an interleave of the shards' suffixes, in order
of their first h symbols, is refined to h + 2 by dealing its suffixes, in their present order, to the
symbols that the transforms hold before them. Suffixes are never compared or sorted again, and of each
string only the suffixes take part that a window needs. The refinements also tell which neighbours have a
common prefix of `length` symbols; runs of them are the repeated intervals. An interval's least document id
decides which windows go.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vicinal.plans.shared import discard, materialize

#: Bytes of a repeat; of the strings whose hashes are compared.
LENGTH, GRAM = 50, 16
#: Bytes of text to a bucket and to a group of documents, on average; positions of a shard
#: (few, so that its arrays fit a core's cache) and of shards merged at once, unless one hash alone has more.
BUCKET_BYTES, GROUP_BYTES, SHARD, MERGED = 4 << 20, 32 << 20, 1 << 16, 1 << 18
#: A key that more documents ask for than the greater of these numbers, the second a share of all bytes, has its
#: strings dealt by a second hash too. So few keys are that they can be broadcast (6 bytes each, 20 MB at most).
HOT, HOT_SHARE = 50_000, 50_000_000
#: Bytes of a group's texts whose strings are sorted out at a time; windows of occurrences judged at a time; bytes of
#: text to a partition at most, on average.
TOGETHER, JUDGED, PART_BYTES = 8 << 20, 1 << 19, 64 << 20
#: Bytes whose hashes are made at a time; the arrays should fit a core's cache.
_CHUNK = 1 << 18
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_LAST = (1 << 63) - 1


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes that start at each place (the last GRAM - 1 places have none)."""
    w = data.astype(np.uint64)
    for k in (1, 2, 4):
        w = w[:-k] | (w[k:] << np.uint64(8 * k))
    h = (w[:-8] ^ (w[:-8] >> np.uint64(29))) * _M1 + w[8:]
    h = (h ^ (h >> np.uint64(32))) * _M2
    return h ^ (h >> np.uint64(31))


def sliding_least(h: np.ndarray, n: int) -> np.ndarray:
    """The least of each n neighbours."""
    size = 1
    while size * 2 <= n:
        h = np.minimum(h[:-size], h[size:])
        size *= 2
    return np.minimum(h[: len(h) - (n - size)], h[n - size :]) if size < n else h


def runs(texts: list[bytes], length: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(document, first window, windows, key) of the runs of windows with one key, for some texts at a time.
    A run has as many windows as a window has grams at most."""
    at, most = 0, length - GRAM + 1
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (size < _CHUNK or end == at):
            size += len(texts[end])
            end += 1
        data = np.frombuffer(b"".join(texts[at:end]), np.uint8)
        if len(data) >= length:
            key = sliding_least(gram_hashes(data), most)
            sizes = np.array([len(t) for t in texts[at:end]])
            starts = np.cumsum(sizes) - sizes
            doc = np.repeat(np.arange(at, end), sizes)
            whole = doc[: len(key)] == doc[length - 1 : length - 1 + len(key)]
            fresh = np.r_[True, (key[1:] != key[:-1]) | (doc[1 : len(key)] != doc[: len(key) - 1]) | (whole[1:] & ~whole[:-1])]
            first = np.maximum.accumulate(np.where(fresh, np.arange(len(key)), 0))
            fresh |= (np.arange(len(key)) - first) % most == 0
            fresh &= whole
            begin = np.flatnonzero(fresh)
            # a run ends before the next one, or before the first window that is not whole
            edge = np.flatnonzero(fresh | ~whole)
            stop = np.r_[edge, len(key)][np.searchsorted(edge, begin, "right")]
            d = doc[begin]
            yield d, begin - starts[d - at], stop - begin, key[begin]
        at = end


def _pack(a: np.ndarray, kind: str) -> bytes:
    raw = np.ascontiguousarray(a, kind).tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def _unpack(blob: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), "zstd", asbytes=True), kind)


#: What moves between steps: to a bucket or a group, a kind, and arrays packed as bytes.
_MOVED = pa.schema([("to", pa.int64()), ("kind", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary()), ("d", pa.binary())])
_SQL = "`to` long, kind int, a binary, b binary, c binary, d binary"


def _moved(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _MOVED, strict=True)], schema=_MOVED)


def _uid(ids: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """A number for a document. Where two have the same, answers for one are only looked at for the other."""
    return (ids.view(np.uint64) * _M1 ^ marks.view(np.uint64)) * _M2


def _group_of(uid: np.ndarray, groups: int) -> np.ndarray:
    return (uid >> np.uint64(33)).astype(np.int64) % groups


def _bucket_of(key: np.ndarray, buckets: int) -> np.ndarray:
    return (key >> np.uint64(20)).astype(np.int64) % buckets


def _short(key: np.ndarray) -> np.ndarray:
    """Within a bucket 48 bits of a key tell keys apart; others only cost a look."""
    return key & np.uint64((1 << 48) - 1)


def _pack_keys(key: np.ndarray) -> bytes:
    return np.ascontiguousarray(key, "<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _unpack_keys(blob: bytes) -> np.ndarray:
    out = np.zeros((len(blob) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(blob, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def _pack_runs(values: np.ndarray) -> tuple[bytes, bytes]:
    """An array of equal neighbours as values and counts."""
    edge = np.flatnonzero(np.r_[True, values[1:] != values[:-1]])
    return _pack(values[edge], "<u8"), _pack(np.diff(np.r_[edge, len(values)]), "<u4")


def _unpack_runs(values: bytes, counts: bytes) -> np.ndarray:
    return np.repeat(_unpack(values, "<u8"), _unpack(counts, "<u4"))


def _by(to: np.ndarray, *arrays: np.ndarray) -> Iterator[tuple]:
    """Arrays cut by target."""
    if not len(to):
        return
    order = np.argsort(to, kind="stable")
    to = to[order]
    edges = np.flatnonzero(np.r_[True, to[1:] != to[:-1]]).tolist()
    arrays = [a[order] for a in arrays]
    for s, e in zip(edges, [*edges[1:], len(to)], strict=True):
        yield int(to[s]), *(a[s:e] for a in arrays)


# ---- step 1: which keys more than one document has


def _ask(length: int, buckets: int, groups: int):
    """Documents -> for each bucket the keys to look up; and, for documents whose key another one of the same
    batch has too, the answer at once, so that a very common key is looked up once for a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uid = _uid(batch.column("id").to_numpy(), batch.column("mark").to_numpy())
            found = [(d, k) for d, _, _, k in runs(batch.column("text").cast(pa.binary()).to_pylist(), length) if len(d)]
            if not found:
                continue
            doc, key = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.argsort(key, kind="stable")  # documents ascend within a key
            doc, key = doc[order], key[order]
            new = np.r_[True, (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])]
            doc, key = doc[new], key[new]
            first = np.r_[True, key[1:] != key[:-1]]
            alone = first & np.r_[first[1:], True]
            times = np.zeros(len(key), np.int64)
            times[first] = np.diff(np.r_[np.flatnonzero(first), len(key)])
            rows = []
            by_doc = np.flatnonzero(first)[np.argsort(doc[first], kind="stable")]
            for to, k, d, n in _by(_bucket_of(key[by_doc], buckets), key[by_doc], doc[by_doc], times[by_doc]):
                rows.append((to, 0, _pack_keys(k), *_pack_runs(uid[d]), _pack(n, "<u4")))
            known = np.flatnonzero(~alone)
            known = known[np.argsort(doc[known], kind="stable")]
            for to, k, d in _by(_group_of(uid[doc[known]], groups), key[known], doc[known]):
                rows.append((-1 - to, 1, _pack_keys(k), *_pack_runs(uid[d]), None))
            yield _moved(rows)

    return run


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
    """Rows sorted by target, one target at a time."""
    at, held = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[0] != at and held:
                yield at, held
                held = []
            at = row[0]
            held.append(row)
    if held:
        yield at, held


def _answer(groups: int, hot: int):
    """Keys of a bucket -> for each group of documents the (document, key) whose key others have; and, as rows of
    kind 2, the keys that more than `hot` documents have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for to, rows in _grouped(batches):
            if to < 0:
                yield _moved([(-1 - to, 1, *r[2:]) for r in rows])
                continue
            parts = [_unpack_keys(r[2]) for r in rows]
            key, uid = np.concatenate(parts), np.concatenate([_unpack_runs(r[3], r[4]) for r in rows])
            times = np.concatenate([_unpack(r[5], "<u4") for r in rows])
            order = np.argsort(key, kind="stable")
            key, uid, times = key[order], uid[order], times[order]
            same = key[1:] == key[:-1]
            asks = times == 1
            if len(key):
                first = np.flatnonzero(np.r_[True, ~same])
                many = key[first][np.add.reduceat(times.astype(np.int64), first) > hot]
                if len(many):
                    yield _moved([(0, 2, _pack_keys(many), None, None, None)])
            yes = (np.r_[False, same] | np.r_[same, False]) & asks
            key, uid = key[yes], uid[yes]
            order = np.argsort(uid, kind="stable")
            key, uid = key[order], uid[order]
            yield _moved([(g, 1, _pack_keys(k), *_pack_runs(u), None) for g, k, u in _by(_group_of(uid, groups), key, uid)])

    return run


# ---- documents, dealt by group


def _deal(groups: int):
    """(id, mark, text) -> for each group the documents of a batch: texts, their sizes, ids and marks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, marks = batch.column("id").to_numpy(), batch.column("mark").to_numpy()
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            rows = []
            for to, j in _by(_group_of(_uid(ids, marks), groups), np.arange(len(ids))):
                for at in range(0, len(j), 2000):
                    some = j[at : at + 2000]
                    mine = [texts[i] for i in some.tolist()]
                    raw = b"".join(mine)
                    packed = len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)
                    rows.append((to, 0, packed, _pack(np.array([len(t) for t in mine]), "<i8"), _pack(ids[some], "<i8"), _pack(marks[some], "<i8")))
            yield _moved(rows)

    return run


def _dealt(row: tuple) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    raw, sizes = _unpack(row[2], "u1").tobytes(), _unpack(row[3], "<i8")
    ends = np.cumsum(sizes)
    return [raw[a:b] for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True)], _unpack(row[4], "<i8"), _unpack(row[5], "<i8")


def _by_group(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[tuple], tuple]]:
    """For each row of documents: what was said of its group before (rows of kind 1), and the row."""
    group, held = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[0] != group:
                group, held = row[0], []
            if row[1] == 1:
                held.append(row)
            else:
                yield held, row


# ---- step 2: the strings of those keys


def _strings(length: int, buckets: int, groups: int, hot):
    """A group's answers, then its documents -> strings for the buckets. hot: broadcast keys, in order. Of equal strings in a batch only
    those of the least document go there; the others are repeats as a whole, and that is known here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, wanted, parts, size = None, np.zeros(0, np.uint64), [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            if parts and len(wanted):
                ids, marks = (np.concatenate([p[i] for p in parts]) for i in (1, 2))
                yield from _emit([t for p in parts for t in p[0]], ids, marks, wanted, length, buckets, groups, hot.value)

        for held, row in _by_group(batches):
            if held is not last or size > TOGETHER:
                yield from flush()
                parts, size = [], 0
            if held is not last:
                last = held
                wanted = np.sort(np.concatenate([_asked(_unpack_runs(r[3], r[4]), _unpack_keys(r[2])) for r in held])) if held else np.zeros(0, np.uint64)
            parts.append(_dealt(row))
            size += sum(map(len, parts[-1][0]))
        yield from flush()

    return run


def _asked(uid: np.ndarray, key: np.ndarray) -> np.ndarray:
    """(document, key) as one number; a chance hit only adds a string."""
    return (uid ^ key * _M1) * _M2


def _emit(texts: list[bytes], ids: np.ndarray, marks: np.ndarray, wanted: np.ndarray, length: int, buckets: int, groups: int, hot: np.ndarray) -> Iterator[pa.RecordBatch]:
    uid = _uid(ids, marks)
    found = []
    for d, a, w, k in runs(texts, length):
        q = _asked(uid[d], _short(k))
        ok = wanted[np.minimum(np.searchsorted(wanted, q), len(wanted) - 1)] == q
        d, a, w, k = d[ok], a[ok], w[ok], k[ok]
        if len(hot) and len(k):
            many = hot[np.minimum(np.searchsorted(hot, _short(k)), len(hot) - 1)] == _short(k)
            if many.any():
                d, a, w, k = (np.concatenate(x) for x in zip((d[~many], a[~many], w[~many], k[~many]), _dealt_again(texts, d[many], a[many], w[many], k[many], length), strict=True))
                order = np.lexsort((a, d))
                d, a, w, k = d[order], a[order], w[order], k[order]
        found.append((d, a, w, k))
    if not found:
        return
    doc, at, n, key = (np.concatenate(x) for x in zip(*found, strict=True))
    if not len(doc):
        return
    index: dict[bytes, int] = {}
    which = np.array([index.setdefault(texts[d][a:e], len(index)) for d, a, e in zip(doc.tolist(), at.tolist(), (at + n + length - 1).tolist(), strict=True)])
    owner = ids[doc]
    least = np.full(len(index), _LAST)
    np.minimum.at(least, which, owner)
    later = owner > least[which]
    gone, start, end = _joined(doc[later], at[later], (at + n + length - 1)[later])
    out = _span_rows(ids[gone], marks[gone], start, end - start, groups, sign=-1)
    unique = list(index)
    go = np.flatnonzero(~later)
    for to, j in _by(_bucket_of(key[go], buckets), go):
        s, once, local = np.unique(which[j], return_index=True, return_inverse=True)
        mine = [unique[x] for x in s.tolist()]
        docs, of = np.unique(doc[j], return_inverse=True)
        heads = _pack(np.array([len(x) for x in mine]), "<u2") if max(map(len, mine)) < 1 << 16 else None
        assert heads is not None  # a string has `length` plus the windows of a run at most
        uses = np.concatenate([local, of, at[j]])
        out.append((to, 0, _pack(np.frombuffer(b"".join(mine), np.uint8), "u1"), heads + _pack_keys(_short(key[j[once]])), _pack(uses, "<u4"), _pack(np.concatenate([ids[docs], marks[docs]]), "<i8")))
    for s in range(0, len(out), 256):
        yield _moved(out[s : s + 256])


def _dealt_again(texts: list[bytes], doc: np.ndarray, at: np.ndarray, n: np.ndarray, key: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Runs of windows of one key as runs of one key and one least hash among the grams of other hashes. Equal
    windows have both in common."""
    sizes = n + length - 1
    data = np.frombuffer(b"".join([texts[d][a:e] for d, a, e in zip(doc.tolist(), at.tolist(), (at + sizes).tolist(), strict=True)]), np.uint8)
    run, start = np.repeat(np.arange(len(doc)), sizes), np.cumsum(sizes) - sizes
    h = gram_hashes(data)
    h[h == key[run[: len(h)]]] = np.uint64((1 << 64) - 1)
    second = sliding_least(h, length - GRAM + 1)
    place = np.flatnonzero(np.arange(len(second)) - start[run[: len(second)]] < n[run[: len(second)]])
    both = (key[run[place]] ^ second[place] * _M1) * _M2
    begin = np.flatnonzero(np.r_[True, (both[1:] != both[:-1]) | (run[place][1:] != run[place][:-1])])
    r = run[place[begin]]
    return doc[r], at[r] + place[begin] - start[r], np.diff(np.r_[begin, len(place)]), both[begin]


def _joined(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of documents in order, those that touch as one: a copied document is one span, not one a string."""
    if not len(doc):
        return doc, start, end
    new = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (start[1:] > end[:-1])])
    return doc[new], start[new], end[np.r_[new[1:] - 1, len(doc) - 1]]


def _span_rows(ids: np.ndarray, marks: np.ndarray, at: np.ndarray, size: np.ndarray, groups: int, sign: int = 1) -> list[tuple]:
    """Spans for the groups of their documents; a negative target is passed on by the bucket that gets it."""
    to = _group_of(_uid(ids, marks), groups)
    return [
        (g if sign > 0 else -1 - g, 1, _pack(i, "<i8"), _pack(m, "<i8"), _pack(a, "<i8"), _pack(w, "<i4")) for g, i, m, a, w in _by(to, ids, marks, at, size)
    ]


# ---- step 3: shards' transforms and their merge


class ShardBwt:
    """Burrows-Wheeler transform of some strings, each followed by a separator."""

    def __init__(self, strings: list[bytes]) -> None:
        sizes = np.array([len(s) + 1 for s in strings])
        n = int(sizes.sum())
        text = np.zeros(n, np.int64)  # 0 separates; bytes count from 1
        inside = np.ones(n, bool)
        ends = np.cumsum(sizes)
        inside[ends - 1] = False
        text[inside] = np.frombuffer(b"".join(strings), np.uint8).astype(np.int64) + 1
        self.string = np.repeat(np.arange(len(strings)), sizes)
        self.offset = np.arange(n) - np.repeat(ends - sizes, sizes)
        self.suffixes = self._sort(text, np.repeat(sizes, sizes) - self.offset)
        #: the byte before each suffix, in the order of suffixes
        self.bwt = text[self.suffixes - 1].astype(np.uint16)

    @staticmethod
    def _sort(text: np.ndarray, left: np.ndarray) -> np.ndarray:
        """Suffixes in order of what is left of their strings, equal ones by string, by doubling; a place's number
        is part of the key, so plain sorts do. In this order the transform's mapping is exact. left: symbols up
        to the separator, itself included."""
        n, place = len(text), np.arange(len(text))
        bits = max(1, int(n).bit_length())
        if 3 * bits > 63 or 36 + bits > 63:
            raise ValueError("shard too large")
        key = text << 27
        for k in range(1, 4):
            key[:-k] |= np.where(left[:-k] > k, text[k:] << (9 * (3 - k)), 0)
        h, longest = 4, int(left.max())
        while True:
            both = np.sort((key << bits) | place)
            order, pair = both & ((1 << bits) - 1), both >> bits
            if h >= longest:
                return order
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(np.r_[0, pair[1:] != pair[:-1]])
            if rank[order[-1]] == n - 1:
                return order
            key = rank << bits
            key[:-h] |= np.where(left[:-h] > h, rank[h:] + 1, 0)
            h *= 2


def next_in_order(bwt: np.ndarray) -> np.ndarray:
    """For each suffix in order the one a symbol shorter: the k-th occurrence of a symbol at the front of
    suffixes is its k-th in the transform."""
    return np.argsort(bwt, kind="stable").astype(np.int32)


def merge(transforms: list[np.ndarray], length: int, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merges transforms: (interleave, common), of the windows of `length` symbols that end before `ends`.

    ends: suffixes, numbered shard by shard in each shard's order, in ascending order. interleave: the
    suffixes `length` symbols longer, in merged order of these symbols; common: whether a window's prefix
    in common with the one before it in the interleave is `length`, so it belongs to the same interval.

    The interleave starts as it is numbered. Of suffixes in order of h symbols, those that are one symbol
    longer are in order of h + 1 when they are dealt by that symbol and keep their order within it; the
    transform has the symbol, and its mapping names the longer suffix. Two symbols are dealt at a time,
    by a counting sort of their numbers among those that occur. Neighbours have h + 2 symbols in common if
    they were dealt to one place, from places with h in common.
    """
    longer, shift = [], 0
    for bwt in transforms:
        shorter = next_in_order(bwt)
        own = np.empty(len(bwt), np.int32)
        own[shorter] = np.arange(len(bwt), dtype=np.int32)
        longer.append(own + np.int32(shift))
        shift += len(bwt)
    lf, symbol = np.concatenate(longer), np.concatenate(transforms)
    seen, number = np.unique(symbol, return_inverse=True)
    number = number.astype(np.uint16)
    lf2, pair = lf[lf], number[lf] * np.uint16(len(seen)) + number  # at most 257 symbols occur
    if len(seen) * len(seen) > 1 << 16:
        lf2, pair = lf, number
    wide = 2 if pair is not number else 1
    order, n, h = ends.astype(np.int32), len(ends), 0
    block, parted = np.zeros(n, np.int32), np.ones(n, bool)
    while h < length:
        if h + wide > length:
            lf2, pair, wide = lf, number, 1
        first = pair.take(order)
        dealt = np.argsort(first, kind="stable")  # of 16 bits: a counting sort
        first, before = first.take(dealt), block.take(dealt)
        order = lf2.take(order.take(dealt))
        np.not_equal(before[1:], before[:-1], out=parted[1:])
        parted[1:] |= first[1:] != first[:-1]
        h += wide
        block = np.cumsum(parted, dtype=np.int32)
    return order, ~parted


def least_owners(strings: list[bytes], owner: np.ndarray, length: int) -> np.ndarray:
    """For each window of each string, one after the other, the least owner of any string that holds it."""
    shards, cut, size = [], [0], 0
    for i, s in enumerate(strings):
        if size + len(s) + 1 > SHARD:
            cut.append(i)
            size = 0
        size += len(s) + 1
    cut.append(len(strings))
    shards = [ShardBwt(strings[a:b]) for a, b in zip(cut, cut[1:], strict=False) if b > a]
    sizes = np.array([len(s) for s in strings])
    string = np.concatenate([(s.string + a)[s.suffixes] for s, a in zip(shards, cut, strict=False)])
    offset = np.concatenate([s.offset[s.suffixes] for s in shards])
    order, common = merge([s.bwt for s in shards], length, np.flatnonzero(offset >= length))
    string, offset = string[order], offset[order]
    first = np.flatnonzero(~common)
    least = np.minimum.reduceat(owner[string], first) if len(first) else np.zeros(0, np.int64)
    base = np.cumsum(sizes - length + 1) - (sizes - length + 1)
    out = np.empty(int((sizes - length + 1).sum()), np.int64)
    out[base[string] + offset] = np.repeat(least, np.diff(np.r_[first, len(order)]))
    return out


def _intervals(length: int, groups: int):
    """Strings of a bucket -> spans to remove, for the groups of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for to, rows in _grouped(batches):
            if to < 0:
                yield _moved([(-1 - to, 1, *r[2:]) for r in rows])
                continue
            index: dict[bytes, int] = {}
            keys, uses = [], []
            for r in rows:
                text, use, docs = _unpack(r[2], "u1").tobytes(), _unpack(r[4], "<u4").astype(np.int64).reshape(3, -1), _unpack(r[5], "<i8").reshape(2, -1)
                sizes, key = _unpack_heads(r[3])
                ends = np.cumsum(sizes)
                mine = np.array([index.setdefault(text[a:b], len(index)) for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True)])
                fresh = np.zeros(len(index) - sum(map(len, keys)), np.uint64)
                new = mine >= len(index) - len(fresh)
                fresh[mine[new] - (len(index) - len(fresh))] = key[new]
                keys.append(fresh)
                uses.append(np.stack([mine[use[0]], *docs[:, use[1]], use[2]]))
            yield from _spans(list(index), np.concatenate(keys), np.concatenate(uses, axis=1), length, groups)

    return run


def _unpack_heads(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Sizes and keys of strings: 6 bytes a key, at the end."""
    n = int.from_bytes(blob[:8], "little") // 2
    return _unpack(blob[: len(blob) - 6 * n], "<u2").astype(np.int64), _unpack_keys(blob[len(blob) - 6 * n :])


def _spans(strings: list[bytes], keys: np.ndarray, uses: np.ndarray, length: int, groups: int) -> Iterator[pa.RecordBatch]:
    """uses: string, id, mark and place of each occurrence. Of every occurrence the windows go whose interval has
    an earlier document; a string's rows in the transform have the least of its documents."""
    which, ids, marks, at = uses
    least = np.full(len(strings), _LAST)
    np.minimum.at(least, which, ids)
    sizes = np.array([len(s) for s in strings])
    windows = sizes - length + 1
    # strings of one key belong together; keys are taken until there is enough to merge at once
    order = np.argsort(keys, kind="stable")
    total = np.cumsum(sizes[order] + 1)
    edge = np.flatnonzero(np.r_[True, np.diff(keys[order]) != 0])
    cut, done = [], 0
    for e in edge.tolist():
        if not cut or total[e - 1] - done > MERGED:
            cut.append(e)
            done = total[e - 1] if e else 0
    cut.append(len(order))
    parts = []
    for a, b in zip(cut, cut[1:], strict=False):
        mine = order[a:b]
        parts.append(least_owners([strings[i] for i in mine.tolist()], least[mine], length))
    first = np.concatenate(parts)
    base = np.empty(len(strings), np.int64)
    base[order] = np.cumsum(windows[order]) - windows[order]
    # the windows of some occurrences at a time, and the runs of those that go
    n = windows[which]
    cuts = np.searchsorted(np.cumsum(n), np.arange(JUDGED, int(n.sum()) + JUDGED, JUDGED))
    for s, e in zip([0, *(cuts + 1).tolist()], [*(cuts + 1).tolist(), len(which)], strict=True):
        use = np.arange(s, min(e, len(which)))
        if not len(use):
            continue
        of = np.repeat(np.arange(len(use)), n[use])
        k = np.arange(len(of)) - np.repeat(np.cumsum(n[use]) - n[use], n[use])
        gone = first[base[which[use]][of] + k] < ids[use][of]
        edge = np.r_[True, of[1:] != of[:-1]]
        begin = np.flatnonzero(gone & (edge | np.r_[True, ~gone[:-1]]))
        end = np.flatnonzero(gone & np.r_[edge[1:] | ~gone[1:], True])
        mine = use[of[begin]]
        out = _span_rows(ids[mine], marks[mine], at[mine] + k[begin], end - begin + length, groups)
        for x in range(0, len(out), 256):
            yield _moved(out[x : x + 256])


# ---- step 4: what is left of the documents


def union_of(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Disjoint, non-touching spans that cover the same places."""
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.r_[True, start[1:] > end[:-1]]
    return start[new], end[np.r_[np.flatnonzero(new)[1:] - 1, len(end) - 1]]


def _kept(write: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if write else [])]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        last, spans = None, {}
        for held, row in _by_group(batches):
            if held is not last:
                last, spans = held, _by_document([[_unpack(x, t) for x, t in zip(r[2:], ("<i8", "<i8", "<i8", "<i4"), strict=True)] for r in held])
            texts, ids, marks = _dealt(row)
            out = []
            for data, key, mark in zip(texts, ids.tolist(), marks.tolist(), strict=True):
                gone = n = 0
                left = data
                if (found := spans.get((key, mark))) is not None:
                    start, end = union_of(*found)
                    gone, n = int((end - start).sum()), len(start)
                    left = b"".join(data[s:e] for s, e in zip([0, *end.tolist()], [*start.tolist(), len(data)], strict=True))
                out.append((None if key == _LAST and mark & 1 else key, len(data), gone, n, hashlib.sha256(left).hexdigest(), left))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t, _ in zip(zip(*out, strict=True), types, names, strict=False)], names=names)

    return run


def _by_document(held: list) -> dict:
    if not held:
        return {}
    ids, marks, at, size = (np.concatenate(x) for x in zip(*held, strict=True))
    order = np.lexsort((marks, ids))
    ids, marks, at, size = ids[order], marks[order], at[order], size[order]
    edges = np.flatnonzero(np.r_[True, (ids[1:] != ids[:-1]) | (marks[1:] != marks[:-1])])
    return {(int(ids[s]), int(marks[s])): (at[s:e], at[s:e] + size[s:e]) for s, e in zip(edges, [*edges[1:], len(ids)], strict=True)}


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, write: bool = True) -> DataFrame:
    """One row per row of docs: id_col, n_bytes, n_removed, n_spans, kept_sha256 and, with write, the bytes kept.

    A byte goes if `length` bytes that cover it also start in a document of smaller id; n_spans counts
    maximal runs that go. Ids are integers. Null texts are empty. Rows of one id are not smaller than each other; null ids
    are larger than all others (and as large as 2^63 - 1). Texts shorter than `length` stay whole. An empty table gives no rows.
    """
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST))
    text = F.coalesce(F.col(text_col), F.lit(""))
    # the mark tells rows of one id apart; its last bit, which rows have no id
    mark = F.xxhash64(text).bitwiseAND(F.lit(-2)).bitwiseOR(F.col(id_col).isNull().cast("long"))
    found = docs.select(key.alias("id"), mark.alias("mark"), text.alias("text"))
    total = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    buckets, groups = max(8, total // BUCKET_BYTES), max(8, total // GROUP_BYTES)
    conf = docs.sparkSession.conf
    parts = int(conf.get("spark.sql.shuffle.partitions"))
    to = [max(parts, total // PART_BYTES), "to"] if total // PART_BYTES > parts else ["to"]
    asked = found.mapInArrow(_ask(length, buckets, groups), _SQL)
    answers = materialize(asked.repartition(*to).sortWithinPartitions("to").mapInArrow(_answer(groups, max(HOT, total // HOT_SHARE)), _SQL), "repeated-keys")
    hot = np.sort(np.concatenate([np.zeros(0, np.uint64), *(_unpack_keys(r["a"]) for r in answers.where("kind = 2").select("a").collect())]))
    dealt = found.mapInArrow(_deal(groups), _SQL)
    together = lambda said: dealt.unionByName(said).repartition(*to).sortWithinPartitions("to", F.desc("kind"))
    shared = docs.sparkSession.sparkContext.broadcast(hot)
    strings = together(answers.where("kind = 1")).mapInArrow(_strings(length, buckets, groups, shared), _SQL)
    spans = materialize(strings.repartition(*to).sortWithinPartitions("to").mapInArrow(_intervals(length, groups), _SQL), "spans")
    discard(docs.sparkSession, answers)
    both = together(spans)
    schema = "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if write else "")
    return both.mapInArrow(_kept(write), schema).withColumn("id", F.col("id").cast(docs.schema[id_col].dataType)).withColumnRenamed("id", id_col)


def op10_repeats(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), write=False)


#: Every window of every text, with the least document that holds it; a byte goes if one of the 50 windows that
#: end at it or later, and start at it or earlier, goes.
OP10_SQL = f"""WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
    b AS (SELECT doc_id, k, substr(h, 2 * k + 1, 2) AS byte, CASE WHEN 2 * k + {2 * LENGTH} <= length(h) THEN md5(substr(h, 2 * k + 1, {2 * LENGTH})) END AS w
      FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2)) AS k FROM d)),
    f AS (SELECT w, min(doc_id) AS least FROM b WHERE w IS NOT NULL GROUP BY w),
    g AS (SELECT b.doc_id, b.k, b.byte, max(CASE WHEN f.least < b.doc_id THEN b.k END) OVER (PARTITION BY b.doc_id ORDER BY b.k ROWS UNBOUNDED PRECEDING) AS last FROM b LEFT JOIN f USING (w)),
    r AS (SELECT doc_id, k, byte, coalesce(k - last < {LENGTH}, false) AS gone FROM g),
    e AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY k), false) AS begins FROM r),
    o AS (SELECT doc_id, count(*) AS n_bytes, count(*) FILTER (gone) AS n_removed, count(*) FILTER (begins) AS n_spans, coalesce(string_agg(byte, '' ORDER BY k) FILTER (NOT gone), '') AS kept FROM e GROUP BY doc_id)
    SELECT doc_id, coalesce(n_bytes, 0) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256 FROM d LEFT JOIN o USING (doc_id)"""
