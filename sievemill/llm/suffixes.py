"""Exact removal of repeated byte strings by merging shards' Burrows-Wheeler transforms.

A byte goes if a string of ``WINDOW`` bytes that covers it also starts in a document with a smaller doc_id. Four steps
keep every group bounded and every shuffle small. A group is what one task reads in a row, up to a number of bytes; it is
compressed and written once, and what buckets say about it comes back to it by its number.

1. Anchors. A window's anchor is the smallest hash of the 32-byte strings in it, so equal windows have equal anchors.
   Each group sends its distinct anchors (four bytes each, by bucket of the hash); a bucket, which holds about those of
   two groups, answers each group with those that another document has too. Windows of unshared anchors are unique,
   which settles most of a corpus. A message holds all that a group has for a bucket, so there are never more messages
   than anchors, and far fewer until the corpus has as many groups as a group has anchors.
2. Snippets. The other windows are cut into runs with a common 12-byte minimum and sent, each distinct run of a group
   once with the smallest doc_id that has it, to the bucket of that minimum; equal windows meet there.
3. Merge. A bucket's snippets are taken a slice of the minima at a time, which bounds memory; a slice's snippets are
   dealt to shards, each with its own Burrows-Wheeler transform. The transforms are merged by refining their interleave: a stable pass over the merged transform's characters turns the order by k
   characters into that by k + 1, a boundary appears where characters or old blocks differ (that is the common prefix
   length), and no suffix is sorted again. The blocks left after ``WINDOW`` passes are the repeated windows; each has its
   smallest doc_id. A group is answered with one bit for each window of each snippet.
4. Cut. Each group joins the bits to its documents and removes what they cover.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievemill.llm.common import checkpoint, hand_back, map_arrow, release

WINDOW = 50
_ANCHOR, _SEED = 32, 12
#: Starts of a run at most, so that its first and last window cover it.
_RUN = 32
_CHUNK = 1 << 17
#: Windows hashed at a time: few enough that every intermediate result stays in a core's cache.
_TILE = 1 << 14
_MULTIPLIER = 0x9E3779B97F4A7C15
_SPREAD = np.uint64(0xD6E8FEB86659FD93)
_BYTE = np.random.default_rng(20_011).integers(1, 1 << 63, 256, dtype=np.uint64)


def _power(n: int) -> np.uint64:
    return np.uint64(pow(_MULTIPLIER, n, 1 << 64))


def _joined(a: np.ndarray, b: np.ndarray, skip: int, n: int) -> np.ndarray:
    """Hash of what ``a`` starts with, followed by ``n`` bytes that ``b`` hashes from ``skip`` on."""
    size = len(b) - skip
    return a[:size] * _power(n) + b[skip:]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _sliding_minimum(h: np.ndarray, w: int) -> np.ndarray:
    width = 1
    while 2 * width <= w:
        h = np.minimum(h[:-width], h[width:])
        width *= 2
    return np.minimum(h[: len(h) - (w - width)], h[w - width :]) if w > width else h


def _hashes(x: np.ndarray, seeds: bool) -> tuple[np.ndarray, ...]:
    h1 = _BYTE[x]
    h2 = _joined(h1, h1, 1, 1)
    h4 = _joined(h2, h2, 2, 2)
    h8 = _joined(h4, h4, 4, 4)
    h16 = _joined(h8, h8, 8, 8)
    h32 = _joined(h16, h16, 16, 16)
    if not seeds:
        # minima are small numbers; the factors spread them over all buckets again
        return (_sliding_minimum(_mixed(h32), WINDOW - _ANCHOR + 1) * _SPREAD,)
    seed = _sliding_minimum(_mixed(_joined(h8, h4, 8, 4)), WINDOW - _SEED + 1) * _SPREAD
    return seed, _joined(_joined(h32, h16, 32, 16), h2, 48, 2)


def window_hashes(x: np.ndarray, seeds: bool) -> tuple[np.ndarray, ...]:
    """For every window of ``x``: its anchor, or (``seeds``) its seed, the smallest 12-byte hash, and a hash of all of it."""
    n = max(len(x) - WINDOW + 1, 0)
    out = tuple(np.empty(n, np.uint64) for _ in range(1 + seeds))
    for a in range(0, n, _TILE):
        for column, values in zip(out, _hashes(x[a : a + _TILE + WINDOW - 1], seeds)):
            column[a : a + _TILE] = values
    return out


# -- groups of documents -------------------------------------------------------------------------------------------


class Group:
    """A group's documents, as bytes one after another."""

    def __init__(self, blobs: list[bytes]):
        ids, sizes, known, texts, extras = [], [], [], [], []
        for blob in blobs:
            n, extra_bytes = (int.from_bytes(blob[i : i + 8], "little") for i in (0, 8))
            raw = zstandard.ZstdDecompressor().decompressobj().decompress(blob[16:])
            ids.append(np.frombuffer(raw, "<i8", n))
            sizes.append(np.frombuffer(raw, "<i8", n, 8 * n))
            known.append(np.frombuffer(raw, np.uint8, n, 16 * n).astype(bool))
            texts.append(np.frombuffer(raw, np.uint8, len(raw) - 17 * n - extra_bytes, 17 * n))
            if extra_bytes:
                extras += json.loads(raw[len(raw) - extra_bytes :])
        join = lambda parts, kind: parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.zeros(0, kind)
        self.ids, self.sizes = join(ids, np.int64), join(sizes, np.int64)
        self.known, self.x, self.extras = join(known, bool), join(texts, np.uint8), extras
        self.at = np.cumsum(self.sizes) - self.sizes

    def runs(self) -> Iterator[tuple[np.ndarray, ...]]:
        """Runs of neighbouring windows of a document that have one anchor, a bounded number at a time: where the first
        window starts (in x), how many there are, the document's number, the anchor."""
        first = 0
        n = len(self.ids)
        while first < n:
            last = first + 1
            while last < n and self.at[last] + self.sizes[last] - self.at[first] <= _CHUNK:
                last += 1
            at, past = self.at[first:last], (self.at + self.sizes)[first:last] - WINDOW + 1
            lo, hi = int(at[0]), int(past[-1]) + WINDOW - 1
            for a in range(lo, max(hi - WINDOW + 1, lo), _CHUNK):
                (anchor,) = window_hashes(self.x[a : min(a + _CHUNK + WINDOW - 1, hi)], seeds=False)
                new = np.ones(len(anchor), bool)
                np.not_equal(anchor[1:], anchor[:-1], out=new[1:])
                # windows that start in a document but do not end in it are runs of their own, left out below
                edges = np.concatenate([at, past]) - a
                new[edges[(edges >= 0) & (edges < len(anchor))]] = True
                begin = np.flatnonzero(new)
                of = np.repeat(np.arange(last - first), np.diff(np.searchsorted(begin, at - a), append=len(begin)))
                ok = np.flatnonzero((begin + a < past[of]) & self.known[first + of])
                yield begin[ok] + a, np.diff(begin, append=len(anchor))[ok], first + of[ok], anchor[begin[ok]]
            first = last


def pack_group(ids: list[int | None], texts: list[bytes], extras: list[str | None]) -> bytes:
    head = np.array([i or 0 for i in ids], "<i8").tobytes() + np.array([len(t) for t in texts], "<i8").tobytes()
    known = bytes(i is not None for i in ids)
    extra = json.dumps(extras).encode() if any(x is not None for x in extras) else b""
    packer = zstandard.ZstdCompressor(3).compressobj()
    parts = [packer.compress(part) for part in (head, known, *texts, extra)]
    return b"".join([len(ids).to_bytes(8, "little"), len(extra).to_bytes(8, "little"), *parts, packer.flush()])


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> np.uint64(40)) * np.uint64(buckets) >> np.uint64(24)).astype(np.int64)


def _slices(bucket: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket begins in a sorted bucket column."""
    return np.searchsorted(bucket, np.arange(buckets + 1))


# -- step 1: shared anchors ------------------------------------------------------------------------------------------


def anchors_of(group: Group) -> tuple[np.ndarray, np.ndarray]:
    """A group's distinct anchors in order, and whether two documents have each."""
    values, owners = [], []
    for _, _, doc, anchor in group.runs():
        values.append(anchor)
        owners.append(doc.astype(np.int32))
    if not values:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    value, owner = np.concatenate(values), np.concatenate(owners)
    values.clear()
    owners.clear()
    if not len(value):
        return value, np.zeros(0, bool)
    order = np.argsort(value)
    value, owner = value[order], group.ids[owner[order]]
    del order
    start = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]]))
    return value[start], np.minimum.reduceat(owner, start) != np.maximum.reduceat(owner, start)


def _short(value: np.ndarray) -> bytes:
    """Four bytes of each hash; with its bucket they tell a hash from all but a few in a million others."""
    return value.astype("<u4").tobytes()


def _unshort(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, "<u4")


def shared_anchors(shards: list[tuple[bytes, bytes]]) -> list[bytes]:
    """For each group's (four-byte anchors, bits: in two of its documents): the anchors that another document has too."""
    sizes = [len(v) // 4 for v, _ in shards]
    value = _unshort(b"".join(v for v, _ in shards))
    twice = np.concatenate([np.unpackbits(np.frombuffer(b, np.uint8), count=n).astype(bool) for n, (_, b) in zip(sizes, shards)])
    order = np.argsort(value, kind="stable")
    new = np.concatenate([[True], value[order][1:] != value[order][:-1]])
    of = np.empty(len(value), np.int64)
    of[order] = np.cumsum(new) - 1
    shared = ((np.bincount(of) > 1) | (np.bincount(of, twice) > 0))[of]
    edges = np.cumsum([0, *sizes])
    return [_short(value[a:b][shared[a:b]]) for a, b in zip(edges, edges[1:])]


def _place(anchor: np.ndarray, buckets: int) -> np.ndarray:
    """What an anchor is told by: its bucket and its four bytes."""
    return _bucket(anchor, buckets) << 32 | (anchor & np.uint64((1 << 32) - 1)).astype(np.int64)


# -- step 2: snippets ------------------------------------------------------------------------------------------------


class Snippets:
    """The distinct runs of a group's windows with shared anchors, by bucket.

    ``run_of``, ``start``, ``count``, ``doc``: all runs and the distinct run each is; ``first``: a run for each distinct.
    """

    def __init__(self, group: Group, shared: np.ndarray, places: int, buckets: int):
        """``shared``: places of the anchors, of which there are so many buckets, that another document has too, sorted."""
        starts, counts, docs, keys, seeds = [], [], [], [], []
        # most anchors are not shared; a table by their last bits tells that of nearly all, without a search
        low = np.uint64((1 << min(24, 3 + len(shared).bit_length())) - 1)
        seen = np.zeros(int(low) + 1, bool)
        seen[shared & np.int64(low)] = True
        for begin, n, doc, anchor in group.runs():
            hit = np.flatnonzero(seen[anchor & low])
            place = _place(anchor[hit], places)
            hit = hit[shared[np.searchsorted(shared, place).clip(max=len(shared) - 1)] == place] if len(hit) else hit
            if not len(hit):
                continue
            begin, n, doc = begin[hit], n[hit], doc[hit]
            # windows with shared anchors, stretch by stretch (documents lie apart), with their hashes
            new = np.flatnonzero(np.concatenate([[True], begin[1:] != begin[:-1] + n[:-1]]))
            begin, n = begin[new], np.add.reduceat(n, new)
            within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            of_stretch = np.repeat(np.arange(len(n)), n)
            s, d = begin[of_stretch] + within, doc[new][of_stretch]
            m, w = (h[np.arange(len(s)) + (WINDOW - 1) * of_stretch] for h in window_hashes(_cut_out(group.x, begin, n + WINDOW - 1), seeds=True))
            new = np.concatenate([[True], (s[1:] != s[:-1] + 1) | (m[1:] != m[:-1])])
            begin = np.flatnonzero(new)
            place = np.arange(len(s)) - np.repeat(begin, np.diff(np.append(begin, len(s))))
            begin = np.flatnonzero(place % _RUN == 0)
            end = np.append(begin[1:], len(s)) - 1
            starts.append(s[begin])
            counts.append(end - begin + 1)
            docs.append(d[begin])
            seeds.append(m[begin])
            keys.append(_mixed(w[begin]) * np.uint64(3) + _mixed(w[end] + (end - begin).astype(np.uint64)))
        join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
        self.start, self.count, self.doc = join(starts, np.int64), join(counts, np.int64), join(docs, np.int64)
        key, seed = join(keys, np.uint64), join(seeds, np.uint64)
        bucket = _bucket(seed, buckets)
        order = np.lexsort((key, bucket))
        new = np.ones(len(order), bool)
        new[1:] = (key[order][1:] != key[order][:-1]) | (bucket[order][1:] != bucket[order][:-1])
        self.run_of = np.empty(len(order), np.int64)
        self.run_of[order] = np.cumsum(new) - 1
        self.first = order[new]
        self.bucket = bucket[self.first]
        self.slice = (seed[self.first] >> np.uint64(8)).astype(np.uint8)
        self.owner = np.full(len(self.first), np.iinfo(np.int64).max)
        np.minimum.at(self.owner, self.run_of, group.ids[self.doc])

    def rows(self, group: Group, buckets: int) -> Iterator[tuple[int, bytes]]:
        """Each bucket's snippets: their number, starts, slices, smallest doc_ids and bytes."""
        cut = _slices(self.bucket, buckets)
        for b in np.flatnonzero(np.diff(cut)):
            first = self.first[cut[b] : cut[b + 1]]
            start, count = self.start[first], self.count[first]
            size = count + WINDOW - 1
            index = np.repeat(start, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            raw = count.astype(np.uint8).tobytes() + self.slice[cut[b] : cut[b + 1]].tobytes() + self.owner[cut[b] : cut[b + 1]].astype("<i8").tobytes() + group.x[index].tobytes()
            yield int(b), len(first).to_bytes(8, "little") + zstandard.compress(raw, 3)


# -- step 3: Burrows-Wheeler transforms --------------------------------------------------------------------------------


class Shard:
    """Strings with the order of all their rotations (each closed by an end mark) and their transform."""

    def __init__(self, sizes: np.ndarray, data: np.ndarray):
        n = len(data) + len(sizes)
        self.length = sizes + 1
        self.begin = np.cumsum(self.length) - self.length
        self.text = np.zeros(n, np.int64)
        inside = np.ones(n, bool)
        inside[self.begin + sizes] = False
        self.text[inside] = data.astype(np.int64) + 1
        self.string = np.repeat(np.arange(len(sizes)), self.length)
        self.order = self._sorted(n)
        place = self.order - self.begin[self.string[self.order]]
        before = np.where(place > 0, self.order - 1, self.order + self.length[self.string[self.order]] - 1)
        self.bwt = self.text[before].astype(np.uint16)

    def _ahead(self, n: int, k: int) -> np.ndarray:
        base, length = self.begin[self.string], self.length[self.string]
        return base + (np.arange(n) - base + k) % length

    def _sorted(self, n: int) -> np.ndarray:
        """Prefix doubling from seven characters on, until every rotation is told apart or seen whole."""
        key = self.text.copy()
        for i in range(1, 7):
            key = key * 257 + self.text[self._ahead(n, i)]
        k, longest = 7, int(self.length.max(initial=1))
        while True:
            order = np.argsort(key)  # rotations that are alike may come in any order
            if k >= longest:
                return order
            rank = np.empty(n, np.int64)
            new = np.concatenate([[False], key[order][1:] != key[order][:-1]])
            rank[order] = np.cumsum(new)
            if new.sum() == n - 1:
                return order
            key = rank * n + rank[self._ahead(n, k)]
            k *= 2


def merge_transforms(transforms: list[np.ndarray], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The merged order (positions in the concatenated transforms) and the block of each place: equal for ``depth`` characters.

    Every transform's own order stays as it is; only the interleave is refined.
    """
    bwt = np.concatenate(transforms) if transforms else np.zeros(0, np.uint16)
    n = len(bwt)
    used = np.flatnonzero(np.bincount(bwt, minlength=258))
    if len(used) <= 256:  # one byte a character sorts in one pass
        dense = np.zeros(258, np.uint8)
        dense[used] = np.arange(len(used))
        bwt = dense[bwt]
    to = np.empty(n, np.int32)  # where a rotation that begins one character earlier stands in its own transform
    at = 0
    for one in transforms:
        to[at + np.argsort(bwt[at : at + len(one)], kind="stable")] = np.arange(at, at + len(one), dtype=np.int32)
        at += len(one)
    # where each character's rotations begin in any order by first characters
    heads = np.cumsum(np.bincount(bwt, minlength=1))[:-1]
    heads = heads[heads < n]
    merged, block = np.arange(n, dtype=np.int32), np.zeros(n, np.int32)
    new = np.zeros(n, bool)
    for _ in range(depth):
        order = np.argsort(bwt[merged], kind="stable")
        both = (block.astype(np.int64) << 32 | merged)[order]
        block = (both >> 32).astype(np.int32)
        new[1:] = block[1:] != block[:-1]
        new[heads] = True
        if n:
            new[0] = False
        merged, block = to[both & 0xFFFFFFFF], np.cumsum(new, dtype=np.int32)
        if n and block[-1] == n - 1:
            break
    return merged, block


def _sharing(data: np.ndarray, begin: np.ndarray, size: np.ndarray, most: int = 1 << 20) -> np.ndarray:
    """The strings that have a window whose hash another of the strings has too."""
    hashes, owner = [], []
    cuts = np.searchsorted(np.cumsum(size), np.arange(most, int(size.sum()) + most, most)) + 1
    for a, b in zip([0, *cuts], [*cuts, len(size)]):
        n = size[a:b]
        if not len(n):
            continue
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        whole = window_hashes(data[np.repeat(begin[a:b], n) + within], seeds=True)[1]
        ok = np.flatnonzero((within + WINDOW <= np.repeat(n, n))[: len(whole)])
        hashes.append(whole[ok])
        owner.append(np.repeat(np.arange(a, min(b, len(size))), n)[ok])
    h, o = np.concatenate(hashes), np.concatenate(owner)
    order = np.argsort(h)
    h, o = h[order], o[order]
    start = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    several = np.repeat(np.minimum.reduceat(o, start) != np.maximum.reduceat(o, start), np.diff(np.append(start, len(h))))
    return np.unique(o[several])


def _cut_out(data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The strings that begin there, one after another."""
    return data[np.repeat(begin, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)]


def _repeated(data: np.ndarray, begin: np.ndarray, count: np.ndarray, least: np.ndarray, shard_bytes: int) -> np.ndarray:
    """For each window of distinct strings, whether it also starts in one with a smaller owner.

    Equal windows have equal hashes, so a string without a hash that another has can't share a window; all others are
    dealt to shards of about ``shard_bytes``, whose transforms are merged and decide.
    """
    offset = np.cumsum(count) - count
    hit = np.zeros(int(count.sum()), bool)
    size = count + WINDOW - 1
    chosen = _sharing(data, begin, size)
    if not len(chosen):
        return hit
    n = size[chosen]
    shard_of = (np.cumsum(n) - n) // shard_bytes
    edges = np.append(np.flatnonzero(np.concatenate([[True], shard_of[1:] != shard_of[:-1]])), len(chosen))
    transforms, string, place = [], [], []
    for a, b in zip(edges, edges[1:]):
        shard = Shard(n[a:b], _cut_out(data, begin[chosen[a:b]], n[a:b]))
        transforms.append(shard.bwt)
        of = shard.string[shard.order]
        string.append((of + a).astype(np.int32))
        place.append((shard.order - shard.begin[of]).astype(np.uint8))
    merged, block = merge_transforms(transforms, WINDOW)
    # by place in the merged transform: the string, the window in it, and whether a whole window starts there
    string, place = chosen[np.concatenate(string)[merged]], np.concatenate(place)[merged]
    valid = place < count[string]
    string, place, block = string[valid], place[valid], block[valid]
    lowest = np.full(int(block[-1]) + 1 if len(block) else 0, np.iinfo(np.int64).max)
    np.minimum.at(lowest, block, least[string])
    hit[offset[string] + place] = lowest[block] < least[string]
    return hit


def repeated_windows(shards: list[bytes], slice_bytes: int = 1 << 20, shard_bytes: int = 1 << 18) -> list[np.ndarray]:
    """For each group's snippets, whether each window also starts in a document with a smaller doc_id than its owner.

    Snippets that several groups sent are one string here, owned by the smallest doc_id. Windows that are equal have
    the same slice, so slices of about ``slice_bytes`` are merged one after the other.
    """
    counts, slices, owners, texts = [], [], [], []
    for blob in shards:
        n = int.from_bytes(blob[:8], "little")
        raw = zstandard.decompress(blob[8:])
        counts.append(np.frombuffer(raw, np.uint8, n).astype(np.int64))
        slices.append(np.frombuffer(raw, np.uint8, n, n).astype(np.int64))
        owners.append(np.frombuffer(raw, "<i8", n, 2 * n))
        texts.append(np.frombuffer(raw, np.uint8, -1, 10 * n))
    sent = np.cumsum([0, *map(len, counts)])
    count, part, owner, data = (np.concatenate(x) for x in (counts, slices, owners, texts))
    del texts
    size = count + WINDOW - 1
    begin = np.cumsum(size) - size
    number: dict[bytes, int] = {}
    view = memoryview(data)
    of = np.fromiter((number.setdefault(bytes(view[a:b]), len(number)) for a, b in zip(begin.tolist(), (begin + size).tolist())), np.int64, len(size))
    first = np.full(len(number), -1)
    first[of[::-1]] = np.arange(len(of))[::-1]
    del number
    least = np.full(len(first), np.iinfo(np.int64).max)
    np.minimum.at(least, of, owner)
    count_1 = count[first]
    offset = np.cumsum(count_1) - count_1
    hit = np.zeros(int(count_1.sum()), bool)
    n_slices = min(256, max(1, -(-int(size[first].sum()) // slice_bytes)))
    slice_of = part[first] * n_slices >> 8
    order = np.argsort(slice_of, kind="stable")
    for one in np.split(order, np.searchsorted(slice_of[order], np.arange(1, n_slices))):
        if len(one) > 1:
            found = np.flatnonzero(_repeated(data, begin[first[one]], count_1[one], least[one], shard_bytes))
            edge = np.cumsum(count_1[one])
            at = np.searchsorted(edge, found, side="right")
            hit[offset[one[at]] + found - (edge - count_1[one])[at]] = True
    out = []
    for a, b in zip(sent, sent[1:]):
        # each window of a group's snippets: all of them if another group's owner of the same snippet is smaller
        mine, n = of[a:b], count[a:b]
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        out.append(hit[np.repeat(offset[mine], n) + within] | np.repeat(owner[a:b] > least[mine], n))
    return out


# -- step 4: cut -------------------------------------------------------------------------------------------------------


def covered(group: Group, snippets: Snippets, hits: np.ndarray) -> np.ndarray:
    """Which bytes of a group go. ``hits``: a bit for each window of each distinct snippet, in order."""
    # so few intervals cover a byte (each begins at one of the 81 bytes before) that a byte counts them
    change = np.zeros(len(group.x) + 1, np.int8)
    if len(snippets.start):
        n = snippets.count[snippets.first]
        offset = np.cumsum(n) - n
        later = group.ids[snippets.doc] > snippets.owner[snippets.run_of]
        some = np.add.reduceat(hits, offset) > 0 if len(hits) else np.zeros(len(n), bool)
        np.add.at(change, snippets.start[later], 1)
        np.add.at(change, snippets.start[later] + snippets.count[later] - 1 + WINDOW, -1)
        rest = np.flatnonzero(~later & some[snippets.run_of])
        count = snippets.count[rest]
        within = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        bit = hits[np.repeat(offset[snippets.run_of[rest]], count) + within]
        start = (np.repeat(snippets.start[rest], count) + within)[bit]
        np.add.at(change, start, 1)
        np.add.at(change, start + WINDOW, -1)
    return np.cumsum(change[:-1], dtype=np.int8, out=change[:-1]) > 0


def _bits(column: list, cuts: np.ndarray) -> np.ndarray:
    """Bits of all buckets, in the buckets' order, each as long as its slice."""
    sizes = np.diff(cuts)
    out = np.zeros(int(cuts[-1]), bool)
    for b, raw in column:
        out[cuts[b] : cuts[b + 1]] = np.unpackbits(np.frombuffer(raw, np.uint8), count=int(sizes[b])).astype(bool)
    return out


def _shared_of(answers: pa.Table) -> np.ndarray:
    """Places of a group's shared anchors, from the answers of step 1."""
    parts = [b << 32 | _unshort(raw).astype(np.int64) for step, b, raw in zip(*(answers.column(n).to_pylist() for n in ("step", "b", "bits"))) if step == 1]
    return np.sort(np.concatenate(parts)) if parts else np.zeros(0, np.int64)


_TO_BUCKET = pa.schema([("b", pa.int64()), ("p", pa.int64()), ("data", pa.binary()), ("more", pa.binary())])
_TO_GROUP = pa.schema([("p", pa.int64()), ("step", pa.int32()), ("b", pa.int64()), ("bits", pa.binary())])


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    columns = list(zip(*rows)) or [()] * len(schema)
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def remove_repeats(spark: SparkSession, docs: DataFrame, group_bytes: int = 16 << 20, keep_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of ``doc_id, text`` rows.

    With ``keep_text`` also kept (the bytes left as text, without halves of characters) and extra, a string column of the input that is carried along. Null texts count as empty; texts under 50 bytes and rows without a doc_id are left whole and remove nothing; rows of
    one doc_id do not remove each other's strings; an empty table gives no rows.
    """
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    release(spark)
    groups = max(1, -(-total // group_bytes))
    places, buckets = max(8, -(-groups // 2)), 2 * groups

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A task's documents, in groups that the task's number and a count name."""
        ids, texts, extras = [], [], []
        p, size = TaskContext.get().partitionId() << 32, 0

        def flushed() -> pa.RecordBatch:
            nonlocal p, size
            blob = pack_group(ids, texts, extras)
            for column in (ids, texts, extras):
                column.clear()
            p, size = p + 1, 0
            return pa.RecordBatch.from_arrays([pa.array([p], pa.int64()), pa.array([blob], pa.binary())], ["p", "blob"])

        for batch in batches:
            for doc_id, text, extra in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                raw = (text.as_py() or "").encode()
                if texts and size + len(raw) > group_bytes:
                    yield flushed()
                ids.append(doc_id)
                texts.append(raw)
                extras.append(extra)
                size += len(raw)
        if texts:
            yield flushed()

    rows = docs.select("doc_id", "text", F.col("extra") if keep_text else F.lit(None).cast("string").alias("extra"))
    packed = checkpoint(spark, map_arrow(rows, deal, "p long, blob binary"))

    def send_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                value, twice = anchors_of(Group([blob.as_py()]))
                cut = _slices(_bucket(value, places), places)
                some = [(int(b), slice(cut[b], cut[b + 1])) for b in np.flatnonzero(np.diff(cut))]
                yield from _table([(b, p, _short(value[i]), np.packbits(twice[i]).tobytes()) for b, i in some], _TO_BUCKET).to_batches()

    def answer(step: int, solve: Callable[[pa.Table], list[bytes]]) -> Callable[[pa.Table], pa.Table]:
        def run(got: pa.Table) -> pa.Table:
            bits = solve(got)
            hand_back()
            return _table([(p, step, b, x) for p, b, x in zip(got.column("p").to_pylist(), got.column("b").to_pylist(), bits)], _TO_GROUP)

        return run

    def send_snippets(docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return _table([], _TO_BUCKET)
        group = Group(docs.column("blob").to_pylist())
        snippets = Snippets(group, _shared_of(answers), places, buckets)
        p = docs.column("p")[0].as_py()
        return _table([(b, p, blob, b"") for b, blob in snippets.rows(group, buckets)], _TO_BUCKET)

    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "extra"][: 5 + 2 * keep_text]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()][: 5 + 2 * keep_text]

    def cut_out(docs: pa.Table, answers: pa.Table) -> pa.Table:
        schema = pa.schema(list(zip(names, types)))
        if not docs.num_rows:
            return _table([], schema)
        group = Group(docs.column("blob").to_pylist())
        snippets = Snippets(group, _shared_of(answers), places, buckets)
        counts = snippets.count[snippets.first]
        edge = np.concatenate([[0], np.cumsum(counts)])[_slices(snippets.bucket, buckets)]
        hits = _bits([(b, raw) for step, b, raw in zip(*(answers.column(n).to_pylist() for n in ("step", "b", "bits"))) if step == 2], edge)
        gone = covered(group, snippets, hits)
        rows = []
        extras = group.extras or [None] * len(group.ids)
        for doc_id, known, at, size, extra in zip(group.ids.tolist(), group.known.tolist(), group.at.tolist(), group.sizes.tolist(), extras):
            out, text = gone[at : at + size], group.x[at : at + size]
            kept = text[~out].tobytes()
            spans = int(out[:1].sum() + (out[1:] & ~out[:-1]).sum())
            row = (doc_id if known else None, size, int(out.sum()), spans, hashlib.sha256(kept).hexdigest())
            rows.append((*row, kept.decode(errors="ignore"), extra) if keep_text else row)
        return _table(rows, schema)

    def then_tidy(result: pa.Table) -> pa.Table:
        hand_back()
        return result

    to_bucket, to_group = "b long, p long, data binary, more binary", "p long, step int, b long, bits binary"
    sent = map_arrow(packed, send_anchors, to_bucket)
    solve_one = lambda got: shared_anchors(list(zip(got.column("data").to_pylist(), got.column("more").to_pylist())))
    first = checkpoint(spark, sent.groupBy("b").applyInArrow(answer(1, solve_one), to_group))
    release(spark)
    snippets = packed.groupBy("p").cogroup(first.groupBy("p")).applyInArrow(lambda docs, answers: then_tidy(send_snippets(docs, answers)), to_bucket)
    solve_two = lambda got: [np.packbits(x).tobytes() for x in repeated_windows(got.column("data").to_pylist())]
    second = checkpoint(spark, snippets.groupBy("b").applyInArrow(answer(2, solve_two), to_group))
    release(spark)
    both = first.unionByName(second)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept string, extra string" * keep_text
    return packed.groupBy("p").cogroup(both.groupBy("p")).applyInArrow(lambda docs, answers: then_tidy(cut_out(docs, answers)), schema)
