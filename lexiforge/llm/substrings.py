"""Exact removal of repeated substrings with a suffix array that is sorted in parts.

Every 50-byte window of the corpus is dealt to a bucket by its minimiser, the 10-byte string inside it of smallest
hash; equal windows have equal minimisers, so each bucket can be judged alone.  Neighbouring windows share their
minimiser and travel as one stretch.  Stretches of very common minimisers are dealt by their longer side too, which all
windows of that side share, so that a minimiser of many contexts does not fill one bucket.  A bucket first drops windows whose minimiser, with the longer part of the window
beside it, stands in one document only.  The suffixes that begin at its windows are then sorted by deep-shallow
sorting: multikey quicksort over 8-byte characters to a shallow depth, leaving out what is alone, then blind tries for
the groups whose common prefix goes on.  A leaf of a trie holds the windows that are equal, byte for byte; those not in
the leaf's smallest document go.  Hashes deal and preselect only: nothing is removed before its bytes were compared.

Stretches that occur several times in a task are settled there, again byte for byte: the smallest document's goes on,
the other documents' are removed, so a passage that stands in very many documents reaches its bucket about once a task.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import cut, give_back, release_shuffles, small_batches
from .textvec import chunks, mix, span_hashes

#: Bytes of a repeated string.
WINDOW = 50
#: Bytes of a minimiser.
ANCHOR = 10
#: A window holds at least so many bytes on one side of its minimiser.
BESIDE = (WINDOW - ANCHOR) // 2
#: Bytes that multikey quicksort looks at before blind tries take over.
SHALLOW = 24
#: Level of compression on the way to the buckets.
LEVEL = 9
#: Text bytes that are cut up at a time, below 2**24 as places share a word with hashes.
BATCH_BYTES = 1 << 20
#: Bytes of stretches, about four times those of their texts, that are gathered before they are compressed and sent.
SENT_BYTES = 32 << 20
#: Text bytes of the corpus for each bucket.
BUCKET_BYTES = 3 << 20
#: Bytes of text, about, in which very common minimisers are looked for, and the share of its stretches that makes one so.
#: They only decide where windows are compared, never what goes.
LOOKED_AT, COMMON_SHARE, MOST_COMMON = 64 << 20, 20_000, 4096
#: Places, from the minimiser on, of the words of the longer side beside it: bytes that all windows of one kind hold.
RIGHT = (0, 8, 16, ANCHOR + BESIDE - 8)
LEFT = (-BESIDE, 8 - BESIDE, 16 - BESIDE, ANCHOR - 8)


def words_at(raw: bytes | bytearray | memoryview) -> np.ndarray:
    """The 8 bytes from every place on as one number that sorts as they do, as a view; the last 7 places have none."""
    return np.ndarray((max(0, len(raw) - 7),), ">u8", raw, 0, (1,))


def word(view: np.ndarray, places: np.ndarray) -> np.ndarray:
    return view[places].astype(np.uint64)


def runs(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin, and the end."""
    n = len(keys[0])
    new = np.zeros(n, bool)
    if n:
        new[0] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.append(np.flatnonzero(new), n)


def shared_runs(owner: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Which runs several owners share."""
    if len(bounds) < 2:
        return np.zeros(0, bool)
    return np.minimum.reduceat(owner, bounds[:-1]) != np.maximum.reduceat(owner, bounds[:-1])


def multikey_quicksort(view: np.ndarray, places: np.ndarray, owners: np.ndarray, bounds: np.ndarray, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes at ``places`` by their first ``shallow`` bytes, as far as several owners share them.

    Multikey quicksort over 8-byte characters of all given runs (``bounds``) at once: a round parts each run by a
    pivot, the median of three, into smaller, equal and larger; equal parts go on a character further.  A part of a
    single owner shares nothing and is left out.  Returns indices into ``places`` in order and the bounds of runs that
    are equal to ``shallow``.
    """
    index = np.arange(len(places))
    depth = np.zeros(len(bounds) - 1, np.int64)
    done: list[tuple[np.ndarray, np.ndarray]] = []
    while True:
        kept = shared_runs(owners[index], bounds)
        finished = kept & (depth >= shallow)
        sizes = np.diff(bounds)
        if finished.any():
            done.append((index[np.repeat(finished, sizes)], sizes[finished]))
        kept &= ~finished
        if not kept.any():
            break
        index, depth, sizes = index[np.repeat(kept, sizes)], depth[kept], sizes[kept]
        start = np.cumsum(sizes) - sizes
        w = word(view, places[index] + np.repeat(depth, sizes))
        pivot = np.repeat(np.sort(np.stack([w[start], w[start + sizes // 2], w[start + sizes - 1]]), axis=0)[1], sizes)
        parts = (w < pivot, w == pivot, w > pivot)
        # a stable three-way partition by counting
        to = np.zeros(len(index), np.int64)
        begin, counts = start, []
        for part in parts:
            rank = np.cumsum(part) - part
            counts.append(np.add.reduceat(part, start, dtype=np.int64))
            to[part] = (np.repeat(begin - rank[start], sizes) + rank)[part]
            begin = begin + counts[-1]
        moved = np.empty_like(index)
        moved[to] = index
        index = moved
        sizes = np.stack(counts, axis=1).ravel()
        depth = np.stack([depth, depth + 8, depth], axis=1).ravel()[sizes > 0]
        bounds = np.append(0, np.cumsum(sizes[sizes > 0]))
    if not done:
        return np.zeros(0, np.int64), np.zeros(1, np.int64)
    return np.concatenate([i for i, _ in done]), np.append(0, np.cumsum(np.concatenate([n for _, n in done])))


def first_difference(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """First byte, 0 to 7, in which words differ; 8 where they are equal."""
    x = a ^ b
    out = np.full(len(x), 8)
    odd = np.flatnonzero(x)
    out[odd] = sum((x[odd] < np.uint64(1 << 8 * k)).astype(np.int64) for k in range(1, 8))
    return out


def blind_tries(data: np.ndarray, view: np.ndarray, places: np.ndarray, owners: np.ndarray, index: np.ndarray, bounds: np.ndarray, shallow: int = SHALLOW, depth: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Blind tries of the runs that are equal to ``shallow``, all grown together; their leaves are the equal strings.

    A node looks at one byte, the first in which its strings differ, found by comparing each string with one of them,
    byte for byte to ``depth``; its children are the strings by that byte, in order.  A node without such a byte is a leaf.
    Children of a single owner are not followed.  Returns indices into ``places`` and the bounds of the leaves.
    """
    tail = [*range(shallow, depth - 8, 8), depth - 8]
    leaves: list[tuple[np.ndarray, np.ndarray]] = []
    while len(index):
        sizes = np.diff(bounds)
        start = np.repeat(bounds[:-1], sizes)
        common = np.full(len(index), depth)
        open_ = np.arange(len(index))
        for d in tail:
            at = first_difference(word(view, places[index[open_]] + d), word(view, places[index[start[open_]]] + d))
            odd = at < 8
            common[open_[odd]] = d + at[odd]
            open_ = open_[~odd]
        branch = np.minimum.reduceat(common, bounds[:-1])
        whole = branch >= depth
        if whole.any():
            leaves.append((index[np.repeat(whole, sizes)], sizes[whole]))
        rest = np.repeat(~whole, sizes)
        index = index[rest]
        node = np.repeat(np.arange(int((~whole).sum())), sizes[~whole])
        key = node * 256 + data[places[index] + np.repeat(branch[~whole], sizes[~whole])]
        order = np.argsort(key, kind="stable")
        index, key = index[order], key[order]
        bounds = runs(key)
        kept = shared_runs(owners[index], bounds)
        sizes = np.diff(bounds)
        index, bounds = index[np.repeat(kept, sizes)], np.append(0, np.cumsum(sizes[kept]))
    if not leaves:
        return np.zeros(0, np.int64), np.zeros(1, np.int64)
    return np.concatenate([i for i, _ in leaves]), np.append(0, np.cumsum(np.concatenate([n for _, n in leaves])))


def deep_shallow_groups(data: np.ndarray, places: np.ndarray, owners: np.ndarray, bounds: np.ndarray | None = None, depth: int = WINDOW, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """Strings of ``depth`` bytes at ``places`` of ``data`` that several owners share, each with all its places.

    ``bounds`` are runs of places, in one of which equal strings stand together; without it there is one run.  Returns
    indices into ``places`` and the bounds of runs of equal strings.
    """
    if not len(places):
        return np.zeros(0, np.int64), np.zeros(1, np.int64)
    view = words_at(data.data)
    index, runs_ = multikey_quicksort(view, places, owners, np.array([0, len(places)]) if bounds is None else bounds, shallow)
    return blind_tries(data, view, places, owners, index, runs_, shallow, depth)


def same_bytes(view: np.ndarray, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether the ``length`` bytes (8 at least) at ``a`` are those at ``b``."""
    out = np.ones(len(a), bool)
    for k in range(0, int(length.max(initial=0)), 8):
        at = np.minimum(k, length - 8)
        out &= view[a + at] == view[b + at]
    return out


def context(view: np.ndarray, at: np.ndarray, steps: tuple) -> np.ndarray:
    """Hash of the bytes around each place."""
    key = word(view, at + steps[0])
    for d in steps[1:]:
        key = mix(key) + word(view, at + d)
    return key


def parted(view: np.ndarray, start: np.ndarray, last: np.ndarray, anchor: np.ndarray, h: np.ndarray, text: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, ...]:
    """Stretches, those with a ``common`` minimiser cut in two where its longer side changes, with what each is dealt by:
    the minimiser's hash, or for common ones that of the minimiser and its longer side, which parts its contexts."""
    hot = np.isin(h, common)
    if not hot.any():
        return start, last, anchor, text, h
    turn = anchor[hot] - BESIDE  # windows from here on have the longer side on the right
    out = [[x[~hot] for x in (start, last, anchor, text, h)]]
    for first, stop, steps in ((np.maximum(start[hot], turn), last[hot], RIGHT), (start[hot], np.minimum(last[hot], turn - 1), LEFT)):
        some = np.flatnonzero(first <= stop)
        place = anchor[hot][some]
        out.append([first[some], stop[some], place, text[hot][some], context(view, place, steps)])
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def stretches(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one minimiser: first window, last window, minimiser's place and hash, and text number."""
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < WINDOW:
        return none, none, none, none.astype(np.uint64), none
    view = words_at(data.data)
    h = np.zeros(n, np.uint64)
    h[: n - ANCHOR + 1] = mix(mix(view[: n - ANCHOR + 1].astype(np.uint64)) + view[ANCHOR - 8 :].astype(np.uint64))
    low = np.uint64(24)
    m = ((h >> low) << low) | np.arange(n, dtype=np.uint64)
    span, reach = WINDOW - ANCHOR + 1, 1
    while 2 * reach <= span:
        m = np.minimum(m[:-reach], m[reach:])
        reach *= 2
    m = np.minimum(m[: len(m) - (span - reach)], m[span - reach :])
    place = (m & np.uint64((1 << 24) - 1)).astype(np.int32)
    del m
    sizes = np.diff(bounds)
    text = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    valid = np.arange(n) + WINDOW <= np.repeat(bounds[1:], sizes)
    window = np.flatnonzero(valid)
    if not len(window):
        return none, none, none, none.astype(np.uint64), none
    at = place[window]
    new = np.ones(len(window), bool)
    new[1:] = (at[1:] != at[:-1]) | (window[1:] != window[:-1] + 1)
    start = np.flatnonzero(new)
    last = np.append(start[1:], len(window)) - 1
    anchor = at[start]
    return window[start], window[last], anchor.astype(np.int64), h[anchor], text[window[start]].astype(np.int64)


STRETCH = np.dtype([("doc", "<u4"), ("start", "<u4"), ("anchor", "u1"), ("length", "u1")])
RANGE = np.dtype([("doc_id", "<i8"), ("version", "<i8"), ("begin", "<i8"), ("end", "<i8")])


def pack_blob(doc_ids: np.ndarray, versions: np.ndarray, rows: np.ndarray, payload: bytes, ranges: np.ndarray) -> bytes:
    """Columns behind each other, documents and places as differences, compressed."""
    head = np.array([len(doc_ids), len(rows), len(payload), len(ranges)], "<i8").tobytes()
    columns = b"".join(np.diff(rows[c], prepend=rows[c].dtype.type(0)).tobytes() if c in ("doc", "start") else rows[c].tobytes() for c in STRETCH.names)
    plain = head + np.diff(doc_ids.astype("<i8"), prepend=0).tobytes() + versions.astype("<i8").tobytes() + columns + ranges.tobytes() + payload
    return len(plain).to_bytes(8, "little") + pa.Codec("zstd", compression_level=LEVEL).compress(plain, asbytes=True)


def open_blob(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, bytes, np.ndarray]:
    plain = pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True)
    n_docs, n_rows, n_payload, n_ranges = np.frombuffer(plain, "<i8", 4).tolist()
    at = 32
    doc_ids = np.cumsum(np.frombuffer(plain, "<i8", n_docs, at))
    versions = np.frombuffer(plain, "<i8", n_docs, at + 8 * n_docs)
    at += 16 * n_docs
    rows = np.zeros(n_rows, STRETCH)
    for name in STRETCH.names:
        kind = STRETCH[name]
        column = np.frombuffer(plain, kind, n_rows, at)
        rows[name] = np.cumsum(column, dtype=kind) if name in ("doc", "start") else column
        at += kind.itemsize * n_rows
    ranges = np.frombuffer(plain, RANGE, n_ranges, at)
    return doc_ids, versions, rows, plain[at + RANGE.itemsize * n_ranges :], ranges


@dataclass
class Dealt:
    """What one cut sends to buckets: stretches and settled ranges in order of bucket, and where each bucket's begin."""

    doc_ids: np.ndarray
    versions: np.ndarray
    rows: np.ndarray
    payload: bytes
    before: np.ndarray
    row_edges: np.ndarray
    ranges: np.ndarray
    range_edges: np.ndarray


class Repeated:
    """Strings that a task has met in several documents, with the smallest of those documents.

    What a later batch holds of them need not travel, so a passage of very many documents reaches its bucket about once
    a task.  Beyond ``ROOM`` some are forgotten: that costs traffic, never a result.
    """

    ROOM = 20_000
    WIDTH = 2 * WINDOW - ANCHOR

    def __init__(self):
        self.keys, self.docs = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.sizes, self.texts = np.zeros(0, np.int64), np.zeros((0, self.WIDTH), np.uint8)

    def strings(self, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Strings as rows, zeros behind their ends."""
        at = np.arange(self.WIDTH)
        inside = at < length[:, None]
        return np.where(inside, data[np.where(inside, start[:, None] + at, 0)], 0).astype(np.uint8)

    def smallest(self, keys: np.ndarray, docs: np.ndarray, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """The smallest document known for each of distinct strings, which are then known for ``docs`` as well."""
        out = docs.copy()
        at = np.searchsorted(self.keys, keys)
        at[at == len(self.keys)] = 0
        near = np.flatnonzero(self.keys[at] == keys) if len(self.keys) else np.zeros(0, np.int64)
        same = near[(self.sizes[at[near]] == length[near]) & (self.texts[at[near]] == self.strings(data, start[near], length[near])).all(axis=1)]
        out[same] = np.minimum(docs[same], self.docs[at[same]])
        self.docs[at[same]] = out[same]
        return out

    def learn(self, keys: np.ndarray, docs: np.ndarray, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> None:
        new = np.flatnonzero(~np.isin(keys, self.keys))[: self.ROOM]
        if not len(new):
            return
        old = slice(max(0, len(self.keys) + len(new) - self.ROOM), None)
        columns = [np.concatenate([a[old], b]) for a, b in ((self.keys, keys[new]), (self.docs, docs[new]), (self.sizes, length[new]), (self.texts, self.strings(data, start[new], length[new])))]
        order = np.argsort(columns[0], kind="stable")
        self.keys, self.docs, self.sizes, self.texts = (c[order] for c in columns)


def deal(doc_ids: np.ndarray, versions: np.ndarray, texts: list[bytes], buckets: int, shift: int = 0, repeated: Repeated | None = None, common: np.ndarray | None = None) -> Dealt | None:
    """Cut texts up; ``shift`` is the place of a lone piece in its document, ``common`` has hashes of common minimisers."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    bounds = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=bounds[1:])
    start, last, anchor, h, text = stretches(data, bounds)
    if not len(start):
        return None
    if common is not None and len(common):
        start, last, anchor, text, h = parted(words_at(data.data), start, last, anchor, h, text, common)
    size = last - start + WINDOW
    content = span_hashes(data, start, last + WINDOW)
    order = np.lexsort((doc_ids[text], content))
    edges = runs(content[order])
    group = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
    first = order[edges[:-1]]
    several = np.flatnonzero(np.diff(edges) > 1)
    smallest = doc_ids[text[first]]
    if repeated is not None:
        smallest = repeated.smallest(content[first], smallest, data, start[first], size[first])
        spread = several[doc_ids[text[order[edges[several + 1] - 1]]] > smallest[several]]
        repeated.learn(content[first[spread]], smallest[spread], data, start[first[spread]], size[first[spread]])
    # settled: another document's, smaller, holds the same bytes
    own, head = order, first[group]
    later = np.flatnonzero(doc_ids[text[own]] > smallest[group])
    later = later[size[own[later]] == size[head[later]]]
    later = later[same_bytes(words_at(data.data), start[own[later]], start[head[later]], size[own[later]])]
    settled = np.zeros(len(start), bool)
    settled[own[later]] = True
    bucket = (mix(h) % np.uint64(buckets)).astype(np.int64)
    own = text[settled]
    ranges = np.zeros(len(own), RANGE)
    ranges["doc_id"], ranges["version"] = doc_ids[own], versions[own]
    ranges["begin"], ranges["end"] = start[settled] - bounds[own] + shift, last[settled] + WINDOW - bounds[own] + shift
    to = bucket[settled]
    by = np.argsort(to, kind="stable")
    sent = np.flatnonzero(~settled)
    sent = sent[np.argsort(bucket[sent], kind="stable")]
    rows = np.zeros(len(sent), STRETCH)
    rows["doc"], rows["start"] = text[sent], start[sent] - bounds[text[sent]] + shift
    rows["anchor"], rows["length"] = anchor[sent] - start[sent], size[sent]
    length = rows["length"].astype(np.int64)
    before = np.append(0, np.cumsum(length))
    payload = data[np.repeat(start[sent] - before[:-1], length) + np.arange(before[-1])].tobytes()
    numbers = np.arange(buckets + 1)
    return Dealt(doc_ids, versions, rows, payload, before, np.searchsorted(bucket[sent], numbers), ranges[by], np.searchsorted(to[by], numbers))


def send(dealt: list[Dealt], buckets: int) -> Iterator[tuple[int, bytes]]:
    """One blob for each bucket that gets something."""
    for k in range(buckets if dealt else 0):
        ids, versions, rows, payload, ranges, shift = [], [], [], [], [], 0
        for d in dealt:
            a, b = int(d.row_edges[k]), int(d.row_edges[k + 1])
            ranges.append(d.ranges[d.range_edges[k] : d.range_edges[k + 1]])
            if a == b:
                continue
            docs, number = np.unique(d.rows["doc"][a:b], return_inverse=True)
            part = d.rows[a:b].copy()
            part["doc"] = number + shift
            shift += len(docs)
            ids.append(d.doc_ids[docs])
            versions.append(d.versions[docs])
            rows.append(part)
            payload.append(d.payload[d.before[a] : d.before[b]])
        gone = np.concatenate(ranges)
        if rows or len(gone):
            none = np.zeros(0, np.int64)
            yield k, pack_blob(np.concatenate(ids) if ids else none, np.concatenate(versions) if ids else none, np.concatenate(rows) if rows else np.zeros(0, STRETCH), b"".join(payload), gone)


def shared_contexts(view: np.ndarray, at: np.ndarray, steps: tuple, rows: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Those of ``rows`` whose bytes around ``at`` stand with another owner too, and the number of each one's context.

    Equal contexts have equal numbers; contexts are told apart by a hash, so different ones may share a number.
    """
    key = context(view, at[rows], steps)
    order = np.argsort(key, kind="stable")
    edges = runs(key[order])
    shared = shared_runs(owner[rows[order]], edges)
    sizes = np.diff(edges)
    return rows[order[np.repeat(shared, sizes)]], np.repeat(np.arange(int(shared.sum())), sizes[shared])


def judge(blobs: list[bytes]) -> np.ndarray:
    """Ranges of bytes that go, from all blobs of one bucket."""
    ids, versions, rows, payloads, settled, shift = [], [], [], [], [], 0
    for blob in blobs:
        i, v, r, p, s = open_blob(blob)
        r["doc"] += shift
        shift += len(i)
        ids.append(i)
        versions.append(v)
        rows.append(r)
        payloads.append(p)
        settled.append(s)
    doc_ids, versions, rows, settled = np.concatenate(ids), np.concatenate(versions), np.concatenate(rows), np.concatenate(settled)
    data = np.frombuffer(b"".join(payloads), np.uint8)
    if not len(rows):
        return settled
    length = rows["length"].astype(np.int64)
    offset = np.cumsum(length) - length
    owner = doc_ids[rows["doc"]]
    anchor = rows["anchor"].astype(np.int64)
    view = words_at(data.data)
    # Places of windows, as bytes before the minimiser: up to BESIDE the right side is the longer one, then the left.
    low, high = np.maximum(0, anchor - (length - WINDOW)), anchor
    right, right_context = shared_contexts(view, offset + anchor, RIGHT, np.flatnonzero(low <= BESIDE), owner)
    left, left_context = shared_contexts(view, offset + anchor, LEFT, np.flatnonzero(high > BESIDE), owner)
    rest = np.concatenate([right, left])
    if not len(rest):
        return settled
    most = np.concatenate([np.minimum(high[right], BESIDE), high[left]])
    count = most - np.concatenate([low[right], np.maximum(low[left], BESIDE + 1)]) + 1
    # the windows of what is left; equal ones have equal contexts and equal bytes before the minimiser
    first = np.cumsum(count) - count
    step = np.arange(int(count.sum())) - np.repeat(first, count)
    begin = anchor[rest] - most
    place = np.repeat(offset[rest] + begin, count) + step
    context = np.concatenate([right_context, left_context + (right_context[-1] + 1 if len(right) else 0)])
    key = np.repeat(context * WINDOW + most, count) - step
    of = np.repeat(rest, count)
    order = np.argsort(key, kind="stable")
    index, bounds = deep_shallow_groups(data, place[order], owner[of[order]], runs(key[order]))
    index = order[index]
    gone = np.zeros(len(place), bool)
    if len(index):
        low = np.minimum.reduceat(owner[of[index]], bounds[:-1])
        gone[index] = owner[of[index]] > np.repeat(low, np.diff(bounds))
    hit = np.flatnonzero(gone)
    if not len(hit):
        return settled
    part = np.repeat(np.arange(len(rest)), count)[hit]
    new = np.ones(len(hit), bool)
    new[1:] = (hit[1:] != hit[:-1] + 1) | (part[1:] != part[:-1])
    a = np.flatnonzero(new)
    b = np.append(a[1:], len(hit)) - 1
    row = rows[of[hit[a]]]
    inside = hit[a] - first[part[a]] + begin[part[a]]
    out = np.zeros(len(a), RANGE)
    out["doc_id"], out["version"] = doc_ids[row["doc"]], versions[row["doc"]]
    out["begin"] = row["start"] + inside
    out["end"] = out["begin"] + (hit[b] - hit[a]) + WINDOW
    return np.concatenate([settled, out])


def common_minimisers(rows: DataFrame, total_bytes: int) -> np.ndarray:
    """Hashes of minimisers that hold more than a ``COMMON_SHARE``-th of the stretches looked at, ``MOST_COMMON`` at most."""
    share = max(16, total_bytes // LOOKED_AT)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for part in chunks([len(t) for t in texts], BATCH_BYTES):
                for at in range(0, max(1, len(texts[part.start]) if part.stop - part.start == 1 else 1), BATCH_BYTES):
                    own = [t[at : at + BATCH_BYTES] for t in texts[part]]
                    bounds = np.append(0, np.cumsum([len(t) for t in own]))
                    h, n = np.unique(stretches(np.frombuffer(b"".join(own), np.uint8), bounds)[3], return_counts=True)
                    often = n > 1
                    yield pa.RecordBatch.from_arrays([pa.array(np.append(h[often].view(np.int64), 0)), pa.array(np.append(n[often], 0)), pa.array(np.append(np.zeros(often.sum(), np.int64), n.sum()))], ["h", "n", "total"])

    looked = rows.filter(F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(share)) == 0).select("data").mapInArrow(count, "h long, n long, total long")
    counts = cut(looked.groupBy("h").agg(F.sum("n").alias("n"), F.sum("total").alias("total")), "minimisers")
    total = counts.agg(F.sum("total")).first()[0] or 0
    most = counts.filter(F.col("n") > max(64, total / COMMON_SHARE)).orderBy(F.desc("n"), "h").limit(MOST_COMMON).select("h").toArrow()
    return most["h"].to_numpy().astype(np.int64).view(np.uint64)


def repeated_ranges(rows: DataFrame, total_bytes: int) -> DataFrame:
    """``doc_id, version, ranges`` (array of begin, end; overlapping, in any order) from rows ``doc_id, version, data``."""
    buckets = max(64, math.ceil(total_bytes / BUCKET_BYTES))
    rows = rows.filter(F.col("doc_id").isNotNull() & (F.octet_length("data") >= WINDOW))
    common = common_minimisers(rows, total_bytes)

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Dealt] = []
        size, repeated = 0, Repeated()

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal size
            some: list[tuple[int, bytes]] = []
            for row in send(held, buckets):
                some.append(row)
                if len(some) == 32:
                    yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in some], pa.int32()), pa.array([x for _, x in some], pa.binary())], ["bucket", "blob"])
                    some = []
            if some:
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in some], pa.int32()), pa.array([x for _, x in some], pa.binary())], ["bucket", "blob"])
            held.clear()
            give_back()
            size = 0

        for batch in batches:
            doc_ids, versions = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            sizes = pa.compute.binary_length(batch.column(2)).to_pylist()
            for part in chunks(sizes, BATCH_BYTES):
                texts = batch.column(2).slice(part.start, part.stop - part.start).to_pylist()
                # a text beyond a batch goes in pieces that share WINDOW - 1 bytes
                step = BATCH_BYTES - WINDOW + 1
                long = len(texts) == 1 and len(texts[0]) > BATCH_BYTES
                for at in range(0, len(texts[0]) - WINDOW + 1, step) if long else (0,):
                    got = deal(doc_ids[part], versions[part], [texts[0][at : at + BATCH_BYTES]] if long else texts, buckets, at, repeated, common)
                    if got:
                        held.append(got)
                        size += len(got.payload)
                    if size >= SENT_BYTES:
                        yield from flush()
        if held:
            yield from flush()

    def settle(frame: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame(judge(frame.pop("blob").tolist()))
        give_back()
        return out

    dealt = rows.mapInArrow(cut_up, "bucket int, blob binary")
    found = dealt.groupBy("bucket").applyInPandas(settle, "doc_id long, version long, begin long, end long")
    return found.groupBy("doc_id", "version").agg(F.collect_list(F.struct("begin", "end")).alias("ranges"))


def merge_ranges(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs that ranges cover; ranges that touch are one run."""
    order = np.argsort(begin, kind="stable")
    begin, end = begin[order], np.maximum.accumulate(end[order])
    new = np.ones(len(begin), bool)
    new[1:] = begin[1:] > end[:-1]
    a = np.flatnonzero(new)
    return begin[a], end[np.append(a[1:], len(end)) - 1]


def with_ranges(docs: DataFrame, id_col: str, text_col: str, carry: list[str]) -> DataFrame:
    """``doc_id, size, small, ranges, missing, carry``: every text compressed, its ranges that go, whether it was null, and
    other columns as a struct of fields ``c0, c1, ...``, so that their names meet nothing here."""
    small_batches(docs.sparkSession)
    data = F.coalesce(F.encode(F.col(text_col).cast("string"), "UTF-8"), F.lit(b""))
    held = F.struct(F.col(text_col).isNull().alias("missing"), *[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(carry)])
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), data.alias("data"), held.alias("carry"))
    total = rows.agg(F.sum(F.octet_length("data").cast("long"))).first()[0] or 0
    repeated = rows.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1 and doc_id is not null").limit(1).count()
    # Texts that share an id are told apart by a hash; where ids are unique, as they should be, that costs nothing.
    rows = rows.withColumn("version", F.xxhash64("data") if repeated else F.lit(0).cast("long"))
    ranges = cut(repeated_ranges(rows.select("doc_id", "version", "data"), total), "repeated-ranges")
    release_shuffles(docs.sparkSession)

    def shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd", compression_level=LEVEL)
        for batch in batches:
            texts = batch.column(2).to_pylist()
            small = pa.array([codec.compress(t, asbytes=True) for t in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(list(map(len, texts)), pa.int64()), small, batch.column(3)], ["doc_id", "version", "size", "small", "carry"])

    shape = StructType.fromDDL("doc_id long, version long, size long, small binary").add("carry", rows.schema["carry"].dataType)
    texts = rows.select("doc_id", "version", "data", "carry").mapInArrow(shrink, shape)
    return texts.join(ranges, ["doc_id", "version"], "left").select("doc_id", "size", "small", "ranges", "carry")


def split(text: bytes, ranges: pa.Scalar) -> tuple[bytes, list[tuple[int, int]]]:
    """What stays of a text, and the maximal runs that go."""
    if not ranges.is_valid:
        return text, []
    begin, end = merge_ranges(ranges.values.field(0).to_numpy(), ranges.values.field(1).to_numpy())
    edges = [0, *np.column_stack([begin, end]).ravel().tolist(), len(text)]
    return b"".join(text[edges[k] : edges[k + 1]] for k in range(0, len(edges), 2)), list(zip(begin.tolist(), end.tolist(), strict=True))


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, spans array<struct<begin:long,end:long>>"


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", outputs: bool = True) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept, spans`` of every row; the last two are null without ``outputs``.

    A byte goes if a 50-byte string that covers it also starts in a document with a smaller id.  Defined results: a
    null text is empty; rows with a null id lose nothing and make nobody lose; rows that share an id do not count
    against each other; texts shorter than 50 bytes stay; an empty table gives no rows; other columns are ignored.
    """
    schema = to_arrow_schema(StructType.fromDDL(RESULT))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, size, small, own in zip(*(batch.column(k).to_pylist() for k in range(3)), batch.column(3), strict=True):
                kept, spans = split(pa.decompress(small, size, codec="zstd", asbytes=True), own)
                shown = [{"begin": a, "end": b} for a, b in spans] if outputs else None
                out.append((doc_id, size, size - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), kept if outputs else None, shown))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return with_ranges(docs, id_col, text_col, []).mapInArrow(finish, RESULT)


def strip_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """``docs``, all columns, with repeated bytes taken out of the text and the number of characters brought up to date.

    Characters that lose some of their bytes go whole.  A row whose text goes whole is left out; rows that lose nothing
    keep text and number as they are, also null.
    """
    schema = StructType([f for f in docs.schema])
    carry = [c for c in docs.columns if c != text_col]

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, stays, changed = [], [], []
            for size, small, own in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
                text, spans = split(pa.decompress(small, size, codec="zstd", asbytes=True), own)
                kept.append(text.decode("utf-8", "ignore"))
                changed.append(bool(spans))
                stays.append(not spans or bool(kept[-1]))
            held = dict(zip(["", *carry], batch.column(4).flatten(), strict=True))
            missing = held.pop("").to_pylist()
            columns = []
            for f in schema.fields:
                if f.name == text_col:
                    columns.append(pa.array([None if n else t for t, n in zip(kept, missing, strict=True)], pa.string()))
                elif f.name == chars_col:
                    old = held[chars_col]
                    columns.append(pa.array([len(t) if c else o for t, c, o in zip(kept, changed, old.to_pylist(), strict=True)], old.type))
                else:
                    columns.append(held[f.name])
            yield pa.RecordBatch.from_arrays(columns, names).filter(pa.array(stays, pa.bool_()))

    names = [f.name for f in schema.fields]
    return with_ranges(docs, id_col, text_col, carry).mapInArrow(finish, schema)
