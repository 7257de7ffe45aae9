"""Exact repeated byte strings by suffix arrays built per shard and merged across shards.

Every ``window``-byte string that starts in two places is found, and the bytes under it are marked. A shard is a chunk of
whole texts.

1. Copies. Texts that occur more than once, by their 128-bit digests, are repeated throughout; one of each goes on.
2. Candidates, lossless. The least of the hashes of the ``gram``-byte strings inside a window is the window's anchor;
   equal windows have equal anchors at equal offsets. Neighbouring windows of one anchor are a segment (about 85
   windows). An exchange of the anchors' names tells which occur in two places of the corpus; only windows over those go
   on. Segments that several shards hold whole are known to be repeated, and only the first of these shards goes on with
   them.
3. Suffix arrays. The candidates of a shard are sorted by Larsson-Sadakane refinement in numpy (ranks by 8 bytes, doubled
   until the order is settled to the window's length), and Kasai's recurrence, run in lockstep over blocks of windows,
   gives the common prefixes of neighbours. That finds the repeats inside the shard.
4. Merge. Each shard deals its different windows, as sorted 96-bit digests, to buckets of digests; there the
   lists are merged, each shard's is found in the merged one by binary search, and each shard learns which of its windows others hold as well. (The
   lists of whole segments under 2 are merged likewise, by sorting.)

``law`` "all" marks every such string; "first" leaves its first occurrence (least doc_id, then least place in the input,
then least place in the text) and marks those that start behind it and don't overlap it.

Messages go out once per shard, so copies, however many, are summed before an exchange. A shard has 1 MB, and more where
there are over 512 buckets (spark.sql.shuffle.partitions), so that the rows of messages follow the data alone.

Defined cases: null or empty text: 0 bytes, nothing removed, the digest of no bytes; texts under ``window`` bytes:
nothing removed; a text longer than ``chunk_bytes``: a shard of its own, in one task, some 100 bytes of memory for each
of its candidate bytes; repeated rows: documents of their own, which repeat each other; ties of doc_id: ordered by
place; null doc_id: kept, behind all others; empty table: no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MESSAGE, MESSAGE_ARROW, answered, bits_of, chunk_rows, chunk_size, ids_out, mix, name_messages, pack, partitions, plain, reply_map, shared_names, shared_table, split_by_bucket, tidy, to_batch, unpack, with_replies

_TABLES = np.random.default_rng(11).integers(1, 2**63, (2, 256), dtype=np.uint64) | np.uint64(1)
_STEPS = np.random.default_rng(12).integers(1, 2**63, (2, 64), dtype=np.uint64) | np.uint64(1)
_PLACE = 26  # low bits of a key that hold the place; the same at every size, so ties break alike everywhere
NAMES, TEXTS, SEGMENTS, WINDOWS, RUNS, LOCAL, KNOWN, WHOLE = range(8)  # kinds of messages and of what a shard keeps


def gram_hashes(data: np.ndarray, gram: int, family: int = 0) -> np.ndarray:
    """A hash of the ``gram`` bytes (a power of two) at each place, by doubling."""
    h, m, level = _TABLES[family][data], 1, 0
    while m < gram:
        h = h[:-m] * _STEPS[family][level] + h[m:]
        h ^= h >> np.uint64(31)
        m, level = 2 * m, level + 1
    return mix(h)


def window_digests(text: np.ndarray, at: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """64 and 32 bits of the ``window`` bytes at each place: two hashes of its first and last 2^k bytes."""
    gram = 1 << (window.bit_length() - 1)
    out = []
    for family in range(2):
        h = gram_hashes(text, gram, family)
        out.append(mix(h[at] * _STEPS[family][60] + h[at + (window - gram)]))
    return out[0], (out[1] >> np.uint64(32)).astype(np.uint32)


def distinct(lo: np.ndarray, hi: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of one of each different digest, by bucket and digest; the number of each digest in that order)."""
    order = np.argsort(lo)
    a, b = lo[order], hi[order]
    if ((a[1:] == a[:-1]) & (b[1:] != b[:-1])).any():  # 64 bits don't tell two windows apart
        order = np.lexsort((hi, lo))
        a, b = lo[order], hi[order]
    new = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
    pick = order[new]
    rank = np.argsort(lo[pick] % np.uint64(n), kind="stable")
    back = np.empty(len(rank), np.int64)
    back[rank] = np.arange(len(rank))
    number = np.empty(len(lo), np.int64)
    number[order] = back[np.cumsum(new) - 1]
    return pick[rank], number


def spread(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The places of runs that begin at ``first`` and are ``count`` long."""
    return np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum())


def segments(data: np.ndarray, offs: np.ndarray, window: int, gram: int, block: int = 1 << 20):
    """(first window, last window, name of the anchor) of every segment."""
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64))]
    low = np.uint64((1 << _PLACE) - 1)
    for s in range(0, max(0, len(data) - window + 1), block):
        part = data[s : s + block + window - 1]
        h = gram_hashes(part, gram)
        key = (h & ~low) | np.arange(len(h), dtype=np.uint64)
        span, m = window - gram + 1, 1
        while 2 * m <= span:
            key = np.minimum(key[:-m], key[m:])
            m *= 2
        if span > m:
            key = np.minimum(key[: len(key) - (span - m)], key[span - m :])
        at = (key & low).astype(np.int64)
        start = np.arange(s, s + len(at))
        doc = np.searchsorted(offs, start[[0, -1]], side="right")
        own = offs[doc[0] - 1 : doc[1] + 1]
        end = np.repeat(own[1:], np.diff(np.clip(own, s, s + len(at))))
        v = np.flatnonzero(start + window <= end)
        if len(v):
            cut = np.flatnonzero((np.diff(v) > 1) | (np.diff(at[v]) != 0))
            first, last = v[np.concatenate(([0], cut + 1))], v[np.append(cut, len(v) - 1)]
            out.append((start[first], start[last], h[at[first]]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def suffix_array(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes sorted by their first ``depth`` bytes at least, the 8-byte word at each place): Larsson-Sadakane."""
    n = len(text)
    padded = np.concatenate((text, np.zeros(16, np.uint8)))
    word = np.zeros(n, np.uint64)
    for k in range(8):
        word = word << np.uint64(8) | padded[k : n + k].astype(np.uint64)
    sa = np.argsort(word).astype(np.int64)
    ranked = word[sa]
    fresh = np.concatenate(([True], ranked[1:] != ranked[:-1]))
    rank = np.full(n + depth + 256, -1, np.int64)  # -1: behind the text
    rank[sa] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    open_ = np.flatnonzero(~fresh | ~np.append(fresh[1:], True))  # places in sa of groups that are not settled
    h = 8
    while h < depth and len(open_):
        own = sa[open_]
        key = (rank[own].astype(np.uint64) << np.uint64(32)) | (rank[own + h] + 1).astype(np.uint64)
        order = np.argsort(key)
        own, key = own[order], key[order]
        fresh = np.concatenate(([True], key[1:] != key[:-1]))
        sa[open_] = own
        rank[own] = np.maximum.accumulate(np.where(fresh, open_, 0))
        open_ = open_[~fresh | ~np.append(fresh[1:], True)]
        h *= 2
    return sa, word


def common_prefixes(words: np.ndarray, before: np.ndarray, nth: np.ndarray, first: np.ndarray, count: np.ndarray, most: int) -> np.ndarray:
    """Kasai's recurrence in lockstep: common prefix (up to ``most``) of each valid place and the one sorted before it.

    ``words``: the 8 bytes at each place, the first highest; nth: each place's number in the sorted order, -1 if it
    isn't valid; first, count: the valid places of each block. The length found at a place, less one, holds for the
    next place only if the neighbour's next place is sorted before it, which ties beyond the sorted depth can prevent.
    """
    lcp = np.zeros(len(words), np.int64)
    h, last = np.zeros(len(first), np.int64), np.full(len(first), -2)
    live = np.arange(len(first))
    step = 0
    while True:
        live = live[count[live] > step]
        if not len(live):
            return lcp
        p = first[live] + step
        q = before[p]
        carry = (last[live] >= 0) & (last[live] + 1 < len(nth))
        follow = nth[last[live][carry] + 1]
        carry[carry] = (follow >= 0) & (follow < nth[p[carry]])
        h[live] = np.where(carry & (q >= 0), np.maximum(h[live] - 1, 0), 0)
        go = np.flatnonzero(q >= 0)
        while len(go):
            i = live[go]
            x = words[p[go] + h[i]] ^ words[q[go] + h[i]]
            full = x == 0
            x |= x >> np.uint64(1)
            for s in (2, 4, 8, 16, 32):
                x |= x >> np.uint64(s)
            h[i] = np.minimum(h[i] + np.where(full, 8, (64 - np.bitwise_count(x).astype(np.int64)) >> 3), most)
            go = go[full & (h[i] < most)]
        lcp[p] = h[live]
        last[live] = q
        step += 1


def shared_windows(text: np.ndarray, lens: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Mask of the valid places whose window starts at another valid place too, and a class number of every valid place."""
    end = np.cumsum(lens)
    begin = end - lens
    valid = np.ones(len(text), bool)
    for k in range(1, window):
        valid[end - k] = False
    sa, word = suffix_array(text, window)
    order = sa[valid[sa]]
    before = np.full(len(text), -1)
    before[order[1:]] = order[:-1]
    nth = np.full(len(text), -1)
    nth[order] = np.arange(len(order))
    words = np.concatenate((word, np.zeros(window + 8, np.uint64)))
    starts = lens - window + 1  # of a run; blocks of them go in lockstep
    blocks = -(-starts // 64)
    nth_block = np.arange(blocks.sum()) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    first = np.repeat(begin, blocks) + 64 * nth_block
    lcp = common_prefixes(words, before, nth, first, np.minimum(64, np.repeat(starts, blocks) - 64 * nth_block), window)
    same = lcp[order] >= window
    repeated = np.zeros(len(text), bool)
    repeated[order] = same | np.append(same[1:], False)
    number = np.full(len(text), -1)
    number[order] = np.cumsum(~same)
    return repeated & valid, number


def _runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.diff(np.concatenate(([0], mask.view(np.int8), [0]))))
    return edge[::2], edge[1::2] - 1


class Shard:
    """A packed chunk: its texts that go on, and their segments."""

    def __init__(self, row: dict, window: int, gram: int):
        self.ids, self.id_null, self.offs, self.data = unpack(row)
        self.window, self.gram = window, gram

    def texts(self):
        """The different long texts: (first document of each, digests, whether there are more inside the shard)."""
        lens = np.diff(self.offs)
        long = np.flatnonzero(lens >= self.window)
        raw, f = self.data.tobytes(), xxhash.xxh3_128_digest
        d = np.frombuffer(b"".join([f(raw[a:b]) for a, b in zip(self.offs[long].tolist(), self.offs[long + 1].tolist(), strict=True)]), np.uint64).reshape(-1, 2)
        order = np.lexsort((long, self.ids[long], d[:, 1], d[:, 0]))
        new = np.concatenate(([True], (d[order][1:] != d[order][:-1]).any(axis=1))) if len(long) else np.zeros(0, bool)
        size = np.diff(np.append(np.flatnonzero(new), len(order)))
        first = order[new]
        text_of = np.empty(len(long), np.int64)
        text_of[order] = np.cumsum(new) - 1
        return long, text_of, long[first], d[first, 0], d[first, 1], size > 1

    def text_messages(self, chunk: int, n: int):
        _, _, first, lo, hi, more = self.texts()
        yield from digest_messages(lo, hi, more, self.ids[first], chunk, TEXTS, n)

    def cut(self, got: dict, n: int, law: str) -> None:
        """Sort out which texts go on and which are repeated throughout, and cut the former into segments."""
        long, text_of, first, lo, _, more = self.texts()
        said = replies_of(got, TEXTS, lo, n)
        self.whole = np.zeros(len(self.ids), bool)
        if law == "all":
            self.whole[long] = (more | (said > 0))[text_of]
        else:
            self.whole[long] = True
            self.whole[first[said < 2]] = False
        self.own = np.sort(first[said < 2])
        lens = np.diff(self.offs)[self.own]
        self.at = np.concatenate((np.zeros(1, np.int64), np.cumsum(lens)))
        self.text = self.data[spread(self.offs[self.own], lens)]
        self.first, self.last, name = segments(self.text, self.at, self.window, self.gram)
        self.names, self.name_of = np.unique(name >> np.uint64(17), return_inverse=True)
        self.more = np.bincount(self.name_of, minlength=len(self.names)) > 1
        raw, f = self.text.tobytes(), xxhash.xxh3_128_digest
        d = np.frombuffer(b"".join([f(raw[a:b]) for a, b in zip(self.first.tolist(), (self.last + self.window).tolist(), strict=True)]), np.uint64).reshape(-1, 2)
        self.owner = self.ids[self.own[np.searchsorted(self.at, self.first, side="right") - 1]]
        order = np.lexsort((self.owner, d[:, 1], d[:, 0]))
        new = np.concatenate(([True], (d[order][1:] != d[order][:-1]).any(axis=1))) if len(d) else np.zeros(0, bool)
        self.kinds = order[new]  # of each different segment the one with the least id
        self.lo, self.hi = d[self.kinds, 0], d[self.kinds, 1]
        self.kind_of = np.empty(len(order), np.int64)
        self.kind_of[order] = np.cumsum(new) - 1

    def segment_messages(self, chunk: int, n: int, law: str):
        yield from name_messages(self.names, self.more, chunk, NAMES, n)
        yield from digest_messages(self.lo, self.hi >> np.uint64(32), None, self.owner[self.kinds] if law == "first" else None, chunk, SEGMENTS, n)

    def search(self, got: dict, chunk: int, n: int, law: str):
        """Messages about the different candidate windows, and what the shard keeps (for bucket chunk % n)."""
        keep = lambda kind, *parts: (chunk % n, chunk, kind, b"".join(x.tobytes() for x in parts), b"", b"")
        yield keep(WHOLE, np.packbits(self.whole))
        said = replies_of(got, SEGMENTS, self.lo, n)[self.kind_of]
        origin = self.first + (self.offs[self.own] - self.at[:-1])[np.searchsorted(self.at, self.first, side="right") - 1] if len(self.first) else self.first
        known = said > 0 if law == "all" else said == 2
        yield keep(KNOWN, origin[known], (self.last - self.first + 1)[known])
        pick = bits_of(got, NAMES, self.names, n)[self.name_of] & (said < 2)
        first, last = self.first[pick], self.last[pick]
        if not len(first):
            return
        new = np.concatenate(([True], first[1:] != last[:-1] + 1))  # windows side by side are of one text
        a, b = first[new], last[np.append(np.flatnonzero(new)[1:] - 1, len(last) - 1)]
        starts, lens = b - a + 1, b - a + self.window
        text = self.text[spread(a, lens)]
        repeated, number = shared_windows(text, lens, self.window)
        valid = np.flatnonzero(number >= 0)
        number = number[valid] - number[valid].min()
        doc = np.searchsorted(self.at, a, side="right") - 1
        lo, hi = window_digests(text, valid, self.window)
        one, _ = distinct(lo, hi, n)
        ids = None
        if law == "all":
            local = repeated[valid]
        else:
            place, own = spread(a, starts), np.repeat(self.own[doc], starts)
            order = np.lexsort((place, self.ids[own], number))
            least = order[np.concatenate(([True], np.diff(number[order]) > 0))][number]  # the first occurrence of each window
            local = (own[least] != own) | (place >= place[least] + self.window)
            ids = self.ids[own[least[one]]]
        yield keep(RUNS, origin[pick][new], starts)
        yield keep(LOCAL, np.packbits(local))
        z = zstandard.ZstdCompressor(level=1)
        for k, i in split_by_bucket((lo[one] % np.uint64(n)).astype(np.int64), n):
            yield k, chunk, WINDOWS, lo[one[i]].tobytes(), hi[one[i]].tobytes(), b"" if ids is None else z.compress(ids[i].tobytes())


def digest_messages(lo, hi, inside, ids, chunk: int, kind: int, n: int):
    """Messages about different digests: p2 holds a flag each behind the second halves, p3 the least id, if that counts."""
    hi = hi.astype(np.uint32) if kind == SEGMENTS else hi
    inside = np.zeros(len(lo), bool) if inside is None else inside
    for k, i in split_by_bucket((lo % np.uint64(n)).astype(np.int64), n):
        yield k, chunk, kind, lo[i].tobytes(), hi[i].tobytes() + inside[i].tobytes(), b"" if ids is None else ids[i].tobytes()


def replies_of(got: dict, kind: int, lo: np.ndarray, n: int) -> np.ndarray:
    said = np.zeros(len(lo), np.uint8)
    for k, i in split_by_bucket((lo % np.uint64(n)).astype(np.int64), n):
        said[i] = np.frombuffer(got[kind, k], np.uint8)
    return said


def _about_digests(half):
    """0: one shard has it; 1: several (or one, more than once), and this is the first; 2: the first is another."""

    def reducer(rows: list[dict]) -> list[bytes]:
        size, wide = [len(r["p1"]) // 8 for r in rows], np.dtype(half).itemsize
        lo = np.concatenate([np.frombuffer(r["p1"], np.uint64) for r in rows])
        hi = np.concatenate([np.frombuffer(r["p2"], half, n) for r, n in zip(rows, size, strict=True)])
        inside = np.concatenate([np.frombuffer(r["p2"], np.uint8, n, wide * n) for r, n in zip(rows, size, strict=True)])
        ids = np.concatenate([np.frombuffer(r["p3"], np.int64) if r["p3"] else np.zeros(n, np.int64) for r, n in zip(rows, size, strict=True)])
        order = np.lexsort((np.repeat([r["chunk"] for r in rows], size), ids, hi, lo))
        start = np.flatnonzero(np.concatenate(([True], (np.diff(lo[order]) != 0) | (np.diff(hi[order]) != 0))))
        several = np.diff(np.append(start, len(lo))) > 1
        said = np.repeat(np.where(several, 2, 0).astype(np.uint8), np.diff(np.append(start, len(lo))))
        said[start] = several | (inside[order[start]] > 0)
        out = np.empty(len(lo), np.uint8)
        out[order] = said
        return [x.tobytes() for x in np.split(out, np.cumsum(size)[:-1])]

    return reducer


def merge_lists(keys: list[np.ndarray], ids: list[np.ndarray], chunks: list[int]):
    """(merged keys, shards that hold each, least (id, chunk) of them, places of each list): by binary search of each
    shard's sorted list in the merged one."""
    merged = np.unique(np.concatenate(keys))
    shards, least, chunk = np.zeros(len(merged), np.int32), np.full(len(merged), np.iinfo(np.int64).max), np.full(len(merged), np.iinfo(np.int64).max)
    places = []
    for k, i, c in zip(keys, ids, chunks, strict=True):
        at = np.searchsorted(merged, k)
        shards[at] += 1  # a shard has each key once
        before = (i < least[at]) | ((i == least[at]) & (c < chunk[at]))
        least[at[before]], chunk[at[before]] = i[before], c
        places.append(at)
    return merged, shards, least, chunk, places


def _about_windows(law: str):
    """A bit for each window of each shard: whether another shard holds it (law "first": and comes first)."""

    def reducer(rows: list[dict]) -> list[bytes]:
        z = zstandard.ZstdDecompressor()
        keys, tags = ([np.frombuffer(r[c], t) for r in rows] for c, t in (("p1", np.uint64), ("p2", np.uint32)))
        ids = [np.frombuffer(z.decompress(r["p3"]), np.int64) if law == "first" else np.zeros(len(k), np.int64) for r, k in zip(rows, keys, strict=True)]
        chunks = [r["chunk"] for r in rows]
        merged, shards, least, chunk, places = merge_lists(keys, ids, chunks)
        tag = np.zeros(len(merged), np.uint32)
        for t, at in zip(tags, places, strict=True):
            tag[at] = t
        if any((tag[at] != t).any() or len(at) != len(np.unique(at)) for t, at in zip(tags, places, strict=True)):  # two windows share 64 bits: number the 96-bit digests instead
            both = np.concatenate([np.rec.fromarrays((k, t)) for k, t in zip(keys, tags, strict=True)])
            keys = np.split(np.unique(both, return_inverse=True)[1].astype(np.uint64), np.cumsum([len(k) for k in keys])[:-1])
            merged, shards, least, chunk, places = merge_lists(keys, ids, chunks)
        return [np.packbits(shards[at] > 1 if law == "all" else (least[at] != i) | (chunk[at] != c)).tobytes() for at, i, c in zip(places, ids, chunks, strict=True)]

    return reducer


def repeats(docs: DataFrame, window: int = 200, gram: int = 32, law: str = "all", chunk_bytes: int | None = None, with_text: bool = False, keep: tuple[str, ...] = (), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, by_copy, by_shard, by_merge, spans[, kept_text], *keep) of every row.

    by_copy, by_shard, by_merge: the removed bytes that copies show, of the others those that the shard's own suffix array
    shows, and those that only the merge shows. kept_text: what remains as text; bytes of a character that was cut through
    are left out of it.
    """
    if law not in ("all", "first"):
        raise ValueError("law is all or first")
    spark = docs.sparkSession
    n = partitions(spark)
    packed = shared_table(pack(plain(docs, id_col, text_col, keep), chunk_bytes or chunk_size(n)), "packed", (n, "chunk"))
    columns = ["chunk", "ids", "id_null", "lens", "blob"]

    def tell_texts(batches):
        for row in chunk_rows(batches, columns):
            yield to_batch(list(Shard(row, window, gram).text_messages(row["chunk"], n)), MESSAGE_ARROW)

    texts = shared_table(answered(packed.select(*columns).mapInArrow(tidy(tell_texts), MESSAGE), {TEXTS: _about_digests(np.uint64)}, n), "texts")

    def tell_segments(batches):
        for row in chunk_rows(batches, [*columns, "replies"]):
            s = Shard(row, window, gram)
            s.cut(reply_map(row), n, law)
            yield to_batch(list(s.segment_messages(row["chunk"], n, law)), MESSAGE_ARROW)

    told = answered(with_replies(packed, texts).select(*columns, "replies").mapInArrow(tidy(tell_segments), MESSAGE), {NAMES: shared_names, SEGMENTS: _about_digests(np.uint32)}, n)

    def search(batches):
        for row in chunk_rows(batches, [*columns, "replies"]):
            s, got = Shard(row, window, gram), reply_map(row)
            s.cut(got, n, law)
            yield to_batch(list(s.search(got, row["chunk"], n, law)), MESSAGE_ARROW)

    found = with_replies(packed, texts.unionAll(told)).select(*columns, "replies").mapInArrow(tidy(search), MESSAGE)
    known = answered(found, {WINDOWS: _about_windows(law)}, n, keep=(RUNS, LOCAL, KNOWN, WHOLE))

    rest = ["rest"] if keep else []

    def finish(batches):
        for row in chunk_rows(batches, [*columns, *rest, "replies"]):
            ids, null, offs, data = unpack(row)
            got = reply_map(row)
            masks = np.zeros((3, len(data)), bool)

            def cover(mask, at):
                edge = np.bincount(at, minlength=len(data) + 1) - np.bincount(at + window, minlength=len(data) + 1)
                mask |= np.cumsum(edge[:-1]) > 0

            whole = np.unpackbits(np.frombuffer(got[WHOLE, -1], np.uint8), count=len(ids)).astype(bool)
            masks[0] = np.repeat(whole, np.diff(offs))
            first, count = np.frombuffer(got[KNOWN, -1], np.int64).reshape(2, -1)
            cover(masks[2], spread(first, count))
            if (RUNS, -1) in got:
                first, count = np.frombuffer(got[RUNS, -1], np.int64).reshape(2, -1)
                local = np.unpackbits(np.frombuffer(got[LOCAL, -1], np.uint8), count=count.sum()).astype(bool)
                place = spread(first, count)
                cover(masks[1], place[local])
                lens = count + (window - 1)
                lo, hi = window_digests(data[spread(first, lens)], spread(np.cumsum(lens) - lens, count), window)
                one, number = distinct(lo, hi, n)
                bits = np.zeros(len(one), bool)
                for k, i in split_by_bucket((lo[one] % np.uint64(n)).astype(np.int64), n):
                    bits[i] = np.unpackbits(np.frombuffer(got[WINDOWS, k], np.uint8), count=len(i)).astype(bool)
                cover(masks[2], place[bits[number]])
            masks[1] &= ~masks[0]
            masks[2] &= ~(masks[0] | masks[1])
            gone = masks.any(axis=0)
            cols: list[list] = [[] for _ in range(9)]
            for i in range(len(ids)):
                own, cut = data[offs[i] : offs[i + 1]], gone[offs[i] : offs[i + 1]]
                a, b = _runs(cut)
                kept = own[~cut].tobytes() if len(a) else own.tobytes()
                text = b"".join(own[x:y].tobytes().decode(errors="ignore").encode() for x, y in zip(np.append(0, b + 1), np.append(a, len(own)), strict=True)).decode() if with_text else None
                spans = [{"start": x, "length": y - x + 1} for x, y in zip(a.tolist(), b.tolist(), strict=True)]
                by = masks[:, offs[i] : offs[i + 1]].sum(axis=1).tolist()
                for c, v in zip(cols, (len(own), int(cut.sum()), len(a), hashlib.sha256(kept).hexdigest(), *by, spans, text), strict=True):
                    c.append(v)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())])), pa.string()]
            names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "by_copy", "by_shard", "by_merge", "spans", "kept_text"]
            take = 9 if with_text else 8
            own = pa.ipc.open_stream(row["rest"]).read_all().combine_chunks().to_batches()[0].columns if keep else []
            yield pa.RecordBatch.from_arrays([ids_out(ids, null), *(pa.array(c, k) for c, k in zip(cols[:take], kinds[:take], strict=True)), *own], names=["doc_id", *names[:take], *keep])

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, by_copy long, by_shard long, by_merge long, spans array<struct<start:long,length:long>>" + ", kept_text string" * with_text
    schema += "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return with_replies(packed, known).select(*columns, *rest, "replies").mapInArrow(tidy(finish), schema)
