"""Repeated passages by recompression: windows of words that an earlier document holds too.

Each document is a sequence of words, and maximal runs (word, length) of them are its first symbols. Then come rounds.
In each, symbols are split into left and right ones by a bit of a hash, and a left symbol followed by a right one becomes
a pair. A round of exchange through Spark names what is new, runs and pairs, for the whole corpus: a bucket sees every
run or pair that falls to it, and numbers those that two documents hold; the others get no number, and no pair with such
a symbol is named any more. Whether two neighbours merge depends on the two alone, so inside two equal windows all symbols are
equal but for those that touch what touched the border before (``Symbols.inner``).

1. Reveal. A window can repeat only if every symbol inside it, at every level, is one that two documents share. Level by
   level symbols get longer, and fewer windows are left. Windows too short in runs to hold a symbol stay candidates.
2. Verify. Candidates are compared by 128-bit digests (96 bits are sent) of their words themselves; an exchange gives
   the smallest doc_id of each. A window goes if that is smaller than its own document's.

All exchanges carry what a chunk knows, with copies inside it summed up. Runs and pairs are told apart by 47 bits of hash;
two that collide share a name, which only adds candidates.

Defined cases: null, empty or white text: no words, the digest of no bytes; fewer words than a window: nothing removed;
a text longer than ``chunk_bytes``: a chunk of its own, in one task; repeated rows and ties of ids: neither is smaller, so
neither loses words to the other; null doc_id: behind all ids; empty table: no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame

from .common import MESSAGE, MESSAGE_ARROW, Words, answered, chunk_rows, chunk_size, ids_out, mix, name_messages, pack, partitions, plain, reply_map, shared_table, split_by_bucket, tidy, to_batch, unpack, with_replies

_RUN, _LEFT, _RIGHT, _LEVEL = (np.uint64(x) for x in np.random.default_rng(23).integers(1, 2**63, 4, dtype=np.uint64) | np.uint64(1))
DIGEST, CANDIDATES, TEXTS, LOCAL, COUNTS = 0, -1, -2, -3, -4  # kinds of messages about windows and of what a chunk keeps; those about names have their level


def windows(doc: np.ndarray, window: int) -> np.ndarray:
    """The first word of each window, given the document of each word."""
    return np.flatnonzero(doc[: max(0, len(doc) - window + 1)] == doc[window - 1 :]) if len(doc) >= window else np.zeros(0, np.int64)


class Symbols:
    """The symbols of a chunk's words at one level, and the symbols inside each window.

    ``name`` is 0 where no other document has the symbol; ``inner``: first and last symbol of each window that are the
    same in every equal window.
    """

    def __init__(self, words: Words, window: int):
        w, doc = words.hash, words.doc
        self.level = 0
        self.window = windows(doc, window)
        new_run = np.concatenate(([True], (w[1:] != w[:-1]) | (doc[1:] != doc[:-1]))) if len(w) else np.zeros(0, bool)
        run = np.cumsum(new_run) - 1
        head = np.flatnonzero(new_run)
        self.length = np.diff(np.append(head, len(w)))
        self.name, self.doc = mix(w[head] + _RUN * self.length.astype(np.uint64)) | np.uint64(1), doc[head]
        self.inner = run[self.window] + 1, run[self.window + window - 1] - 1
        self.candidate = np.ones(len(self.window), bool)

    def pair(self) -> None:
        """Make the next level's symbols; those that are new have a ``key`` and wait for their names."""
        self.level += 1
        left = (mix(self.name + _LEVEL * np.uint64(self.level)) >> np.uint64(17) & np.uint64(1)).astype(bool)
        second = np.concatenate(([False], left[:-1] & ~left[1:] & (self.doc[1:] == self.doc[:-1])))[: len(left)]
        first = np.flatnonzero(~second)
        paired = np.append(second, False)[first + 1]
        own, next_ = self.name[first], self.name[np.minimum(first + 1, len(self.name) - 1)]
        new = paired | (self.length[first] > 1) if self.level == 1 else paired  # a long run that stays alone is named now
        self.key = np.where(paired, mix(own * _LEFT + next_ * _RIGHT), mix(own)) >> np.uint64(17)
        self.lost = new & ((own == 0) | (paired & (next_ == 0)))
        self.waits = new & ~self.lost
        symbol = np.cumsum(~second) - 1
        a, b = self.inner
        held = a <= b
        self.inner = np.where(held, symbol[np.minimum(a, len(symbol) - 1)] + 1, 1), np.where(held, symbol[np.maximum(b, 0)] - 1, 0)
        self.name, self.doc = own, self.doc[first]

    def items(self) -> tuple[np.ndarray, np.ndarray]:
        """The different keys that wait for names, and whether two documents of the chunk have each."""
        keys, self.key_of = np.unique(self.key[self.waits], return_inverse=True)
        low, top = np.full(len(keys), np.iinfo(np.int32).max), np.full(len(keys), -1)
        np.minimum.at(low, self.key_of, self.doc[self.waits])
        np.maximum.at(top, self.key_of, self.doc[self.waits])
        return keys, top > low

    def rename(self, numbers: np.ndarray) -> None:
        """Take the numbers of :meth:`items`, 0 for what only one document has, and drop windows with such a symbol inside."""
        level = np.uint64(self.level << 56)
        self.name[self.waits] = np.where(numbers == 0, np.uint64(0), numbers | level)[self.key_of]
        self.name[self.lost] = 0
        a, b = self.inner
        alone = np.concatenate((np.zeros(1, np.int64), np.cumsum(self.name == 0)))
        held = a <= b
        self.candidate &= ~held | (alone[np.where(held, b + 1, 0)] == alone[np.where(held, a, 0)])


class _Chunk:
    def __init__(self, row: dict, window: int):
        self.ids, self.id_null, self.offs, data = unpack(row)
        self.w, self.window = Words(data, self.offs), window
        self.s = Symbols(self.w, window)

    def climb(self, got: dict, levels: int, n: int) -> None:
        """To the given level, by the names in ``got``."""
        for _ in range(levels):
            self.s.pair()
            keys, _ = self.s.items()
            numbers = np.zeros(len(keys), np.uint64)
            for k, i in split_by_bucket((keys % np.uint64(n)).astype(np.int64), n):
                wide = np.zeros((len(i), 8), np.uint8)
                wide[:, :6] = np.frombuffer(got[self.s.level, k], np.uint8).reshape(-1, 6)
                numbers[i] = wide.view("<u8")[:, 0]
            self.s.rename(numbers)

    def names(self, chunk: int, n: int):
        self.s.pair()
        yield from name_messages(*self.s.items(), chunk, self.s.level, n)

    def verify(self, n: int) -> None:
        """Candidates, their digests by bucket, and the smallest id that this chunk knows for each."""
        self.at = self.s.window[self.s.candidate]
        raw, f = self.w.bytes.tobytes(), xxhash.xxh3_128_digest
        last = self.at + self.window - 1
        d = np.frombuffer(b"".join([f(raw[i:j]) for i, j in zip(self.w.at[self.at].tolist(), (self.w.at[last] + self.w.length[last]).tolist(), strict=True)]), np.uint64).reshape(-1, 2)
        lo, hi, own = d[:, 0], d[:, 1] >> np.uint64(32), self.ids[self.w.doc[self.at]]
        order = np.lexsort((own, hi, lo))
        new = np.concatenate(([True], (lo[order][1:] != lo[order][:-1]) | (hi[order][1:] != hi[order][:-1]))) if len(lo) else np.zeros(0, bool)
        pick = order[new]
        rank = np.lexsort((lo[pick], own[pick], lo[pick] % np.uint64(n)))  # by id in a bucket: ids then compress well
        self.lo, self.hi, self.least = lo[pick][rank], hi[pick][rank], own[pick][rank]
        back = np.empty(len(rank), np.int64)
        back[rank] = np.arange(len(rank))
        self.text_of = np.empty(len(order), np.int64)
        self.text_of[order] = back[np.cumsum(new) - 1]
        self.own = own

    def digests(self, chunk: int, n: int):
        """Messages about candidates, and what the last pass needs of them (for bucket chunk % n)."""
        z, bucket = zstandard.ZstdCompressor(level=1), (self.lo % np.uint64(n)).astype(np.int64)
        for k, i in split_by_bucket(bucket, n):
            yield k, chunk, DIGEST, self.lo[i].tobytes(), self.hi[i].astype(np.uint32).tobytes(), z.compress(self.least[i].tobytes())
        local = self.own > self.least[self.text_of]
        for kind, x in ((CANDIDATES, np.packbits(self.s.candidate)), (TEXTS, self.text_of.astype(np.int32)), (LOCAL, np.packbits(local)), (COUNTS, np.bincount(bucket, minlength=n))):
            yield chunk % n, chunk, kind, z.compress(x.tobytes()), b"", b""


def removed(w: Words, window: int, got: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mask of the words to remove, all windows, the candidates) of a chunk's words by what was kept and replied."""
    z = zstandard.ZstdDecompressor()
    read = lambda kind, t: np.frombuffer(z.decompress(got[kind, -1]), t)
    all_ = windows(w.doc, window)
    at = all_[np.unpackbits(read(CANDIDATES, np.uint8), count=len(all_)).astype(bool)]
    counts = read(COUNTS, np.int64).tolist()
    smaller = np.concatenate([np.zeros(0, np.uint8), *(np.unpackbits(np.frombuffer(got[DIGEST, k], np.uint8), count=c) for k, c in enumerate(counts) if c)])
    out = at[(smaller[read(TEXTS, np.int32)] | np.unpackbits(read(LOCAL, np.uint8), count=len(at))).astype(bool)]
    edge = np.bincount(out, minlength=len(w.doc) + 1) - np.bincount(out + window, minlength=len(w.doc) + 1)[: len(w.doc) + 1]
    return np.cumsum(edge)[:-1] > 0, all_, at


def _numbers(n: int):
    """Replies to names: a 48-bit number for each that two documents hold, the same for the whole corpus, and 0 for others."""

    def reducer(rows: list[dict]) -> list[bytes]:
        sizes = [len(r["p1"]) // 6 for r in rows]
        said = np.zeros((sum(sizes), 8), np.uint8)
        said[:, :6] = np.frombuffer(b"".join(r["p1"] for r in rows), np.uint8).reshape(-1, 6)
        said = said.view("<u8")[:, 0]
        key, several = said >> np.uint64(1), (said & np.uint64(1)).astype(bool)
        order = np.argsort(key, kind="stable")
        start = np.flatnonzero(np.concatenate(([True], np.diff(key[order]) != 0)))
        size = np.diff(np.append(start, len(key)))
        both = (size > 1) | np.logical_or.reduceat(several[order], start)
        number = np.where(both, (np.cumsum(both) - 1) * n + rows[0]["bucket"] + 1, 0)  # a task has one bucket
        out = np.empty(len(key), "<u8")
        out[order] = np.repeat(number, size)
        return [x.view(np.uint8).reshape(-1, 8)[:, :6].tobytes() for x in np.split(out, np.cumsum(sizes)[:-1])]

    return reducer


def _smaller_ids(rows: list[dict]) -> list[bytes]:
    sizes = [len(r["p1"]) // 8 for r in rows]
    lo, hi = (np.frombuffer(b"".join(r[c] for r in rows), t) for c, t in (("p1", np.uint64), ("p2", np.uint32)))
    z = zstandard.ZstdDecompressor()
    own = np.frombuffer(b"".join(z.decompress(r["p3"]) for r in rows), np.int64)
    order = np.lexsort((hi, lo))
    start = np.flatnonzero(np.concatenate(([True], (np.diff(lo[order]) != 0) | (np.diff(hi[order]) != 0))))
    least = np.repeat(np.minimum.reduceat(own[order], start), np.diff(np.append(start, len(lo))))
    out = np.empty(len(lo), bool)
    out[order] = least < own[order]
    return [np.packbits(x).tobytes() for x in np.split(out, np.cumsum(sizes)[:-1])]


def earlier_passages(docs: DataFrame, window: int = 13, levels: int = 3, chunk_bytes: int | None = None, with_text: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, n_candidates, n_windows, spans[, kept_text]) of every row; spans count words.

    n_windows, n_candidates: the windows of the document, and those that the shared symbols of all levels leave.
    """
    spark = docs.sparkSession
    n = partitions(spark)
    packed = shared_table(pack(plain(docs, id_col, text_col), chunk_bytes or chunk_size(n)), "packed", (n, "chunk"))
    columns = ["chunk", "ids", "id_null", "lens", "blob"]

    def name_round(level: int):
        def run(batches):
            for row in chunk_rows(batches, [*columns, "replies"]):
                c = _Chunk(row, window)
                c.climb(reply_map(row), level - 1, n)
                yield to_batch(list(c.names(row["chunk"], n)), MESSAGE_ARROW)

        return run

    known = spark.createDataFrame([], "chunk long, kind int, bucket int, reply binary")
    for level in range(1, levels + 1):
        said = with_replies(packed, known).select(*columns, "replies").mapInArrow(tidy(name_round(level)), MESSAGE)
        known = known.unionAll(shared_table(answered(said, {level: _numbers(n)}, n), "names"))

    def verify(batches):
        for row in chunk_rows(batches, [*columns, "replies"]):
            c = _Chunk(row, window)
            c.climb(reply_map(row), levels, n)
            c.verify(n)
            yield to_batch(list(c.digests(row["chunk"], n)), MESSAGE_ARROW)

    ids = answered(with_replies(packed, known).select(*columns, "replies").mapInArrow(tidy(verify), MESSAGE), {DIGEST: _smaller_ids}, n, keep=(CANDIDATES, TEXTS, LOCAL, COUNTS))

    def finish(batches):
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())])), pa.string()]
        take = 7 if with_text else 6
        for row in chunk_rows(batches, [*columns, "replies"]):
            own, null, offs, data = unpack(row)
            w = Words(data, offs)
            gone, all_, candidates = removed(w, window, reply_map(row))
            counts = [np.bincount(w.doc[at], minlength=len(own)).tolist() for at in (candidates, all_)]
            keep = np.repeat(~gone, w.length + 1)
            edge = np.searchsorted(w.doc, np.arange(len(own) + 1))
            place = np.append(w.at, len(w.bytes))[edge]
            cols: list[list] = [[] for _ in range(7)]
            for i in range(len(own)):
                cut = gone[edge[i] : edge[i + 1]]
                kept = w.bytes[place[i] : place[i + 1]]
                kept = (kept[keep[place[i] : place[i + 1]]] if cut.any() else kept).tobytes()[:-1]
                turn = np.flatnonzero(np.diff(np.concatenate(([0], cut.view(np.int8), [0]))))
                spans = [{"start": x, "length": y - x} for x, y in zip(turn[::2].tolist(), turn[1::2].tolist(), strict=True)]
                for col, v in zip(cols, (len(cut), int(cut.sum()), hashlib.sha256(kept).hexdigest(), counts[0][i], counts[1][i], spans, kept.decode() if with_text else None), strict=True):
                    col.append(v)
            names = ["n_words", "n_removed", "kept_sha256", "n_candidates", "n_windows", "spans", "kept_text"]
            yield pa.RecordBatch.from_arrays([ids_out(own, null), *(pa.array(x, k) for x, k in zip(cols[:take], kinds[:take], strict=True))], names=["doc_id", *names[:take]])

    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string, n_candidates long, n_windows long, spans array<struct<start:long,length:long>>" + ", kept_text string" * with_text
    return with_replies(packed, ids).select(*columns, "replies").mapInArrow(tidy(finish), schema)
