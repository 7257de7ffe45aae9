"""SimHash near-duplicates by pigeonhole blocks.

Words are lower-cased (A-Z only) and read from whole texts; each 3-word shingle, repeats included, is hashed by XXH64
(seed 42) and a fingerprint bit is set where over half the hashes have it. Two fingerprints that differ in at most
``distance`` bits agree on at least ``blocks - distance`` of ``blocks`` blocks, so every such pair meets under one of
the C(blocks, distance) keys made of the other blocks; meetings are verified by Hamming distance. ``blocks`` is chosen
from the number of distinct fingerprints, so that a key has more bits than that number; the links are the same.

:func:`near_texts` is the wider law for five words and a similarity of 0.8: 64 bits are too few there (such pairs lie up
to 14 bits apart), so a text has 512 bits of its distinct 5-word shingles, which verify, and 480 bits of its distinct
words, of which 20 blocks of 24 bits are the keys. Two texts link if they share a block (certain for up to 19 differing
word bits, and likely far beyond) and their shingle bits differ in at most ``distance`` places.

Entries (key, node, bits) go through one exchange as packed rows, a row for each task and bucket of keys, behind rows
that count them. A bucket is linked in one task if it holds at most ``group_rows`` entries (more where a task would have
over 64 buckets); a larger one, be it one hot key, is cut into parts on the way, and each two parts meet in a task of
their own. Tasks hand on spanning forests of the links they found, never pairs. Equal fingerprints are one node from the
start.

Defined cases: null or empty text: no words, fingerprint zero, linked like any other; fewer words than a shingle: the
whole sequence is the one shingle; very long texts: read whole, one at a time; ties: at exactly ``distance`` bits a pair
links, and a bit that exactly half the hashes have is 0; repeated rows: each gets its row; null doc_id: linked, but never
a component_id unless the component has no other id; empty table: no rows; other columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, chunk_rows, connected_components, id_arrays, ids_out, joined, local_components, mix, partitions, plain, shared_table, small_batches, split_by_bucket, text_arrays, tidy, to_batch

_BITS = ((np.arange(256)[:, None] >> np.arange(7, -1, -1)) & 1).astype(np.int64)
_COLUMN = (np.arange(8) * 256)[None, :]
_SEED = np.random.default_rng(31).integers(1, 2**63, 16, dtype=np.uint64) | np.uint64(1)
WORD_BITS, SHINGLE_BITS, KEY_BITS = 480, 512, 24


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """The unsigned fingerprint of one text (UTF-8)."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(shingle, len(words))
    digest = xxhash.xxh64_digest
    raw = b"".join([digest(joined[a:b], 42) for a, b in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)])
    each = np.frombuffer(raw, np.uint8).reshape(-1, 8)
    ones = np.einsum("cv,vb->cb", np.bincount((each + _COLUMN).ravel(), minlength=2048).reshape(8, 256), _BITS).ravel()
    return int.from_bytes(np.packbits(2 * ones > len(each)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): fp is the fingerprint's 64 bits as a signed long."""

    def run(batches):
        for b in batches:
            data, offs, _ = text_arrays(b)
            raw, at = data.tobytes(), offs.tolist()
            fps = np.array([fingerprint(raw[i:j], shingle) for i, j in zip(at[:-1], at[1:], strict=True)], np.uint64)
            yield pa.RecordBatch.from_arrays([ids_out(*id_arrays(b.column(0))), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    small_batches(docs.sparkSession)
    return plain(docs, id_col, text_col).mapInArrow(tidy(run), "doc_id long, fp long")


def majority(hashes: np.ndarray, bits: int) -> np.ndarray:
    """``bits`` majority bits, as bytes, of hashes widened by further mixing."""
    words = -(-bits // 64)
    each = mix(hashes[:, None] * _SEED[None, :words] + _SEED[None, ::-1][:, :words]).view(np.uint8).reshape(len(hashes), 8 * words)
    seen = np.bincount((each + np.arange(8 * words, dtype=np.int32) * 256).ravel(), minlength=2048 * words).reshape(8 * words, 256)
    return np.packbits(2 * (seen.astype(np.float32) @ _BITS.astype(np.float32)).ravel() > len(hashes))[: bits // 8]


def shingles(words: np.ndarray, shingle: int) -> np.ndarray:
    """Hashes of the distinct shingles of a sequence of word hashes."""
    k = min(shingle, len(words))
    n = len(words) - k + 1
    total = np.zeros(n, np.uint64)
    for j in range(k):
        total += words[j : j + n] * _SEED[j]
    return np.unique(mix(total))


def wide_bits(words: np.ndarray, shingle: int = 5) -> bytes:
    """The word bits and, behind them, the shingle bits of a text given as word hashes."""
    if not len(words):
        return bytes((WORD_BITS + SHINGLE_BITS) // 8)
    return majority(np.unique(words), WORD_BITS).tobytes() + majority(shingles(words, shingle), SHINGLE_BITS).tobytes()


def wide_fingerprints(docs: DataFrame, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 1 << 20) -> DataFrame:
    """(doc_id, bits) of every row."""

    def run(batches):
        for b in batches:
            data, offs, _ = text_arrays(b)
            out, at = [], 0
            while at < b.num_rows:
                to = max(at + 1, int(np.searchsorted(offs, offs[at] + block_bytes, side="right")) - 1)
                part = data[offs[at] : offs[to]]
                low = np.where((part >= 65) & (part <= 90), part + np.uint8(32), part)
                w = Words(low, offs[at : to + 1] - offs[at])
                edge = np.searchsorted(w.doc, np.arange(to - at + 1))
                out += [wide_bits(w.hash[i:j], shingle) for i, j in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
                at = to
            yield pa.RecordBatch.from_arrays([ids_out(*id_arrays(b.column(0))), pa.array(out, pa.binary())], names=["doc_id", "bits"])

    small_batches(docs.sparkSession)
    return plain(docs, id_col, text_col).mapInArrow(tidy(run), "doc_id long, bits binary")


def key_masks(blocks: int, distance: int) -> list[int]:
    """A mask of the compared bits for each choice of blocks - distance blocks."""
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    parts = [((1 << (b - a)) - 1) << a for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    return [sum(c) for c in combinations(parts, blocks - distance)]


def enough_blocks(distinct: int, distance: int) -> int:
    """The least number of blocks whose keys have more bits than the number of fingerprints, within 12."""
    return next((b for b in range(distance + 2, 12) if 64 * (b - distance) // b >= max(distinct, 1).bit_length()), 12)


def _links(key: np.ndarray, node: np.ndarray, bits: np.ndarray, side: np.ndarray, distance: int):
    """A forest of the links among entries sorted by key. side 0: compared with all of its key; 1 and 2: only across."""
    edges = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    sizes = np.diff(np.append(starts, len(key)))
    near = lambda i, j: np.bitwise_count(bits[i] ^ bits[j]).sum(axis=-1, dtype=np.int32) <= distance
    small = np.repeat(sizes <= 32, sizes)
    for d in range(1, min(32, int(sizes.max(initial=1)))):
        i = np.flatnonzero(small[:-d] & (key[:-d] == key[d:]))
        i = i[~((side[i] == side[i + d]) & (side[i] > 0)) & (node[i] != node[i + d])]
        i = i[near(i, i + d)]
        edges.append((node[i], node[i + d]))
    for s, m in zip(starts[sizes > 32].tolist(), sizes[sizes > 32].tolist(), strict=True):
        rows = np.arange(s, s + m)
        left, right = rows[side[rows] < 2], rows[side[rows] != 1]
        for a in range(0, len(left), 256):
            for b in range(0, len(right), 1024):
                i, j = left[a : a + 256], right[b : b + 1024]
                x, y = np.nonzero(near(i[:, None], j[None, :]))
                nodes, root = local_components(node[i[x]], node[j[y]])
                edges.append((nodes[nodes != root], root[nodes != root]))
    a, b = (np.concatenate(x) for x in zip(*edges, strict=True))
    nodes, root = local_components(a, b)
    return nodes[nodes != root], root[nodes != root]


_DEAL = pa.schema([("bucket", pa.int64()), ("kind", pa.int32()), ("n", pa.int64()), ("entries", pa.binary())])
_FOUND = pa.schema([("kind", pa.int32()), ("u", pa.int64()), ("v", pa.int64()), ("entries", pa.binary())])
COUNT, DATA = 0, 1  # of dealt rows
BOTH, LEFT, RIGHT, EDGE = 0, 1, 2, 9  # of found rows: entries of a block by side, and links


def _forest(nodes: DataFrame, entries_of, keys: int, words: int, distance: int, group_rows: int) -> DataFrame:
    """(u, v): links of nodes. entries_of(batch) gives (keys [m, keys], node [m], bits [m, words]) of the batch's rows."""
    n = partitions(nodes.sparkSession)
    entries = nodes.count() * keys
    room = max(group_rows, entries // (32 * n))  # entries that a task links at once; at most some 64 buckets a task
    buckets = max(1, -(-entries // (room // 2)))  # half full, but for hot keys
    entry = np.dtype([("key", "<u8"), ("node", "<i8"), ("bits", "<u8", (words,))])

    def deal(batches):
        count = np.zeros(buckets, np.int64)
        for b in joined(batches, max(4096, min(buckets, 32768))):  # rows to a bucket stay long, however many there are
            keys, node, bits = entries_of(b)
            bucket = (keys % np.uint64(buckets)).astype(np.int64).ravel()
            count += np.bincount(bucket, minlength=buckets)
            out, each = np.empty(keys.size, entry), keys.shape[1]
            out["key"], out["node"], out["bits"] = keys.ravel(), np.repeat(node, each), np.repeat(bits, each, axis=0)
            yield to_batch([(k, DATA, len(i), out[i].tobytes()) for k, i in split_by_bucket(bucket, buckets)], _DEAL)
        yield to_batch([(k, COUNT, int(count[k]), b"") for k in np.flatnonzero(count).tolist()], _DEAL)

    def link(found: list, side: list):
        e = np.concatenate([np.frombuffer(x, entry) for x in found])
        s = np.repeat(side, [len(x) // entry.itemsize for x in found])
        order = np.argsort(e["key"], kind="stable")
        e, s = e[order], s[order]
        alone = np.concatenate(([True], e["key"][1:] != e["key"][:-1]))
        more = ~(alone & np.append(alone[1:], True))
        e, s = e[more], s[more]
        return _links(e["key"], e["node"], e["bits"], s, distance) if len(e) else (np.zeros(0, np.int64), np.zeros(0, np.int64))

    def edge_batch(u, v):
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(u), EDGE, np.int32)), pa.array(u), pa.array(v), pa.nulls(len(u), pa.binary())], schema=_FOUND)

    def meet(batches):
        at, total, held, parts = None, 0, [], 1
        for r in chunk_rows(batches, ["bucket", "kind", "n", "entries"]):
            if r["bucket"] != at:
                if held:
                    yield edge_batch(*link(held, [BOTH] * len(held)))
                at, total, held = r["bucket"], 0, []
            if r["kind"] == COUNT:  # sorted before the entries
                total += r["n"]
                parts = -(-total // room)
            elif parts == 1:
                held.append(r["entries"])
            else:  # too many for a task: every two parts meet elsewhere
                e = np.frombuffer(r["entries"], entry)
                for i, own in split_by_bucket((mix(e["node"].view(np.uint64)) % np.uint64(parts)).astype(np.int64), parts):
                    raw = e[own].tobytes()
                    for j in range(parts):
                        yield to_batch([(BOTH if i == j else LEFT if i < j else RIGHT, at, min(i, j) * parts + max(i, j), raw)], _FOUND)
        if held:
            yield edge_batch(*link(held, [BOTH] * len(held)))

    def meet_parts(batches):
        at, held, side = None, [], []
        for r in chunk_rows(batches, ["kind", "u", "v", "entries"]):
            if (r["u"], r["v"]) != at:
                if held:
                    yield edge_batch(*link(held, side))
                at, held, side = (r["u"], r["v"]), [], []
            held.append(r["entries"])
            side.append(r["kind"])
        if held:
            yield edge_batch(*link(held, side))

    found_schema = "kind int, u long, v long, entries binary"
    dealt = nodes.repartition(n, nodes.columns[0]).mapInArrow(tidy(deal), "bucket long, kind int, n long, entries binary")
    dealt = dealt.repartitionById(n, (F.col("bucket") % n).cast("int")).sortWithinPartitions("bucket", "kind")
    found = shared_table(dealt.mapInArrow(tidy(meet), found_schema), "links")
    crowded = found.where(F.col("kind") != EDGE).repartition(n, "u", "v").sortWithinPartitions("u", "v")
    return found.where(F.col("kind") == EDGE).select("u", "v").unionAll(crowded.mapInArrow(tidy(meet_parts), found_schema).select("u", "v"))


def link_forest(fps: DataFrame, distance: int = 3, blocks: int = 5, group_rows: int = 1 << 17) -> DataFrame:
    """fps(fp), distinct, to edges (u, v) that connect whatever links at ``distance`` connect."""
    masks = np.array(key_masks(blocks, distance), np.uint64)
    salt = mix(np.arange(1, len(masks) + 1, dtype=np.uint64))

    def entries_of(b):
        fp = np.asarray(b.column(0)).astype(np.int64)
        return mix((fp.view(np.uint64)[:, None] & masks) ^ salt), fp, fp.view(np.uint64)[:, None]

    return _forest(fps, entries_of, len(masks), 1, distance, group_rows)


def near_duplicates(docs: DataFrame, shingle: int = 3, distance: int = 3, blocks: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint hex, component_id, kept) of every row of ``docs``."""
    fps = shared_table(fingerprints(docs, shingle, id_col, text_col), "simhash")
    nodes = shared_table(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    comp = connected_components(link_forest(nodes.select("fp"), distance, blocks or enough_blocks(nodes.count(), distance)))
    nodes = nodes.join(comp, nodes.fp == comp.node, "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))
    roots = nodes.groupBy("root").agg(F.min("least").alias("component_id"))
    named = nodes.join(roots, "root").select("fp", "component_id")
    return fps.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def near_texts(docs: DataFrame, shingle: int = 5, distance: int = 86, group_rows: int = 1 << 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, component_id) of every row; ids have to be unique and not null. 86 of 512 bits: a Jaccard similarity of about 0.76."""
    fps = shared_table(wide_fingerprints(docs, shingle, id_col, text_col), "simhash")
    nodes = shared_table(fps.groupBy("bits").agg(F.min("doc_id").alias("node")), "nodes")
    blocks = WORD_BITS // KEY_BITS
    salt = mix(np.arange(1, blocks + 1, dtype=np.uint64))

    def entries_of(b):
        col = pa.concat_arrays([b.column(1)])
        raw = np.frombuffer(b"".join(col.to_pylist()), np.uint8).reshape(b.num_rows, -1)
        key = raw[:, : WORD_BITS // 8].reshape(b.num_rows, blocks, KEY_BITS // 8).astype(np.uint64)
        own = (key * (np.uint64(256) ** np.arange(KEY_BITS // 8, dtype=np.uint64))).sum(axis=2, dtype=np.uint64)
        return mix(own ^ salt), np.asarray(b.column(0)).astype(np.int64), np.ascontiguousarray(raw[:, WORD_BITS // 8 :]).view(np.uint64)

    edges = _forest(nodes.select("node", "bits"), entries_of, blocks, SHINGLE_BITS // 64, distance, group_rows)
    comp = connected_components(edges)
    named = nodes.join(comp, "node", "left").select("bits", F.coalesce("component", "node").alias("component_id"))
    return fps.join(named, "bits").select("doc_id", "component_id")
