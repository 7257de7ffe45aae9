"""Language ID by prediction by partial matching (PPM).

For each language a context tree of orders 0 to 4 over all 256 bytes is learned: a context that was followed by n bytes
of d kinds gives a byte seen c times the probability c / (n + d) and escapes with d / (n + d) to the next shorter
context; below order 0 bytes are uniform. Counts are frozen after training, so the code length of a text is a sum of
table entries. The trees of all languages share sparse tables, one for each order: a row for each context and byte that
any language saw, with the code lengths in all languages, the escapes folded in, and a row of escapes for each context.
They are found by open addressing, so a byte that was seen in its context costs one look-up. The language with the
shortest code wins; the score is its posterior under equal priors for the code lengths.

Training reads whole texts of at most ``train_docs`` labelled documents (lowest hashes of the id) of ``train_bytes``
bytes together; counts are summed by Spark, and the driver sees at most one for each of these bytes. The tables are
shipped to the tasks if they have at most ``most_table`` bytes, else training fails.

Defined cases: null text, or no letter in the text: ``und``, score 0; null language: not learned from; no training
documents: every text is ``und``; very long texts: scored whole, in blocks of their own; ties of code lengths: the first
language by name; repeated rows: each gets its row; null doc_id: held out is false, and it isn't learned from; empty
table: no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_arrays, ids_out, mix, shared_table, small_batches, text_arrays, tidy

ORDER = 4  # of the longest contexts
_SYMBOL = 9  # bits of a byte plus one; 0 stands before a document's start

LETTER = regex.compile(r"\p{L}")
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[[*range(65, 91), *range(97, 123)]] = True


def held_out(id_col) -> F.Column:
    """The fixed quarter of the ids that nothing is learned from."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def grams(data: np.ndarray, offs: np.ndarray, order: int = ORDER) -> np.ndarray:
    """Code of each byte, in its low bits, with the ``order`` ones before it in its document."""
    s = data.astype(np.uint64) + np.uint64(1)
    code = s.copy()
    starts = offs[:-1][np.diff(offs) > 0]
    for k in range(1, order + 1):
        back = np.zeros(len(s), np.uint64)
        back[k:] = s[:-k] if len(s) > k else 0
        for j in range(k):  # nothing of the document before
            at = starts + j
            back[at[at < len(s)]] = 0
        code |= back << np.uint64(_SYMBOL * k)
    return code


def shorter(code: np.ndarray, order: int) -> np.ndarray:
    """The codes with ``order`` bytes of context only."""
    return code & np.uint64((1 << (_SYMBOL * (order + 1))) - 1)


class Places:
    """Different codes with their numbers, by open addressing."""

    def __init__(self, codes: np.ndarray):
        size = 1 << max(4, int(2 * len(codes)).bit_length())
        self.last = np.uint64(size - 1)
        self.code, self.number = np.zeros(size, np.uint64), np.full(size, -1, np.int32)
        left, at = np.arange(len(codes)), (mix(codes + np.uint64(1)) & self.last).astype(np.int64)
        while len(left):
            free = self.number[at] < 0
            self.number[at[free]] = left[free]  # of two at one place the last one stays
            won = self.number[at] == left
            self.code[at[won]] = codes[left[won]] + np.uint64(1)
            left, at = left[~won], (at[~won] + 1) & int(self.last)

    def find(self, codes: np.ndarray) -> np.ndarray:
        """Numbers, -1 for codes that aren't there."""
        codes = codes + np.uint64(1)
        at = (mix(codes) & self.last).astype(np.int64)
        held = self.code[at]
        out = np.where(held == codes, self.number[at], -1)
        open_ = np.flatnonzero((held != codes) & (held != 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & int(self.last)
            held = self.code[at[open_]]
            hit = held == codes[open_]
            out[open_[hit]] = self.number[at[open_[hit]]]
            open_ = open_[~hit & (held != 0)]
        return out

    @property
    def nbytes(self) -> int:
        return self.code.nbytes + self.number.nbytes


class Model:
    """For each order: code lengths by context and byte (``rows``), and escapes by context, in bits, a column a language."""

    def __init__(self, langs: list[str], counts: list[tuple[np.ndarray, np.ndarray]]):
        self.langs, self.levels = langs, []
        for order in range(ORDER + 1):
            own = []
            for codes, n in counts:
                kinds, at = np.unique(shorter(codes, order), return_inverse=True)
                own.append((kinds, np.bincount(at, weights=n, minlength=len(kinds))))
            seen = np.unique(np.concatenate([k for k, _ in own]))
            contexts, ctx_of = np.unique(seen >> np.uint64(_SYMBOL), return_inverse=True)
            escapes, rows = np.zeros((len(contexts), len(langs))), np.empty((len(seen), len(langs)))
            lower = self._bits(seen, order - 1)
            for k, (kinds, n) in enumerate(own):
                at = np.searchsorted(seen, kinds)
                total, different = np.bincount(ctx_of[at], weights=n, minlength=len(contexts)), np.bincount(ctx_of[at], minlength=len(contexts))
                known = different > 0
                escapes[known, k] = -np.log2(different[known] / (total[known] + different[known]))
                rows[:, k] = escapes[ctx_of, k] + lower[:, k]
                rows[at, k] = -np.log2(n / (total + different)[ctx_of[at]])
            self.levels.append((Places(seen), rows, Places(contexts), escapes))
        self.levels = [(a, r.astype(np.float32), b, e.astype(np.float32)) for a, r, b, e in self.levels]

    @property
    def nbytes(self) -> int:
        return sum(x.nbytes for level in self.levels for x in level)

    def _bits(self, codes: np.ndarray, order: int) -> np.ndarray:
        """Code lengths [codes, languages] of the last byte of each code in the ``order`` bytes before it."""
        if order < 0:
            return np.full((len(codes), len(self.langs)), 8.0)
        places, rows, contexts, escapes = self.levels[order]
        codes = shorter(codes, order)
        row = places.find(codes)
        bits = rows[row]
        new = np.flatnonzero(row < 0)
        if len(new):
            ctx = contexts.find(codes[new] >> np.uint64(_SYMBOL))
            bits[new] = self._bits(codes[new], order - 1) + np.where((ctx >= 0)[:, None], escapes[ctx], 0)
        return bits

    def code_lengths(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Bits of each text under each language."""
        out = np.zeros((len(offs) - 1, len(self.langs)))
        full = np.flatnonzero(np.diff(offs) > 0)
        if len(full):
            out[full] = np.add.reduceat(self._bits(grams(data, offs), ORDER), offs[full], axis=0, dtype=np.float64)
        return out


def train(docs: DataFrame, train_docs: int = 6000, train_bytes: int = 32 << 20, most_table: int = 512 << 20, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """Fit on documents that have a language and aren't held out, as many as ``train_docs`` and ``train_bytes`` allow."""
    spark = docs.sparkSession
    small_batches(spark)
    known = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    known = known.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")) & F.col("text").isNotNull())
    sizes = known.groupBy("doc_id").agg(F.sum(F.octet_length("text")).alias("size")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_docs).collect()  # at most train_docs rows
    total, ids = 0, []
    for r in sizes:
        if total + r.size <= train_bytes:
            total += r.size
            ids.append((r.doc_id,))
    sample = shared_table(known.join(F.broadcast(spark.createDataFrame(ids, "doc_id long")), "doc_id").select("lang", "text"), "sample")

    def count(batches):
        for b in batches:
            data, offs, _ = text_arrays(b)
            names = b.column(0).dictionary_encode()
            owner = np.repeat(np.asarray(names.indices), np.diff(offs))
            code = grams(data, offs)
            for k, lang in enumerate(names.dictionary.to_pylist()):
                codes, n = np.unique(code[owner == k], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes.astype(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "code", "n"])

    table = sample.mapInArrow(tidy(count), "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n")).toArrow()
    names = table.column("lang").combine_chunks().dictionary_encode()
    which, code, n = np.asarray(names.indices), np.asarray(table.column("code")).astype(np.uint64), np.asarray(table.column("n")).astype(np.float64)
    langs = names.dictionary.to_pylist()
    if not langs:
        return None
    by_name = sorted(range(len(langs)), key=lambda k: langs[k])
    model = Model([langs[k] for k in by_name], [(code[which == k], n[which == k]) for k in by_name])
    if model.nbytes > most_table:
        raise ValueError(f"tables of {model.nbytes} bytes; lower train_bytes")
    return model


def predict(docs: DataFrame, model: Model | None, block_bytes: int = 1 << 19, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row, with the columns of ``docs`` named in ``keep``."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)  # its size was checked in training

    def run(batches):
        m = shared.value
        for b in batches:
            data, offs, null = text_arrays(b)
            ids, id_null = id_arrays(b.column(0))
            names, scores, at = [], [], 0
            while at < b.num_rows:
                to = max(at + 1, int(np.searchsorted(offs, offs[at] + block_bytes, side="right")) - 1)
                part, o = data[offs[at] : offs[to]], offs[at : to + 1] - offs[at]
                lens = np.diff(o)
                letters = np.zeros(to - at, bool)
                if len(part):
                    letters[lens > 0] = np.logical_or.reduceat(_ASCII_LETTER[part], o[:-1][lens > 0])
                for i in np.flatnonzero(~letters & (lens > 0)):
                    letters[i] = bool(LETTER.search(part[o[i] : o[i + 1]].tobytes().decode()))
                if m is None:
                    names += ["und"] * (to - at)
                    scores += [0.0] * (to - at)
                else:
                    bits = m.code_lengths(part, o)
                    best = bits.argmin(axis=1)
                    post = 1 / np.exp2(np.maximum(bits.min(axis=1, keepdims=True) - bits, -1000)).sum(axis=1)
                    ok = letters & ~null[at:to]
                    names += [m.langs[k] if x else "und" for k, x in zip(best.tolist(), ok.tolist(), strict=True)]
                    scores += np.where(ok, post, 0.0).tolist()
                at = to
            own = [ids_out(ids, id_null), pa.array(names, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(own + [b.column(2 + i) for i in range(len(keep))], names=["doc_id", "lang_pred", "score", *(f"k{i}" for i in range(len(keep)))])

    keep = keep or []
    kinds = dict(docs.dtypes)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *(F.col(c).alias(f"k{i}") for i, c in enumerate(keep)))
    out = rows.mapInArrow(tidy(run), "doc_id long, lang_pred string, score double" + "".join(f", k{i} {kinds[c]}" for i, c in enumerate(keep)))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", *(F.col(f"k{i}").alias(c) for i, c in enumerate(keep)))
