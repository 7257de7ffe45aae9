"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature of a text is cut into quantile bins. Cyclic boosting adds a shallow tree (up to three leaves) on one
feature at a time, round after round, into that feature's lookup table; then the pairs of features that explain most
of what is left get tables of their own, boosted by trees that split one feature and then the other. A score is the
logistic of the intercept plus one table entry per feature and pair: additions over whole columns.

The fit reads at most ``train_rows`` labelled documents (lowest hashes of the id), whose features, never texts, come
to the driver; scoring covers whole texts of all documents in one pass.

Defined cases: null or empty text: the features of no bytes, scored like any other; very long texts: read whole, in a
block of their own; null label or id: not learned from; several labels of one id: the greatest; ties of gain: the first
cut, feature and pair; no labelled rows, or one class only: the score is the smoothed share of that class; repeated rows: each gets its
row; empty table: no rows; other columns, also of the labels, are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_arrays, ids_out, mix, plain, small_batches, text_arrays, tidy

FEATURES = ["bytes", "words", "word_length", "upper", "digits", "symbols", "punctuation", "non_ascii", "lines", "distinct_words", "distinct_pairs", "distinct_lines", "top_word", "sentence_words", "short_words", "long_words", "vowels", "echoes"]
_KIND = np.full(256, 8)  # 0 lower, 1 upper, 2 digit, 3 symbol, 4 punctuation, 5 sentence end, 6 white, 7 newline, 8 others
for _k, _chars in enumerate([b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#$%&*@^~|<>{}[]\\/=+_", b",;:'\"()-", b".!?", b" \t\r\x0b\x0c", b"\n"]):
    _KIND[list(_chars)] = _k
_VOWEL = np.zeros(256, bool)
_VOWEL[list(b"aeiouAEIOU")] = True
_draw = np.random.default_rng(7)
_BYTE = _draw.integers(1, 2**63, 256, dtype=np.uint64)
_PLACE = _draw.integers(1, 2**63, 4096, dtype=np.uint64) | np.uint64(1)


def _distinct(owner: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each owner: its number of different hashes, and how often the commonest occurs."""
    key = mix(h ^ (owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    order = np.argsort(key)
    new = np.concatenate(([True], key[order][1:] != key[order][:-1])) if len(key) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    most = np.zeros(n, np.int64)
    np.maximum.at(most, owner[order][at], np.diff(np.append(at, len(key))))
    return np.bincount(owner[order][at], minlength=n), most


def _hashes(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A hash of each stretch of ``data`` from one start to the next."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    place = np.arange(starts[0], len(data)) - np.repeat(starts, np.diff(np.append(starts, len(data))))
    return np.add.reduceat(_BYTE[data[starts[0] :]] * _PLACE[place & 4095], starts - starts[0])


def features(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """[texts, FEATURES] of texts laid end to end."""
    n, lens = len(offs) - 1, np.diff(offs)
    owner = np.repeat(np.arange(n), lens)
    kind = _KIND[data]
    c = np.bincount(owner * 9 + kind, minlength=9 * n).reshape(n, 9).astype(float)
    white = (kind == 6) | (kind == 7)
    edge = np.zeros(len(data), bool)
    edge[offs[:-1][lens > 0]] = True
    before = np.concatenate(([True], white[:-1])) if len(data) else white
    starts = np.flatnonzero(~white & (before | edge))
    word_owner = owner[starts]
    length = np.add.reduceat((~white).astype(np.int64), starts) if len(starts) else np.zeros(0, np.int64)
    h = _hashes(np.where(white, 0, data), starts) + length.astype(np.uint64) * _BYTE[0]
    words = np.bincount(word_owner, minlength=n).astype(float)
    kinds, most = _distinct(word_owner, h, n)
    same = word_owner[1:] == word_owner[:-1]
    echo = np.bincount(word_owner[1:][same & (h[1:] == h[:-1])], minlength=n)  # words that repeat the one before
    pairs, _ = _distinct(word_owner[1:][same], mix(h[:-1][same]) + h[1:][same], n)
    line_at = np.flatnonzero(edge | np.concatenate(([False], kind[:-1] == 7))) if len(data) else starts
    lines = np.bincount(owner[line_at], minlength=n).astype(float)
    line_kinds, _ = _distinct(owner[line_at], _hashes(data, line_at), n)
    some, byte = np.maximum(words, 1), np.maximum(lens, 1)
    letters = np.maximum(c[:, 0] + c[:, 1], 1)
    share = lambda mask: np.bincount(word_owner, weights=mask, minlength=n) / some
    return np.stack([
        np.log1p(lens), np.log1p(words), np.bincount(word_owner, weights=length, minlength=n) / some, c[:, 1] / letters, c[:, 2] / byte,
        c[:, 3] / byte, c[:, 4] / byte, c[:, 8] / byte, lines / some, kinds / some, pairs / np.maximum(words - 1, 1), line_kinds / np.maximum(lines, 1),
        most / some, words / (1 + c[:, 5]), share(length <= 2), share(length >= 15), np.bincount(owner, weights=_VOWEL[data], minlength=n) / letters, echo / some,
    ], axis=1)


class Gam:
    """Bin edges, an intercept, a table per feature and a grid per chosen pair."""

    def __init__(self, x: np.ndarray, y: np.ndarray, bins: int = 32, coarse: int = 8, rounds: int = 250, pairs: int = 10, pair_rounds: int = 60, rate: float = 0.08, ridge: float = 4.0):
        self.edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.zeros(0) for f in range(x.shape[1])]
        self.grid_edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, coarse + 1)[1:-1])) if len(x) else np.zeros(0) for f in range(x.shape[1])]
        p = (y.sum() + 1) / (len(y) + 2)
        self.intercept = float(np.log(p / (1 - p)))
        self.tables = [np.zeros(bins) for _ in self.edges]
        self.pairs: list[tuple[int, int, np.ndarray]] = []
        if len(np.unique(y)) < 2:
            return
        b, g = self._bins(x, self.edges), self._bins(x, self.grid_edges)
        score = np.full(len(y), self.intercept)
        for _ in range(rounds):
            for f, t in enumerate(self.tables):
                q = 1 / (1 + np.exp(-score))
                grad = np.bincount(b[f], weights=y - q, minlength=bins)
                hess = np.bincount(b[f], weights=q * (1 - q), minlength=bins)
                step = rate * self._leaves(grad, hess, ridge)
                t += step
                score += step[b[f]]
        q = 1 / (1 + np.exp(-score))
        gain = []
        for i in range(len(g)):
            for j in range(i):
                cell = g[i] * coarse + g[j]
                grad, hess = (np.bincount(cell, weights=w, minlength=coarse * coarse) for w in (y - q, q * (1 - q)))
                gain.append(((grad * grad / (hess + ridge)).sum(), i, j))
        self.pairs = [(i, j, np.zeros((coarse, coarse))) for _, i, j in sorted(gain, reverse=True)[:pairs]]
        for _ in range(pair_rounds):
            for i, j, t in self.pairs:
                q = 1 / (1 + np.exp(-score))
                cell = g[i] * coarse + g[j]
                grad, hess = (np.bincount(cell, weights=w, minlength=coarse * coarse).reshape(coarse, coarse) for w in (y - q, q * (1 - q)))
                step = rate * self._crossed(grad, hess, ridge)
                t += step
                score += step.ravel()[cell]

    @staticmethod
    def _bins(x: np.ndarray, edges: list[np.ndarray]) -> list[np.ndarray]:
        return [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(edges)]

    @staticmethod
    def _split(grad: np.ndarray, hess: np.ndarray, ridge: float) -> tuple[float, int]:
        """Gain and place of the best cut of a run of bins."""
        if len(grad) < 2:
            return 0.0, 0
        a, h = np.cumsum(grad)[:-1], np.cumsum(hess)[:-1]
        rest, rest_h = grad.sum() - a, hess.sum() - h
        gain = a * a / (h + ridge) + rest * rest / (rest_h + ridge) - grad.sum() ** 2 / (hess.sum() + ridge)
        return float(gain.max()), int(gain.argmax()) + 1

    @classmethod
    def _leaves(cls, grad: np.ndarray, hess: np.ndarray, ridge: float) -> np.ndarray:
        """A tree of up to three leaves over the bins of one feature, as a table."""
        _, first = cls._split(grad, hess, ridge)
        cuts = [0, first, len(grad)] if first else [0, len(grad)]
        if first:
            more = [(*cls._split(grad[a:b], hess[a:b], ridge), a) for a, b in ((0, first), (first, len(grad)))]
            gain, at, base = max(more)
            if gain > 0 and at:
                cuts = sorted({*cuts, base + at})
        out = np.zeros(len(grad))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            out[a:b] = grad[a:b].sum() / (hess[a:b].sum() + ridge)
        return out

    @classmethod
    def _crossed(cls, grad: np.ndarray, hess: np.ndarray, ridge: float) -> np.ndarray:
        """A tree that splits the first feature and then, on either side, the second."""
        _, cut = cls._split(grad.sum(axis=1), hess.sum(axis=1), ridge)
        out = np.zeros_like(grad)
        for a, b in ((0, cut), (cut, len(grad))):
            if b > a:
                g, h = grad[a:b].sum(axis=0), hess[a:b].sum(axis=0)
                _, at = cls._split(g, h, ridge)
                for c, d in ((0, at), (at, len(g))):
                    if d > c:
                        out[a:b, c:d] = g[c:d].sum() / (h[c:d].sum() + ridge)
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        b, g = self._bins(x, self.edges), self._bins(x, self.grid_edges)
        total = np.full(len(x), self.intercept)
        for f, t in enumerate(self.tables):
            total += t[b[f]]
        for i, j, t in self.pairs:
            total += t[g[i], g[j]]
        return 1 / (1 + np.exp(-total))


def _blocks(batch, block_bytes: int):
    data, offs, _ = text_arrays(batch)
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + block_bytes, side="right")) - 1)
        yield features(data[offs[at] : offs[to]], offs[at : to + 1] - offs[at])
        at = to


def train(docs: DataFrame, labels: DataFrame, train_rows: int = 20_000, block_bytes: int = 1 << 20, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Gam:
    """Fit on at most ``train_rows`` labelled documents; ``labels`` holds only rows that may be learned from."""
    small_batches(docs.sparkSession)
    own = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).dropna()
    own = own.groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)

    def run(batches):
        for b in batches:
            parts = list(_blocks(b, block_bytes))
            x = np.concatenate(parts) if parts else np.zeros((0, len(FEATURES)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(x), pa.list_(pa.float64()))], names=["y", "x"])

    # at most train_rows ids are broadcast, and as many rows of features collected
    got = plain(docs, id_col, text_col).join(F.broadcast(own), "doc_id").select("y", "text").mapInArrow(tidy(run), "y int, x array<double>").toArrow()
    x = np.array(got.column("x").to_pylist(), float).reshape(-1, len(FEATURES))
    y = np.asarray(got.column("y"), float)
    order = np.lexsort((*x.T, y)) if len(y) else np.zeros(0, int)  # any order of rows gives the same sums
    return Gam(x[order], y[order])


def score(docs: DataFrame, model: Gam, block_bytes: int = 1 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every row."""
    small_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            parts = [model.score(x) for x in _blocks(b, block_bytes)]
            yield pa.RecordBatch.from_arrays([ids_out(*id_arrays(b.column(0))), pa.array(np.concatenate(parts) if parts else np.zeros(0))], names=["doc_id", "score"])

    return plain(docs, id_col, text_col).mapInArrow(tidy(run), "doc_id long, score double")
