"""Every stage of the corpus pipeline against a brute-force version of what it has to keep, and on odd rows."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pytest

import corpus_pipeline as pipeline
from tessella.llm import common, langid_ppm, mixing, simhash

SF = "/root/testdata/sf0.001"
ROW = pipeline.COLUMNS


def wide_bits(text):
    """(word bits, shingle bits) of one text, by its own words."""
    low = np.frombuffer("".join(c.lower() if "A" <= c <= "Z" else c for c in text).encode(), np.uint8)
    hashes = common.Words(low, np.array([0, len(low)])).hash
    got = np.frombuffer(simhash.wide_bits(hashes), np.uint8)
    return got[:60], got[60:]


def tuples(df):
    return Counter(tuple(r[c] for c in ROW) for r in df.select(*ROW).collect())


@pytest.fixture(scope="module")
def stages(spark):
    out, docs = {}, spark.read.parquet(f"{SF}/documents.parquet")
    out["input"] = docs
    for name, stage in pipeline.STAGES:
        docs = pipeline.shared_table(stage(spark, docs, SF), name)
        out[name] = docs
    return out


def test_language_id(stages):
    said = {r.doc_id: r for r in langid_ppm.predict(stages["input"], langid_ppm.train(stages["input"])).collect()}
    want = {k: n for k, n in tuples(stages["input"]).items() if said[k[0]].lang_pred != "und" and said[k[0]].score >= 0.5}
    assert tuples(stages["language_id"]) == want and sum(want.values()) > 190


def test_near_dedup(stages):
    docs = [tuple(r) for r in stages["language_id"].select(*ROW).collect()]
    label = np.arange(len(docs))
    bits = [wide_bits(d[1] or "") for d in docs]
    word, shingle = (np.array([b[k] for b in bits]) for k in (0, 1))
    share = (word.reshape(-1, 1, 20, 3) == word.reshape(1, -1, 20, 3)).all(axis=3).any(axis=2)
    near = share & (np.bitwise_count(shingle[:, None] ^ shingle[None, :]).sum(axis=2) <= 86)
    while True:
        new = np.where(near, label[None, :], len(docs)).min(axis=1)
        if (new == label).all():
            break
        label = new
    kept = {}
    for d, k in zip(docs, label, strict=True):
        kept[k] = min(kept.get(k, d), d, key=lambda d: d[0])
    assert tuples(stages["near_dedup"]) == Counter(kept.values())


def test_passage_dedup(stages):
    docs = [tuple(r) for r in stages["near_dedup"].select(*ROW).collect()]
    raw = [d[1].encode() for d in docs]
    seen, want = {}, Counter()
    for d, b in sorted(zip(docs, raw, strict=True)):
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 199):
            first = seen.setdefault(b[k : k + 200], (d[0], k))
            if first[0] != d[0] or first[1] <= k - 200:
                gone[k : k + 200] = True
        turn = np.flatnonzero(np.diff(np.concatenate(([1], gone.astype(int), [1]))))
        text = "".join(b[x:y].decode(errors="ignore") for x, y in zip(turn[::2], turn[1::2], strict=True))
        if text.encode().split():
            want[d[0], text, d[2], d[3], len(text)] += 1
    assert tuples(stages["passage_dedup"]) == want


def test_a_passage_stays_once(spark):
    passage = " ".join(f"p{i * i % 97}q{i}" for i in range(80))
    rows = [(5, f"aa {passage} bb", "en", "s", 0), (3, f"cc dd {passage}", "en", "s", 0), (None, f"{passage} ee", "en", "s", 0), (9, "nothing of it", "en", "s", 0)]
    got = {r.doc_id: r.text for r in pipeline.passage_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), SF).collect()}
    assert got[3] == rows[1][1] and got[9] == rows[3][1]
    assert passage not in got[5] and passage not in got[None] and got[5].startswith("aa") and got[5].endswith("bb") and got[None].endswith("ee")


def test_mixture(stages):
    taken = {r.doc_id: r for r in mixing.mixture(stages["passage_dedup"]).collect()}
    words = Counter()
    for r in stages["mixture"].collect():
        words[r.doc_id] += len(r.text.encode().split())
        assert r.n_chars == len(r.text)
    assert words == Counter({k: r.taken for k, r in taken.items() if r.taken})


def test_packing(stages):
    docs = Counter(r.doc_id for r in stages["mixture"].collect())
    pieces = stages["packing"].collect()
    assert Counter(r.doc_id for r in pieces if r.start == 0) == docs
    fill = {}
    for r in sorted(pieces, key=lambda r: r.offset):
        assert fill.get(r.sequence_id, 0) == r.offset
        fill[r.sequence_id] = r.offset + r.length
    assert max(fill.values()) <= 2048 and len(fill) <= sum(fill.values()) // 2048 + 2


def test_run_is_the_stages_in_order(spark, stages):
    again = pipeline.run(spark, SF)
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert Counter(map(tuple, again.select(*key).collect())) == Counter(map(tuple, stages["packing"].select(*key).collect()))
    assert [n for n, _ in pipeline.STAGES] == ["language_id", "near_dedup", "passage_dedup", "mixture", "packing"]


def test_stages_on_odd_rows(spark, docs, empty):
    for table in (docs, empty):
        for name, stage in pipeline.STAGES:
            out = stage(spark, table, SF)
            if name != "packing":
                assert out.columns == ROW
                assert out.count() <= 3 * table.count()
            else:
                assert (out.count() == 0) == (table.count() == 0)
    kept = pipeline.near_dedup(spark, docs, SF).collect()
    assert Counter(r.doc_id for r in kept)[6] == 1 and all(v == 1 for k, v in Counter(r.doc_id for r in kept).items())


def odd_ids(spark):
    """Unrelated texts of 60 words, most of them without an id or with a shared one, and one copy."""
    texts = [" ".join(f"w{n}x{i * i % 83}" for i in range(60)) for n in range(9)]
    ids = [None, None, None, None, 7, 7, 7, 8, 9]
    rows = [(i, t, ["en", "fr", "de"][n % 3], f"s{n % 2}", len(t)) for n, (i, t) in enumerate(zip(ids, texts, strict=True))]
    return rows, spark.createDataFrame([*rows, (None, *rows[7][1:])], "doc_id long, text string, lang string, source string, n_chars long")


def test_near_dedup_keeps_a_row_of_each_component_whatever_the_ids(spark):
    rows, docs = odd_ids(spark)
    assert tuples(pipeline.near_dedup(spark, docs, SF)) == Counter(rows)


def test_passage_dedup_and_mixture_keep_rows_that_share_an_id_apart(spark):
    rows, docs = odd_ids(spark)
    docs = docs.limit(0).unionAll(spark.createDataFrame(rows, docs.schema))
    assert tuples(pipeline.passage_dedup(spark, docs, SF)) == Counter(rows)
    words = {s: sum(len(r[1].split()) for r in rows if r[3] == s) for s in ("s0", "s1")}
    taken = mixing.mixture(docs).collect()
    drawn = pipeline.mixture(spark, docs, SF).collect()
    assert len(drawn) == sum(-(-r.taken // r.size) for r in taken if r.taken)
    assert sum(len(r.text.split()) for r in drawn) == sum(r.taken for r in taken) and set(words) == {r.source for r in drawn}
    whole = {r[1]: r for r in rows}
    for r in drawn:  # with the text's own lang and source
        text = next(t for t in whole if t == r.text or t.startswith(r.text + " "))
        assert (r.doc_id, r.lang, r.source) == (whole[text][0], *whole[text][2:4])
