"""Each operator against a brute-force version, on a small table that holds the odd cases."""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
import xxhash

from tessella.llm import common, embedding_dedup, langid_ppm, media_avi, mixing, packing, quality_gam, queries, sharding, simhash, substring_recompression, suffix_dedup
from tessella.llm.queries import tokenizer_path

SPACE = b" \t\n\x0b\x0c\r"


def rows(df):
    return [r.asDict(recursive=True) for r in df.collect()]


def by_text(got, texts, key):
    """Pairs of results and inputs: both sorted by the id and what ``key`` says of the text."""
    left = sorted(got, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, str(r[key[0]])))
    right = sorted(texts, key=lambda t: (t[0] is None, t[0] or 0, str(key[1](t[1]))))
    assert len(left) == len(right)
    return zip(left, right, strict=True)


def components(n, linked):
    label = list(range(n))
    for i in range(n):
        for j in range(i):
            if linked(i, j):
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    return label


# --- op1


@pytest.mark.parametrize("options", [{}, {"rows_per_pivot": 10, "block_rows": 7}])
def test_embedding_links(spark, options):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 12))
    x = [(c + 0.13 * rng.normal(size=12)).astype(np.float32).tolist() for c in centres for _ in range(25)]
    x += [x[0]] * 5 + [None, [], [0.0] * 12, [1.0, None] + [0.5] * 10, [float("nan")] + [1.0] * 11, [1.0, 2.0], [2.0, 4.0]]
    table = [(i, v, 0, 1) for i, v in enumerate(x)]
    got = {r["vec_id"]: r for r in rows(embedding_dedup.near_duplicates(spark.createDataFrame(table, "vec_id long, embedding array<float>, uid long, cell int"), **options))}
    fine = [v is not None and len(v) > 0 and all(c is not None and np.isfinite(c) for c in v) and any(v) for v in x]

    def linked(i, j):
        if not (fine[i] and fine[j]) or len(x[i]) != len(x[j]):
            return False
        a, b = np.array(x[i], float), np.array(x[j], float)
        return a @ b / np.sqrt(a @ a) / np.sqrt(b @ b) >= 0.95

    n = len(x)
    links = [sum(linked(i, j) for j in range(n) if j != i) for i in range(n)]
    assert [got[i]["n_links"] for i in range(n)] == links and sum(links) > 100
    assert [got[i]["component_id"] for i in range(n)] == components(n, linked)
    assert all(got[i]["kept"] == (got[i]["component_id"] == i) for i in range(n))


def test_embedding_odd_rows(spark):
    df = spark.createDataFrame([(None, [1.0, 0.0]), (5, [1.0, 0.0]), (5, [1.0, 0.0])], "vec_id long, embedding array<double>")
    assert sorted((r["vec_id"] or 0, r["n_links"], r["component_id"]) for r in rows(embedding_dedup.near_duplicates(df))) == [(0, 2, 5), (5, 2, 5), (5, 2, 5)]
    assert rows(embedding_dedup.near_duplicates(df.where("false"))) == []


def test_embedding_whole_query_against_numpy(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    got = df.join(embedding_dedup.near_duplicates(df, rows_per_pivot=500), "vec_id").select("vec_id", "embedding", "n_links", "component_id").toPandas()
    e = np.stack(got["embedding"]).astype(float)
    e /= np.sqrt((e * e).sum(axis=1))[:, None]
    near = e @ e.T >= 0.95
    np.fill_diagonal(near, False)
    assert (got["n_links"].to_numpy() == near.sum(axis=1)).all()


def test_clustered_vectors_are_compared_in_few_pairs():
    """Far clusters fall to cells of their own and aren't compared; every close pair still meets, once."""
    rng = np.random.default_rng(9)
    centre = embedding_dedup.unit(rng.normal(size=(12, 24)))
    x = embedding_dedup.unit(np.repeat(centre, 200, axis=0) + 0.03 * rng.normal(size=(2400, 24)))
    pivots, r = embedding_dedup.choose_pivots(x[rng.permutation(2400)[:600]], 16), np.sqrt(2 - 2 * 0.95)
    home, mask = embedding_dedup.cells_of(x, pivots, r)
    sent = embedding_dedup.sent_to(home, mask)
    met = (np.arange(16) == home[:, None]).astype(int) @ sent.T.astype(int)  # [u, v]: cells where u is at home and v is
    met = met + met.T - (home[:, None] == home[None, :])
    near = x @ x.T >= 0.95
    assert near.sum() > 100_000 and (met[near] == 1).all()
    pairs = sum((home == p).sum() * sent[:, p].sum() for p in range(16))
    assert pairs < 0.25 * 2400 * 2400 and sent.sum() < 2 * 2400


def test_blocks_by_distance_to_the_pivot():
    rng = np.random.default_rng(2)
    a, b = np.sort(rng.random(50) * 2), np.sort(rng.random(70) * 2)
    kept = {(i, j) for p, q in embedding_dedup.block_pairs(a, b, 0.1, side=4) for i in range(p, min(p + 4, 50)) for j in range(q, min(q + 4, 70))}
    assert all((i, j) in kept for i in range(50) for j in range(70) if abs(a[i] - b[j]) <= 0.1) and len(kept) < 1500


# --- op2


def brute_fingerprint(text):
    words = [w for w in (text or "").translate({c: c + 32 for c in range(65, 91)}).encode().split()]
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints(docs, texts, empty):
    got = rows(simhash.near_duplicates(docs))
    for r, (i, t) in by_text(got, texts, ("fingerprint", lambda t: f"{brute_fingerprint(t):016x}")):
        assert (r["doc_id"], r["fingerprint"]) == (i, f"{brute_fingerprint(t):016x}")
    fps = [brute_fingerprint(t) for _, t in texts]
    label = components(len(fps), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 3)
    least = {k: min((texts[i][0] for i in range(len(fps)) if label[i] == k and texts[i][0] is not None), default=None) for k in set(label)}
    assert Counter((r["doc_id"], r["component_id"]) for r in got) == Counter((texts[i][0], least[label[i]]) for i in range(len(fps)))
    assert rows(simhash.near_duplicates(empty)) == []


@pytest.mark.parametrize("group_rows", [4096, 16])
def test_links_at_three_bits(spark, group_rows):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    fps = sorted({int(b) ^ sum(1 << int(k) for k in rng.choice(64, rng.integers(0, 6), replace=False)) for b in base for _ in range(12)})
    hot = 0x0123456789ABCDEF
    fps = sorted({*fps, *(hot ^ (1 << i) ^ (1 << j) for i in range(64, 0, -1) for j in range(0, 64, 5) if i < 64)})
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    edges = simhash.link_forest(spark.createDataFrame([(s,) for s in signed], "fp long"), group_rows=group_rows)
    got = {r["node"]: r["component"] for r in rows(common.connected_components(edges))}
    arr = np.array(fps, np.uint64)
    near = np.bitwise_count(arr[:, None] ^ arr[None, :]) <= 3
    label = common.local_components(*np.nonzero(near))[1]
    want = {}
    for s, k in zip(signed, label, strict=True):
        want.setdefault(k, set()).add(s)
    mine = {}
    for s in signed:
        mine.setdefault(got.get(s, s), set()).add(s)
    assert sorted(map(sorted, want.values())) == sorted(map(sorted, mine.values()))


@pytest.mark.parametrize("most_local", [0, 1 << 21])
def test_components_by_rounds_and_in_one_task(spark, most_local):
    rng = np.random.default_rng(8)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))] + [(500 + k, 501 + k) for k in range(40)] + [(600, k) for k in range(601, 700)]
    got = {r["node"]: r["component"] for r in rows(common.connected_components(spark.createDataFrame(edges, "u long, v long").repartition(3), most_local=most_local))}
    nodes, root = common.local_components(*np.array([e for e in edges if e[0] != e[1]]).T)
    assert got == dict(zip(nodes.tolist(), root.tolist(), strict=True))
    assert common.connected_components(spark.createDataFrame([], "u long, v long"), most_local=most_local).count() == 0


# --- op3


def test_media(docs, texts, empty):
    got = rows(media_avi.media_rows(docs, with_file=True, batch_bytes=3000))
    for r, (i, t) in by_text(got, texts, ("payload_sha256", lambda t: hashlib.sha256(padded(t)).hexdigest())):
        payload = padded(t)
        assert (r["doc_id"], r["n_bytes"], r["payload_bytes"]) == (i, len((t or "").encode()), len(payload))
        assert r["tail_crc32"] == zlib.crc32(payload[-32:]) and r["media_sha256"] == hashlib.sha256(r["file"]).hexdigest() and r["media_bytes"] == len(r["file"])
        assert sum(c["n_frames"] for c in r["clips"]) == len(payload) // 576
    clips = rows(media_avi.clip_rows(media_avi.media_rows(docs)))
    assert sum(c["n_frames"] for c in clips) == sum(r["payload_bytes"] for r in got) // 576 and all(c["end_s"] > c["start_s"] for c in clips)
    assert rows(media_avi.media_rows(empty)) == []


def padded(text):
    raw = (text or "").encode()
    return raw + b"\xff" * (-len(raw) % 576 if raw else 576)


def test_general_decoder_agrees():
    frames = np.random.default_rng(1).integers(0, 256, (4, 576), dtype=np.uint8)
    frames[0] = 255
    chunks, offs = media_avi.encode_frames(frames)
    file = media_avi.avi(chunks.tobytes(), offs)
    starts, sizes = media_avi.parse_index(file)
    data = np.frombuffer(file, np.uint8)
    assert (media_avi.decode_frames(data, starts, sizes) == frames).all()
    for k in range(4):
        slow = media_avi.decode_blocks(file[starts[k] : starts[k] + sizes[k]])
        assert (slow == np.kron(frames[k].reshape(24, 24), np.ones((8, 8)))).all()


def test_shots():
    calm = np.tile(np.arange(576) % 16 + 64, (12, 1)).astype(np.uint8)
    frames = np.concatenate((calm, 255 - calm))
    assert np.flatnonzero(media_avi.shot_cuts(frames, np.zeros(24, int))).tolist() == [0, 12]


def brute_cuts(payload):
    """Frames that begin a shot, by fractions."""
    hist = [np.bincount(np.frombuffer(payload[a : a + 576], np.uint8) >> 4, minlength=16) for a in range(0, len(payload), 576)]
    diff = [0] + [int(np.abs(a - b).sum()) for a, b in zip(hist[1:], hist[:-1], strict=True)]
    out = []
    for i in range(1, len(diff)):
        last = [Fraction(d) for d in diff[max(1, i - 8) : i]]
        if len(last) > 1:
            mean = sum(last) / len(last)
            spread = sum(x * x for x in last) / len(last) - mean * mean
            if diff[i] > mean and (diff[i] - mean) ** 2 > 9 * spread and 10 * diff[i] > 2 * 576:
                out.append(i)
    return out


@pytest.mark.parametrize("batch_bytes", [600, 20_000, 1 << 21])
def test_equal_texts_have_equal_shots(spark, batch_bytes):
    """Repeated frames give constant differences, where the last bits of running sums used to decide."""
    rng = np.random.default_rng(17)
    frames = ["".join(rng.choice(list("abcXYZ019 ~"), 576)) for _ in range(24)]
    same = [(frames[i] + frames[i + 1]) * 20 + frames[(i + 5) % 24] * 3 for i in range(0, 12, 3)]
    texts = same * 6 + ["".join(rng.choice(list("pqrst~!"), rng.integers(0, 5000))) for _ in range(40)]
    texts = [texts[i] for i in rng.permutation(len(texts))]
    got = rows(media_avi.media_rows(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1), batch_bytes=batch_bytes))
    for r in got:
        cuts = brute_cuts(padded(texts[r["doc_id"]]))
        assert r["feature"].endswith(f"shots={len(cuts) + 1};cuts=" + ",".join(map(str, cuts)))
        assert [c["first_frame"] for c in r["clips"]] == [0, *cuts]


# --- op4


@pytest.mark.parametrize("chunk_bytes", [1 << 22, 2000])
def test_earlier_passages(docs, texts, empty, chunk_bytes):
    inf = 2**63 - 1
    words = [(inf if i is None else i, (t or "").encode().split()) for i, t in texts]
    first = {}
    for i, w in words:
        for k in range(len(w) - 12):
            key = tuple(w[k : k + 13])
            first[key] = min(i, first.get(key, inf))
    want = []
    for (i, w), (own, _) in zip(words, texts, strict=True):
        gone = np.zeros(len(w), bool)
        for k in range(len(w) - 12):
            if first[tuple(w[k : k + 13])] < i:
                gone[k : k + 13] = True
        want.append((own, len(w), int(gone.sum()), hashlib.sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest()))
    got = rows(substring_recompression.earlier_passages(docs, chunk_bytes=chunk_bytes, with_text=True))
    assert Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got) == Counter(want)
    assert all(hashlib.sha256(r["kept_text"].encode()).hexdigest() == r["kept_sha256"] and sum(s["length"] for s in r["spans"]) == r["n_removed"] for r in got)
    assert rows(substring_recompression.earlier_passages(empty)) == []


def test_symbols_agree_inside_equal_windows():
    """The inner symbols of a window depend on its own words only, at every level, and no window shared by two texts is lost."""
    rng = np.random.default_rng(2)
    most = 0
    for _ in range(60):
        core = [b"abcdefg"[k : k + 1] * int(rng.integers(1, 3)) for k in rng.integers(0, 7, 13)]
        texts, seen = [], []
        for _ in range(5):
            around = [[b"abcdh"[k : k + 1] for k in rng.integers(0, 5, rng.integers(0, 20))] for _ in range(2)]
            texts.append((b" ".join([*around[0], *core, *around[1]]), len(around[0])))
        data = b"".join(t for t, _ in texts)
        offs = np.cumsum([0, *(len(t) for t, _ in texts)])
        words = common.Words(np.frombuffer(data, np.uint8), offs)
        s = substring_recompression.Symbols(words, 13)
        start = [int(np.flatnonzero(words.doc == k)[0]) + at for k, (_, at) in enumerate(texts)]
        own = [int(np.flatnonzero(s.window == at)[0]) for at in start]
        for _ in range(3):
            s.pair()
            keys, several = s.items()
            s.rename(np.where(several, np.arange(1, len(keys) + 1, dtype=np.uint64), np.uint64(0)))
            seen = [s.name[s.inner[0][w] : s.inner[1][w] + 1].tolist() for w in own]
            assert all(x == seen[0] for x in seen) and all(seen[0])
            most = max(most, len(seen[0]))
        assert s.candidate[own].all()
    assert most >= 2


# --- op5


def test_mixture(docs, texts, empty):
    got = rows(mixing.mixture(docs))
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((i, len((t or "").encode().split())) for i, t in texts)
    by = {}
    for r in got:
        by.setdefault(r["target"], []).append(r)
        assert 0 <= r["taken"] <= 3 * r["size"] and (r["position"] is None) == (r["taken"] == 0)
    assert abs(sum(r["taken"] for r in got) - sum(r["size"] for r in got)) <= 4
    assert sorted(map(str, got)) == sorted(map(str, rows(mixing.mixture(docs))))
    assert rows(mixing.mixture(empty)) == []


def test_targets_by_water_level(spark):
    sizes = spark.createDataFrame([(f"s{k}", k, n) for k, n in {"a": 10, "b": 100, "c": 1000, "d": 20, "e": 5}.items()] + [("n", None, 40)], "skey string, source string, size long")
    got = {r["skey"]: r["target"] for r in rows(mixing.source_targets(sizes))}
    weights = dict(zip(["sa", "sb", "sc", "sd", "se", "n"], [5, 2, 1, 5, 2, 1], strict=True))
    cap = {"sa": 30, "sb": 300, "sc": 3000, "sd": 60, "se": 15, "n": 120}
    full, total = {}, 1175.0
    while True:
        rest = {k: w for k, w in weights.items() if k not in full}
        left = total - sum(full.values())
        share = {k: left * w / sum(rest.values()) for k, w in rest.items()}
        over = [k for k, v in share.items() if v > cap[k]]
        if not over:
            break
        full |= {k: cap[k] for k in over}
    for k, v in (full | share).items():
        assert got[k] == pytest.approx(v)


def test_drawn_documents_match_taken(spark, docs):
    from pyspark.sql import functions as F

    own = docs.where("doc_id is not null").dropDuplicates(["doc_id"]).withColumns({c: F.lit("mine") for c in ("k", "words", "cut", "position", "lap", "taken")})
    taken = {r["doc_id"]: r["taken"] for r in rows(mixing.mixture(own))}
    drawn = Counter()
    for r in rows(mixing.drawn_documents(own)):
        drawn[r["doc_id"]] += len(r["text"].encode().split())
    assert {k: v for k, v in taken.items() if v} == dict(drawn)


def test_curriculum_integral():
    import math

    for tilt in (-0.5, 0.0, 0.5):
        for x in np.linspace(0, 1, 9):
            t = x if not tilt else (tilt - 1 + math.sqrt((1 - tilt) ** 2 + 4 * tilt * x)) / (2 * tilt)
            assert t + tilt * (t * t - t) == pytest.approx(x) and -1e-9 <= t <= 1 + 1e-9


# --- op6


def test_quality(spark, docs, empty):
    rng = np.random.default_rng(9)
    good = [" ".join(rng.choice(["river", "stone", "and", "the", "house", "green", "Walking"], 80)) + "." for _ in range(150)]
    bad = [" ".join(rng.choice(["buy", "$$$", "###", "now", "now", "now"], 80)) for _ in range(150)]
    table = spark.createDataFrame([(i, t) for i, t in enumerate(good + bad)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 150)) for i in range(300)] + [(None, 1), (3, None)], "doc_id long, quality int")
    held = langid_ppm.held_out
    from pyspark.sql import functions as F

    model = quality_gam.train(table, labels.where(~held(F.col("doc_id"))))
    got = {r["doc_id"]: r["score"] for r in rows(quality_gam.score(table, model))}
    assert all((got[i] >= 0.7) == (i < 150) for i in range(300))
    odd = rows(quality_gam.score(docs, model))
    assert len(odd) == docs.count() and all(0 <= r["score"] <= 1 for r in odd)
    assert rows(quality_gam.score(empty, model)) == []
    assert quality_gam.train(table, labels.where("false")).score(np.zeros((1, len(quality_gam.FEATURES)))).tolist() == [0.5]


def test_quality_features_by_hand():
    texts = [b"", b"Aa bb bb\nbb! 12", b"x"]
    offs = np.cumsum([0, *map(len, texts)])
    f = dict(zip(quality_gam.FEATURES, quality_gam.features(np.frombuffer(b"".join(texts), np.uint8), offs).T, strict=True))
    assert f["words"].tolist() == np.log1p([0, 5, 1]).tolist() and f["distinct_words"].tolist() == [0, 4 / 5, 1] and f["upper"].tolist() == [0, 1 / 8, 0]
    assert f["lines"].tolist() == [0, 2 / 5, 1] and f["top_word"].tolist() == [0, 2 / 5, 1] and f["word_length"].tolist() == [0, 11 / 5, 1] and f["distinct_pairs"].tolist() == [0, 1, 0]
    assert f["echoes"].tolist() == [0, 1 / 5, 0]


def brute_gam(x, y, bins, coarse, rounds, pairs, pair_rounds, rate, ridge):
    """Boosting row by row: every cut is tried on the rows themselves, and a model is its list of trees."""
    n = len(y)
    edge = lambda f, k: sorted(set(np.quantile(x[:, f], np.linspace(0, 1, k + 1)[1:-1]).tolist()))
    place = lambda f, k: [sum(v >= e for e in edge(f, k)) for v in x[:, f]]
    fine, rough = ([place(f, k) for f in range(x.shape[1])] for k in (bins, coarse))
    p = (y.sum() + 1) / (n + 2)
    score = [float(np.log(p / (1 - p)))] * n

    def state():
        q = [1 / (1 + np.exp(-s)) for s in score]
        return [t - v for t, v in zip(y, q, strict=True)], [v * (1 - v) for v in q]

    def best(rows, at, lo, hi, g, h):
        """(gain, cut) of the best cut of bins lo to hi."""
        total = lambda rs: (sum(g[r] for r in rs), sum(h[r] for r in rs))
        whole, found = total(rows), (0.0, 0)
        for cut in range(lo + 1, hi):
            a, b = total([r for r in rows if at[r] < cut]), total([r for r in rows if at[r] >= cut])
            gain = a[0] ** 2 / (a[1] + ridge) + b[0] ** 2 / (b[1] + ridge) - whole[0] ** 2 / (whole[1] + ridge)
            if cut == lo + 1 or gain > found[0] + 1e-13:
                found = gain, cut
        return found

    def add(rows, g, h):
        step = rate * sum(g[r] for r in rows) / (sum(h[r] for r in rows) + ridge)
        for r in rows:
            score[r] += step

    for _ in range(rounds):
        for at in fine:
            g, h = state()
            _, cut = best(range(n), at, 0, bins, g, h)
            halves = [(0, cut), (cut, bins)]
            tried = []
            for lo, hi in halves:
                gain, c = best([r for r in range(n) if lo <= at[r] < hi], at, lo, hi, g, h)
                tried.append((gain, c, lo, hi))
            gain, c, lo, hi = max(tried, key=lambda t: (t[0], t[1] - t[2]))
            leaves = [x for x in halves if x != (lo, hi)] + [(lo, c), (c, hi)] if gain > 0 and c else halves
            for lo, hi in leaves:
                add([r for r in range(n) if lo <= at[r] < hi], g, h)
    g, h = state()
    gain = []
    for i in range(x.shape[1]):
        for j in range(i):
            cells = {}
            for r in range(n):
                cells.setdefault((rough[i][r], rough[j][r]), []).append(r)
            gain.append((sum(sum(g[r] for r in rs) ** 2 / (sum(h[r] for r in rs) + ridge) for rs in cells.values()), i, j))
    chosen = [(i, j) for _, i, j in sorted(gain, reverse=True)[:pairs]]
    for _ in range(pair_rounds):
        for i, j in chosen:
            g, h = state()
            _, cut = best(range(n), rough[i], 0, coarse, g, h)
            for lo, hi in ((0, cut), (cut, coarse)):
                rows_ = [r for r in range(n) if lo <= rough[i][r] < hi]
                _, at = best(rows_, rough[j], 0, coarse, g, h)
                for c, d in ((0, at), (at, coarse)):
                    add([r for r in rows_ if c <= rough[j][r] < d], g, h)
    return [1 / (1 + np.exp(-s)) for s in score], chosen


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_boosting_against_brute_force(seed):
    rng = np.random.default_rng(seed)
    x = np.stack([rng.normal(size=120), rng.integers(0, 4, 120), rng.random(120), rng.normal(size=120)], axis=1)
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 1) | (x[:, 2] > 0.8)).astype(float)
    options = {"bins": 8, "coarse": 4, "rounds": 4, "pairs": 2, "pair_rounds": 5, "rate": 0.3, "ridge": 1.0}
    want, pairs = brute_gam(x, y, **options)
    model = quality_gam.Gam(x, y, **options)
    assert [(i, j) for i, j, _ in model.pairs] == pairs
    assert np.allclose(model.score(x), want, atol=1e-9)


def test_quality_labels_with_clashing_columns(spark, docs):
    labels = spark.createDataFrame([(i, q, "x", 1, 0.5) for i, q in ((1, 0), (2, 1), (2, 0), (8, 1), (12, 0), (None, 1))], "doc_id long, quality int, text string, y int, score double")
    plain = quality_gam.train(docs, labels.select("doc_id", "quality"))
    model = quality_gam.train(docs, labels)
    x = np.random.default_rng(0).random((20, len(quality_gam.FEATURES)))
    assert model.score(x).tolist() == plain.score(x).tolist()


# --- op7


def test_packing(docs, texts, empty):
    import tokenizers

    slow = tokenizers.Tokenizer.from_file(tokenizer_path())
    got = rows(packing.pack(packing.token_pieces(docs, tokenizer_path(), capacity=64, with_ids=True), capacity=64, rows_per_task=60, fan_in=2))
    assert len({r["sequence_id"] for r in got}) <= 1.02 * -(-sum(r["length"] for r in got) // 64) + 1
    fill = {}
    for r in sorted(got, key=lambda r: r["offset"]):
        assert r["offset"] == fill.get(r["sequence_id"], 0)
        fill[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(fill.values()) <= 64
    want = Counter()
    for i, t in texts:
        ids = slow.encode(t or "", add_special_tokens=False).ids + [0]
        first, piece, at = (len(ids) - 1) % 64 + 1, 0, 0
        while at < len(ids):
            step = first if piece == 0 else 64
            want[i, piece, at, zlib.crc32(np.array(ids[at : at + step], "<u4").tobytes())] += 1
            at, piece = at + step, piece + 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["ids_crc32"]) for r in got) == want
    assert rows(packing.pack(packing.token_pieces(empty, tokenizer_path()))) == []


def test_special_strings_and_fast_ranks_agree():
    import tokenizers

    slow = tokenizers.Tokenizer.from_file(tokenizer_path())
    for t in ["a <|endoftext|> b", "  x\n\n\ty ", "日本語 и ñ", "don't we'LL 12345", "  end ", "a" * 3000, "'s 're  \n \n"]:
        assert list(packing.encoder(tokenizer_path())(t)) == slow.encode(t, add_special_tokens=False).ids


def test_best_fit_is_tight():
    rng = np.random.default_rng(4)
    sizes = rng.integers(1, 2049, 3000)
    bins, at = packing.best_fit(sizes, 2048)
    assert (np.bincount(bins, weights=sizes) <= 2048).all() and bins.max() + 1 <= 1.02 * np.ceil(sizes.sum() / 2048)
    big = np.full(500, 1100)
    assert packing.best_fit(big, 2048)[0].max() == 499


# --- op8


def test_shards(spark, docs, texts, empty):
    got = rows(sharding.byte_shards(docs))
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in texts)
    many = spark.range(4000).selectExpr("id as doc_id", "repeat(concat('t', if(id % 3 = 0, 0, id)), 1 + cast(id % 40 as int)) as text")
    got = rows(sharding.byte_shards(many))
    total = Counter()
    for r in got:
        total[r["shard"]] += r["size"]
    assert sorted(total) == list(range(8)) and max(total.values()) < 1.05 * min(total.values())
    for k in range(8):
        assert sorted(r["slot"] for r in got if r["shard"] == k) == list(range(sum(r["shard"] == k for r in got)))
    assert rows(sharding.byte_shards(empty)) == []


def brute_shards(texts, shards=8, fine=128):
    """(doc_id, size) of each shard: groups one after another, then document by document with a list for each shard."""
    def half(t):
        h = xxhash.xxh64_intdigest((t or "").encode(), 42)
        return h - (1 << 64) if h >> 63 else h

    docs = sorted((half(t), zlib.crc32((t or "").encode()), len((t or "").encode()) + 1, i is not None, i or 0) for i, t in texts)
    total, groups = sum(d[2] for d in docs), {}
    for d in docs:
        groups.setdefault(d[:3], []).append(d)
    out, items = [[] for _ in range(shards)], []
    for key in sorted(groups):
        g = groups[key]
        if len(g) * key[2] * shards * fine > total:
            while g:
                most = max(1, total // shards // key[2])
                items.append(g[:most])
                g = g[most:]
    weight = lambda ds: sum(d[2] for d in ds)
    for item in sorted(items, key=lambda x: -weight(x)):  # stable, so by key and place on ties
        min(out, key=weight).extend(item)
    rest = [d for d in docs if len(groups[d[:3]]) * d[2] * shards * fine <= total]
    level = [weight(s) for s in out]
    while True:  # pour the rest into the emptiest shards
        least = min(level)
        low = [k for k in range(shards) if level[k] == least]
        step = min([x for x in level if x > least], default=float("inf")) - least
        if step * len(low) + sum(level) >= total:
            share = (total - sum(level)) / len(low)
            level = [x + share if k in low else x for k, x in enumerate(level)]
            break
        level = [x + step if k in low else x for k, x in enumerate(level)]
    ends, at = np.cumsum([x - weight(s) for x, s in zip(level, out, strict=True)]), 0
    spans = []
    for d in rest:
        spans.append((at, at + d[2], d))
        at += d[2]
    edge = {}
    for a, b, d in spans:
        lo, hi = edge.get(d[:3], (a, b))
        edge[d[:3]] = min(lo, a), max(hi, b)
    cuts = []
    for t in ends[:-1].astype(int).tolist():
        a, b = next((e for e in edge.values() if e[0] <= t < e[1]), (t, t))
        cuts.append(a if t - a <= b - t else b)
    for a, _, d in spans:
        out[sum(a >= c for c in cuts)].append(d)
    return [Counter((d[4] if d[3] else None, d[2]) for d in s) for s in out]


def test_shards_against_brute_force(spark, docs, texts):
    rng = np.random.default_rng(6)
    vary = [(int(i), "x" * int(rng.integers(0, 60)) + str(rng.integers(0, 400))) for i in rng.permutation(3000)]
    hot = [(i if i % 5 else None, "one text of a third") if i % 3 == 0 else (i, f"t{i * i % 1000}" * (1 + i % 40)) for i in range(3000)]
    for table in (texts, vary, hot, [(i, f"same {i % 4}" * 20) for i in range(40)], [(1, "y" * 5000), *[(i, "z") for i in range(2, 30)]]):
        got = rows(sharding.byte_shards(spark.createDataFrame(table, "doc_id long, text string")))
        want = brute_shards(table)
        assert [Counter((r["doc_id"], r["size"]) for r in got if r["shard"] == k) for k in range(8)] == want
        sizes = [sum(r["size"] for r in got if r["shard"] == k) for k in range(8)]
        if len(table) > 1000:
            assert max(sizes) < 1.01 * min(sizes)
        for k in range(8):
            assert sorted(r["slot"] for r in got if r["shard"] == k) == list(range(sum(want[k].values())))
        if table is not hot:
            same = {}
            for r, t in by_text(got, table, ("text_crc32", lambda t: zlib.crc32((t or "").encode()))):
                same.setdefault(t[1] or "", set()).add(r["shard"])
            held = Counter(t or "" for _, t in table)
            assert all(len(s) == 1 for t, s in same.items() if held[t] * (len(t.encode()) + 1) <= sum(sizes) // 8)


# --- op9


@pytest.mark.parametrize("options", [{}, {"chunk_bytes": 3000}])
def test_repeats(docs, texts, empty, options):
    raw = [(t or "").encode() for _, t in texts]
    seen = Counter(b[k : k + 200] for b in raw for k in range(len(b) - 199))
    want = []
    for (i, _), b in zip(texts, raw, strict=True):
        edge = np.zeros(len(b) + 1, int)
        for k in range(len(b) - 199):
            if seen[b[k : k + 200]] > 1:
                edge[k] += 1
                edge[k + 200] -= 1
        gone = np.cumsum(edge)[:-1] > 0
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        want.append((i, len(b), int(gone.sum()), int((np.diff(np.concatenate(([0], gone))) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    got = rows(suffix_dedup.repeats(docs, with_text=True, **options))
    assert Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == Counter(want)
    assert sum(r["by_shard"] for r in got) and (not options or sum(r["by_merge"] for r in got))
    assert all(r["by_copy"] + r["by_shard"] + r["by_merge"] == r["n_removed"] for r in got)
    assert rows(suffix_dedup.repeats(empty)) == []


@pytest.mark.parametrize("chunk_bytes", [1 << 21, 3000])
def test_repeats_but_the_first(spark, docs, texts, empty, chunk_bytes):
    """A string stays where it occurs first: by doc_id, then by place."""
    more = [(30, "zz " + texts[9][1][:700]), (29, texts[9][1][100:900] + " yy"), (31, "ab" * 400), (28, "q" * 650), (40, texts[9][1]), (2, texts[9][1]), (None, "ab" * 400)]
    texts = [*texts, *more]
    table = docs.select("doc_id", "text").unionAll(spark.createDataFrame(more, "doc_id long, text string")).coalesce(1)
    raw = [(t or "").encode() for _, t in texts]
    order = sorted(range(len(raw)), key=lambda d: (texts[d][0] is None, texts[d][0] or 0, d))
    seen, gone = {}, [np.zeros(len(b), bool) for b in raw]
    for d in order:
        for k in range(len(raw[d]) - 199):
            first = seen.setdefault(raw[d][k : k + 200], (d, k))
            if first[0] != d or first[1] <= k - 200:
                gone[d][k : k + 200] = True
    want = Counter((i, b.tobytes().decode()) for (i, _), b in ((t, np.frombuffer(r, np.uint8)[~g]) for t, r, g in zip(texts, raw, gone, strict=True)) if i not in (16,))
    got = rows(suffix_dedup.repeats(table, law="first", with_text=True, chunk_bytes=chunk_bytes))
    assert Counter((r["doc_id"], r["kept_text"]) for r in got if r["doc_id"] != 16) == want and sum(r["by_copy"] for r in got) > 1000
    again = rows(suffix_dedup.repeats(table, chunk_bytes=chunk_bytes))
    count = Counter(b[k : k + 200] for b in raw for k in range(len(b) - 199))
    total = 0
    for b in raw:
        cut = np.zeros(len(b), bool)
        for k in range(len(b) - 199):
            if count[b[k : k + 200]] > 1:
                cut[k : k + 200] = True
        total += int(cut.sum())
    assert sum(r["n_removed"] for r in again) == total
    assert rows(suffix_dedup.repeats(empty, law="first")) == []


def test_merge_of_sorted_lists():
    rng = np.random.default_rng(4)
    keys = [np.unique(rng.integers(0, 300, m).astype(np.uint64)) for m in (0, 1, 50, 90, 200, 7)]
    ids = [rng.integers(0, 5, len(k)) for k in keys]
    merged, shards, least, chunk, places = suffix_dedup.merge_lists(keys, ids, list(range(6)))
    by = {}
    for c, (k, i) in enumerate(zip(keys, ids, strict=True)):
        for x, y in zip(k.tolist(), i.tolist(), strict=True):
            by.setdefault(x, []).append((y, c))
    assert list(zip(merged.tolist(), shards.tolist(), least.tolist(), chunk.tolist(), strict=True)) == [(k, len(v), *min(v)) for k, v in sorted(by.items())]
    assert all((merged[at] == k).all() for at, k in zip(places, keys, strict=True))


def test_windows_that_share_half_a_digest():
    """Equal 64 bits of different windows don't pass for one window, across shards or inside one."""
    row = lambda chunk, pairs: {"chunk": chunk, "p1": np.array([k for k, _ in pairs], np.uint64).tobytes(), "p2": np.array([t for _, t in pairs], np.uint32).tobytes(), "p3": b""}
    said = suffix_dedup._about_windows("all")([row(1, [(5, 1), (7, 1)]), row(2, [(5, 2), (7, 1)]), row(3, [(5, 1), (5, 3)])])
    assert [np.unpackbits(np.frombuffer(x, np.uint8), count=2).tolist() for x in said] == [[1, 1], [0, 1], [1, 0]]


def test_suffix_array_and_prefixes():
    rng = np.random.default_rng(8)
    for _ in range(30):
        lens = rng.integers(6, 40, 5)
        text = rng.integers(0, 2, lens.sum()).astype(np.uint8)
        repeated, _ = suffix_dedup.shared_windows(text, lens, 6)
        ends = np.repeat(np.cumsum(lens), lens)
        raw = text.tobytes()
        valid = [p for p in range(len(raw)) if p + 6 <= ends[p]]
        count = Counter(raw[p : p + 6] for p in valid)
        assert [p for p in valid if count[raw[p : p + 6]] > 1] == np.flatnonzero(repeated).tolist()


# --- op10


def brute_ppm(counts, history, byte):
    """Bits of a byte after the bytes of ``history``, straight from the counts of one language."""
    bits = 0.0
    for order in (4, 3, 2, 1, 0):
        ctx = tuple(([None] * 4 + history)[-order:]) if order else ()
        seen = counts.get(ctx, {})
        n, d = sum(seen.values()), len(seen)
        if byte in seen:
            return bits - np.log2(seen[byte] / (n + d))
        if d:
            bits -= np.log2(d / (n + d))
    return bits + 8


def test_code_lengths_are_exact():
    """Two languages, one with letters of two and three bytes, against plain tables of counts."""
    texts = [[b"the cat sat on the mat", b"the hat", b"a", b""], ["кот сел на мат 猫が好き".encode(), "на мат".encode(), b"the"]]
    joined = lambda ts: (np.frombuffer(b"".join(ts), np.uint8), np.cumsum([0, *map(len, ts)]))
    model = langid_ppm.Model(["x", "y"], [(c, n.astype(float)) for c, n in (np.unique(langid_ppm.grams(*joined(ts)), return_counts=True) for ts in texts)])
    counts: list[dict] = [{}, {}]
    for own, ts in zip(counts, texts, strict=True):
        for t in ts:
            for k, b in enumerate(t):
                full = ([None] * 4 + list(t[:k]))[-4:]
                for order in range(5):
                    own.setdefault(tuple(full[4 - order :]), Counter())[b] += 1
    probe = [b"the cow", b"mat on", b"zz", b"", "кит 猫".encode(), bytes(range(256))]
    got = model.code_lengths(*joined(probe))
    for g, t in zip(got, probe, strict=True):
        for k, own in enumerate(counts):
            assert g[k] == pytest.approx(sum(brute_ppm(own, list(t[:i]), b) for i, b in enumerate(t)), rel=1e-5)


def test_places_find_what_is_there():
    rng = np.random.default_rng(3)
    codes = np.unique(rng.integers(0, 2**45, 5000, dtype=np.uint64))
    places = langid_ppm.Places(codes)
    assert (places.find(codes) == np.arange(len(codes))).all() and (places.find(np.setdiff1d(rng.integers(0, 2**45, 5000, dtype=np.uint64), codes)) == -1).all()
    assert (langid_ppm.Places(codes[:0]).find(codes) == -1).all()


def test_training_is_bounded(spark):
    docs = spark.createDataFrame([(i, "ab" * (2000 if i == 3 else 20), "x" if i % 2 else "y") for i in range(40)], "doc_id long, text string, lang string")
    assert langid_ppm.train(docs, train_bytes=300).langs and langid_ppm.train(docs, train_bytes=10) is None
    with pytest.raises(ValueError, match="lower train_bytes"):
        langid_ppm.train(docs, most_table=10)


def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = docs.select("doc_id", "lang").join(langid_ppm.predict(docs, langid_ppm.train(docs)), "doc_id").where("held_out").toPandas()
    assert len(got) > 100 and (got["lang"] == got["lang_pred"]).mean() > 0.98


def test_language_odd_rows(docs, texts, empty):
    model = langid_ppm.train(docs)
    got = rows(langid_ppm.predict(docs, model))
    for r, (i, t) in by_text(got, texts, ("lang_pred", lambda t: "und" if not any(c.isalpha() for c in t or "") else "en")):
        assert 0 <= r["score"] <= 1 and (r["lang_pred"] == "und") == (not any(c.isalpha() for c in t or ""))
    assert langid_ppm.train(empty) is None
    assert {r["lang_pred"] for r in rows(langid_ppm.predict(docs, None))} == {"und"} and rows(langid_ppm.predict(empty, model)) == []


def test_release(spark, docs):
    suffix_dedup.repeats(docs).count()
    path = common._made[-1][1]
    assert common.release(spark) > 1
    with pytest.raises(Exception, match="PATH_NOT_FOUND|not exist"):
        spark.read.parquet(path)


# --- the registered queries


CONTRACT = {
    "op1": "vec_id n_links component_id kept", "op2": "doc_id fingerprint component_id", "op3": "doc_id n_bytes payload_bytes payload_sha256 tail_crc32 media_bytes media_sha256 feature",
    "op4": "doc_id n_words n_removed kept_sha256", "op5": "doc_id size source_size target taken", "op6": "doc_id held_out score predicted", "op7": "doc_id piece start length ids_crc32 sequence_id offset",
    "op8": "doc_id size text_crc32 law shard slot grown_shard", "op9": "doc_id n_bytes n_removed n_spans kept_sha256", "op10": "doc_id held_out lang_pred score",
}


@pytest.fixture(scope="module")
def table():
    import pyarrow.parquet as pq

    return {r["doc_id"]: r["text"] or "" for r in pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["doc_id", "text"]).to_pylist()}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_registered_query(spark, table, name):
    """Each query over its whole table: its columns, a row (or the pieces) of every document, and what a row has to be."""
    df = queries.QUERIES[name](spark, "/root/testdata/sf0.001")
    op = name.split("_")[0]
    assert set(CONTRACT[op].split()) <= set(df.columns)
    got = rows(df)
    if op == "op1":
        assert len(got) == spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").count() and all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)
        return
    assert {r["doc_id"] for r in got} == set(table) and (op == "op7" or len(got) == len(table))
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    for r in got:
        text = table[r["doc_id"]]
        if op == "op2":
            assert r["fingerprint"] == f"{brute_fingerprint(text):016x}"
        elif op == "op3":
            payload = padded(text)
            assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(text.encode()), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
            assert sum(c["n_frames"] for c in r["clips"]) == len(payload) // 576
        elif op == "op4":
            words = text.encode().split()
            assert r["n_words"] == len(words) and (r["n_removed"] or r["kept_sha256"] == hashlib.sha256(b" ".join(words)).hexdigest()) and r["n_candidates"] <= r["n_windows"] == max(0, len(words) - 12)
        elif op == "op5":
            assert r["size"] == len(text.encode().split()) and r["taken"] <= 3 * r["size"]
        elif op == "op6":
            assert r["held_out"] == held(r["doc_id"]) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)
        elif op == "op8":
            assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(text.encode()) + 1, zlib.crc32(text.encode()), "bytes", None) and 0 <= r["shard"] < 8
        elif op == "op9":
            assert r["n_bytes"] == len(text.encode()) and r["n_removed"] == r["by_copy"] + r["by_shard"] + r["by_merge"]
        elif op == "op10":
            assert r["held_out"] == held(r["doc_id"]) and 0 <= r["score"] <= 1
    if op == "op7":
        assert max(sum(r["length"] for r in got if r["sequence_id"] == s) for s in {r["sequence_id"] for r in got}) <= 2048


def test_mixing_query_against_its_sql(spark):
    from compare import differences

    assert differences(queries.op5_mixing(spark, "/root/testdata/sf0.001"), queries.ORACLE_SQL["op5_mixing"], "/root/testdata/sf0.001") == ""


def test_near_texts_hold_pairs_of_high_similarity(spark, table):
    """Recall against the Jaccard similarity of distinct 5-word shingles, on texts with some words changed."""
    rng = np.random.default_rng(13)
    vocabulary = [f"{a}{b}{c}" for a in "bdfgkl" for b in "aeiou" for c in ("n", "r", "st", "nd", "lim", "ture")]
    base = [rng.choice(vocabulary, rng.integers(60, 400)).tolist() for _ in range(150)]
    texts = []
    for words in base:
        for changed in (0, 1, max(1, len(words) // 60)):
            own = list(words)
            for k in rng.choice(len(words), changed, replace=False):
                own[k] = str(rng.choice(vocabulary)) + "x"
            texts.append(" ".join(own))
    label = {r["doc_id"]: r["component_id"] for r in rows(simhash.near_texts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))}
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (t.split() for t in texts)]
    close = [(i, j) for i in range(len(texts)) for j in range(i // 3 * 3, i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    assert len(close) > 300 and sum(label[i] == label[j] for i, j in close) >= 0.9 * len(close)
    assert all(label[i] // 3 == i // 3 for i in label)  # unrelated texts stay apart
