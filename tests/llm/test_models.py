import numpy as np

from kugiri.llm import core, lm_compress, packing, quality_fm, quality_rules


def test_fm_identity():
    rng = np.random.default_rng(0)
    m = quality_fm.Model(0.3, rng.normal(size=50), rng.normal(size=(50, 4)).astype(np.float32))
    idx, x, first = np.array([3, 7, 9, 2, 3]), np.array([0.5, 1.0, -2.0, 0.1, 4.0]), np.array([0, 3, 5])
    z, _ = m.raw(first, idx, x)
    for k in range(2):
        i, xi = idx[first[k] : first[k + 1]], x[first[k] : first[k + 1]]
        pairs = sum(float(m.v[i[a]].astype(float) @ m.v[i[b]].astype(float)) * xi[a] * xi[b] for a in range(len(i)) for b in range(a + 1, len(i)))
        assert abs(z[k] - (0.3 + m.w[i] @ xi + pairs)) < 1e-4


def test_fm_features_against_counts():
    texts = [b"one two one", b"", b"One | Two!"]
    first, idx, x = quality_fm.features(texts, ["en", None, "en"], [None, None, "s"])
    extra = len(quality_fm.STATS) + 2
    assert np.diff(first).tolist() == [2 + extra, extra, 2 + extra]
    h = dict(zip(("one", "two"), (int(v >> np.uint64(49)) for v in core.tokenize([b"one two"]).hash)))
    got = dict(zip(idx[: first[1]].tolist(), x[: first[1]].tolist()))
    norm = np.hypot(np.log(3), np.log(2))
    assert abs(got[h["one"]] - np.log(3) / norm) < 1e-12 and abs(got[h["two"]] - np.log(2) / norm) < 1e-12


def check_filter(module, frame, docs, labels, clashing, none):
    got = {(r.doc_id, r.p, r.keep) for r in frame(docs, labels).collect()}
    assert len(frame(docs, labels).collect()) == docs.count()
    by = {i: (p, k) for i, p, k in got}
    good, poor = [by[i][1] for i in range(60)], [by[i][1] for i in range(100, 130)]
    assert np.mean(good) > 0.95 and np.mean(poor) < 0.1
    assert by[72] == by[73] == (0.0, False)
    assert {(r.doc_id, r.p, r.keep) for r in frame(clashing, labels).collect()} == got
    assert frame(none[0], labels).count() == 0
    assert {r.keep for r in frame(docs.where("doc_id < 60"), none[1]).collect()} == {True}


def test_fm(docs, labels, clashing, none):
    check_filter(quality_fm, quality_fm.quality, docs, labels, clashing, none)
    kept = quality_fm.keep_good(clashing, labels)
    assert kept.columns == clashing.columns


def test_rules(docs, labels, clashing, none):
    check_filter(quality_rules, quality_rules.quality_rules, docs, labels, clashing, none)


def test_rules_score_against_a_loop():
    rng = np.random.default_rng(1)
    m = quality_rules.Model(rng.normal(size=quality_rules.WORDS + quality_rules.CHARS))
    for text in (b"Alpha beta alpha", b"abc", b"", "éa ßb".encode()):
        t = core.tokenize([text])
        low = bytes(core.LOWER[np.frombuffer(text, dtype=np.uint8)])
        w = [m.w[int(h >> np.uint64(48))] for h in t.hash]
        c = []
        for i in range(len(low) - 3):
            g = int.from_bytes(low[i : i + 4], "little")
            g ^= g >> 15
            c.append(m.w[quality_rules.WORDS + ((g * 2654435761 & 0xFFFFFFFF) >> 14)])
        want = sum(sum(v) / np.sqrt(len(v)) for v in (w, c) if v)
        assert abs(m.raw([b"x y", text, b""])[1] - want) < 1e-9


def test_calibration_recovers_a_curve():
    rng = np.random.default_rng(2)
    z = rng.normal(size=20_000) * 3
    y = (rng.random(20_000) < 1 / (1 + np.exp(-(0.7 * z - 0.4)))).astype(float)
    a, b = quality_rules.calibration(z, y)
    assert abs(a - 0.7) < 0.05 and abs(b + 0.4) < 0.08


def test_lm_score(spark, docs, labels, clashing, none):
    import re

    import zstandard

    got = {r.doc_id: r for r in lm_compress.lm_score(docs, labels).collect()}
    assert len(got) == docs.select("doc_id").distinct().count()
    assert got[72].score is None and got[73].score is None
    # the general dictionary by counting words one by one
    n: dict[bytes, int] = {}
    texts = [r.text for r in docs.collect() if r.text]
    for t in texts:
        for w in re.findall(rb"[a-z0-9\x80-\xff]+", bytes(core.LOWER[np.frombuffer(t.encode(), dtype=np.uint8)])):
            n[w] = n.get(w, 0) + 1
    best = sorted((w for w in n if n[w] > 1 and len(w) > 1), key=lambda w: (-n[w] * len(w), w))
    out, room = [], lm_compress.DICTIONARY_BYTES
    for w in best:
        if len(w) + 1 > room:
            break
        out.append(w)
        room -= len(w) + 1
    d = zstandard.ZstdCompressionDict(b" ".join(reversed(out)), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    params = zstandard.ZstdCompressionParameters.from_level(3, write_content_size=False, write_checksum=False, write_dict_id=False)
    t = next(r.text for r in docs.collect() if r.doc_id == 7)
    assert got[7].general == len(zstandard.ZstdCompressor(compression_params=params, dict_data=d).compress(t.encode()))
    assert got[7].score == (got[7].general - got[7].in_domain) / got[7].general
    assert {r.doc_id: r.score for r in lm_compress.lm_score(clashing, labels).collect()} == {k: r.score for k, r in got.items()}
    assert lm_compress.lm_score(none[0], none[1]).count() == 0
    assert lm_compress.lm_score(docs, none[1]).count() == docs.count()


def test_lm_dictionaries_grow_with_the_corpus(spark):
    import random

    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(12)) for _ in range(21_000)]
    docs = spark.createDataFrame([(i, f"{w} {w}") for i, w in enumerate(words)], "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(len(words))], "doc_id long, quality int, toxic int")
    rows = lm_compress.lm_score(docs, labels).collect()
    # both models know the words of all documents, but for what zstandard's tables miss: a text whose word isn't known takes over 21 bytes
    assert len(rows) == len(words) and np.mean([max(r.in_domain, r.general) > 21 for r in rows]) < 0.2


def test_lm_overlong_word_keeps_the_others(spark):
    long = "".join(f"{i:05x}" for i in range(30_000))
    docs = spark.createDataFrame([(i, f"{long} somewhatlongerword") for i in range(2)], "doc_id long, text string")
    labels = spark.createDataFrame([(0, 1, 0), (1, 1, 0)], "doc_id long, quality int, toxic int")
    for raw in lm_compress.dictionaries(docs, labels):
        assert raw == f"somewhatlongerword {long}".encode()
    assert all(r.in_domain == r.general < len(long) // 100 for r in lm_compress.lm_score(docs, labels).collect())


def test_hilbert_neighbours_touch():
    n = 8
    cells = np.array([(a, b, c) for a in range(n) for b in range(n) for c in range(n)])
    key = packing.hilbert(cells, 3)
    assert sorted(key.tolist()) == list(range(n**3))
    walk = cells[np.argsort(key)]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_packing(docs, clashing, none):
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    words = [(i, len(core.tokenize([t.encode()]).start)) for i, t in texts if t]
    total = sum(n for _, n in words)
    got = packing.pack(docs, 512).collect()
    by_seq: dict[int, list] = {}
    for r in got:
        by_seq.setdefault(r.seq, []).append(r)
    assert sorted(by_seq) == list(range(-(-total // 512)))
    for s, rows in by_seq.items():
        rows.sort(key=lambda r: r.pos)
        at = 0
        for r in rows:
            assert r.pos == at and r.length > 0
            at += r.length
        assert at == (512 if s < max(by_seq) else total - 512 * max(by_seq))
    per: dict = {}
    for r in got:
        per[r.doc_id] = per.get(r.doc_id, 0) + r.length
    want: dict = {}
    for i, n in words:
        if n:
            want[i] = want.get(i, 0) + n
    assert per == want
    key = lambda rows: sorted((r.seq, r.pos, r.doc_id if r.doc_id is not None else -1, r.start, r.length) for r in rows)
    assert key(packing.pack(clashing.repartition(7), 512).collect()) == key(got)
    assert packing.pack(none[0]).count() == 0


def test_packing_follows_the_curve(docs):
    import pyarrow as pa

    rows = [(r.doc_id, r.text) for r in docs.collect() if r.text]
    placed = pa.Table.from_batches(packing.places([pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.int64()), pa.array([t for _, t in rows])], ["doc_id", "text"])]))
    x = np.column_stack([placed.column(f"x{k}").to_numpy() for k in range(packing.DIMS)])
    lo, hi = x.min(axis=0), x.max(axis=0)
    key = packing.hilbert(np.clip(np.floor((x - lo) / (hi - lo) * 1024), 0, 1023), 10)
    ids, n = placed.column("doc_id").to_pylist(), placed.column("n").to_pylist()
    order = sorted(range(len(ids)), key=lambda i: (key[i], ids[i] is not None, ids[i] or 0))
    at, want = 0, []
    for i in order:
        done = 0
        while done < n[i]:
            step = min(n[i] - done, 512 - at % 512)
            want.append((at // 512, at % 512, ids[i], done, step))
            at += step
            done += step
    got = [(r.seq, r.pos, r.doc_id, r.start, r.length) for r in packing.pack(docs, 512).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
