import random

import numpy as np
import pytest

from kugiri.llm import core, jaccard


def ngrams(text):
    import re

    w = re.findall("[a-z0-9\x80-\U0010ffff]+", "".join(c.lower() if c.isascii() else c for c in text))
    return {tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) > 2 else {tuple(w)} if w else set()


def brute(rows, threshold):
    """The similarities of pairs of classes, and (class_id, n_links) of every document."""
    sets = {}
    for i, t in rows:
        if i is not None:
            got = frozenset(ngrams(t)) if t else frozenset()
            sets[i] = min((x for x in (sets.get(i), got) if x), key=sorted, default=frozenset())
    near = {(a, b): s for a in sets for b in sets if a < b and sets[a] and sets[b] and (s := len(sets[a] & sets[b]) / len(sets[a] | sets[b])) >= threshold}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = dict.fromkeys(sets, 0)
    for a, b in near:
        links[a] += 1
        links[b] += 1
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    first = {}
    for i in sorted(sets):
        first.setdefault(sets[i], i)
    pairs = {(a, b): s for (a, b), s in near.items() if first[sets[a]] == a and first[sets[b]] == b and sets[a] != sets[b]}
    return pairs, {i: (find(i), links[i]) for i in sets}


def rows_of(df):
    return {(r.doc_a, r.doc_b): r.jaccard for r in df.collect()}


def classes_of(df):
    got = df.collect()
    assert len({r.doc_id for r in got}) == len(got)
    return {r.doc_id: (r.class_id, r.n_links) for r in got}


@pytest.mark.parametrize("which", ["docs", "clashing"])
def test_against_brute_force(request, which):
    df = request.getfixturevalue(which)
    pairs, classes = brute([(r.doc_id, r.text) for r in df.select("doc_id", "text").distinct().collect()], 0.5)
    assert (0, 60) in pairs and classes[70][0] == classes[71][0] == 0 and classes[76] == (75, 1) and classes[72] == (72, 0) and classes[0][1] == 3
    assert classes_of(jaccard.jaccard_join(df)) == classes
    assert rows_of(jaccard.jaccard_pairs(df)) == pairs
    kept = jaccard.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(map(repr, kept.collect())) == sorted(repr(r) for r in df.collect() if r.doc_id is None or classes[r.doc_id][0] == r.doc_id)


@pytest.fixture(scope="module")
def edited(spark):
    """Documents with a copy each that is edited to about the threshold, and passages that many share."""
    rng = random.Random(2)
    rows = []
    passages = [[f"p{k}x{i}" for i in range(60)] for k in range(3)]
    for k in range(150):
        base = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice([12, 40, 150, 700]))]
        if k % 2:
            base += passages[k % 3]
        rows.append((2 * k, " ".join(base)))
        copy = list(base)
        for i in rng.sample(range(len(copy)), max(1, len(copy) // rng.choice([9, 11, 15, 30]))):
            copy[i] = f"x{rng.randrange(10**6)}"
        rows.append((2 * k + 1, " ".join(copy)))
    return rows


@pytest.mark.parametrize("threshold", [0.3, 0.5, 1.0])
def test_no_pair_is_lost(spark, edited, threshold):
    df = spark.createDataFrame(edited, "doc_id long, text string").repartition(3)
    pairs, classes = brute(edited, threshold)
    assert (len(pairs) > 100) == (threshold < 0.8)
    assert rows_of(jaccard.jaccard_pairs(df, threshold)) == pairs
    if threshold == 0.3:
        assert classes_of(jaccard.jaccard_join(df, threshold)) == classes


def alike(n):
    rng = random.Random(3)
    rows = []
    for i in range(n):
        w = [f"w{i}" for i in range(120)]
        w[rng.randrange(120)] = f"y{i}"
        rows.append((i, " ".join(w)))
    return rows + [(n + i, rows[7][1]) for i in range(n)]


def test_a_group_of_half_of_all_rows_in_parts(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "PART", 20_000)  # 28 sets of 118 grams: the tile of the group is cut in parts
    rows = alike(150)
    pairs, classes = brute(rows, 0.5)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert classes_of(jaccard.jaccard_join(df)) == classes and set(classes.values()) == {(0, 299)}
    assert rows_of(jaccard.jaccard_pairs(df)) == pairs


def test_small_batches_and_sorted_sets_give_the_same():
    rows = alike(20)
    pairs, _ = brute(rows, 0.5)
    grams = [np.unique(core.grams(core.tokenize([t.encode()]))[0] >> np.uint64(16)) for _, t in rows[:20]]
    size, none = np.array([len(g) for g in grams]), [np.zeros(0, dtype=np.int64)] * 20

    def got():
        return {(int(min(a, b)), int(max(a, b))): s for x, y, z in jaccard.linked(np.arange(20), size, grams, None, none, 0.5) for a, b, s in zip(x, y, z)}

    assert got() == pairs
    bits, jaccard.BITS = jaccard.BITS, 0
    try:
        assert got() == pairs
    finally:
        jaccard.BITS = bits


def test_rows_that_repeat_an_id_count_once(spark):
    """The set that only a row without say holds is no one's; that of the row with the least set is found although another row listed it first."""
    rows = [(3, "a b c d e f g h"), (3, "q r s t u v w x"), (5, "a b c d e f g h"), (6, "q r s t u v w x"), (7, "a b c d e f g i"), (8, None), (8, "q r s t u v w y")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(1)
    got = classes_of(jaccard.jaccard_join(df))
    assert set(got) == {3, 5, 6, 7, 8} and got[5][0] == got[7][0] and got[6][0] == got[8][0] and got[3][0] == 3 and got[3][1] == 2


def test_empty(none):
    assert jaccard.jaccard_join(none[0]).count() == 0 and jaccard.jaccard_pairs(none[0]).count() == 0
    with pytest.raises(ValueError):
        jaccard.jaccard_join(none[0], 0)


def test_packed_lists_are_as_they_were():
    rng = np.random.default_rng(4)
    a, b = np.sort(rng.integers(0, 1 << 48, 1000, dtype=np.uint64)), rng.integers(0, 1 << 32, 1000, dtype=np.uint64)
    x, y = jaccard.unpack(jaccard.pack((jaccard.rises(a), 6), (b, 4)), 6, 4)
    assert (np.cumsum(x, dtype=np.uint64) == a).all() and (y == b).all() and (jaccard.unsix(jaccard.six(a)) == a).all()


def test_tree_never_loses_a_pair():
    rng = np.random.default_rng(1)
    points = rng.poisson(1.5, (90, 16)).astype(np.int32)
    points[1::2] = np.maximum(points[::2] + rng.integers(-1, 2, (45, 16)), 0)
    totals = points.sum(axis=1)
    got = {tuple(sorted(p)) for a, b in jaccard.Tree(points, totals).pairs(0.6) for p in zip(a.tolist(), b.tolist())}
    want = {(i, j) for i in range(90) for j in range(i + 1, 90) if np.minimum(points[i], points[j]).sum() >= jaccard.least_overlap(totals[i], totals[j], 0.6)}
    assert got == want


def test_groups(spark):
    df = spark.createDataFrame([(1, 2, 1.0), (3, 2, 1.0), (3, 4, 1.0), (9, 8, 1.0), (8, 7, 0.9)], "doc_a long, doc_b long, jaccard double")
    assert {(r.doc_id, r.keep) for r in jaccard.groups(df).collect()} == {(2, 1), (3, 1), (4, 1), (8, 7), (9, 7)}


def test_tokens_do_not_depend_on_the_batch():
    a = core.grams(core.tokenize([b"one Two three four", b"", b"one two three"]))
    b = core.grams(core.tokenize([b"one two THREE"]))
    assert (a[2] == b[0]).all() and b[0][0] in a[0] and len(a[1]) == 0
