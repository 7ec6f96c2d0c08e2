import random

from kugiri.llm import toxicity as T


def lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_automaton_against_edit_distance():
    import random

    rng = random.Random(4)
    terms = ["idiot", "scum", "worthless", "disgusting", "loser"]
    m = T.Matcher([(t, False) for t in terms])
    tried = 0
    for _ in range(4000):
        w = list(rng.choice(terms))
        for _ in range(rng.randint(0, 3)):
            k = rng.randrange(len(w) + 1)
            op = rng.choice("dis")
            if op == "i":
                w.insert(k, rng.choice("abcdeiost"))
            elif op == "d" and k < len(w):
                del w[k]
            elif k < len(w):
                w[k] = rng.choice("abcdeiost")
        w = "".join(w)
        if not w:
            continue
        # the first letter is fixed, so the distance is that of the rest
        want = [d for t in terms if w[0] == t[0] and (d := lev(w[1:], t[1:])) <= T.allowed(len(t), False)]
        assert m.errors(w) == (min(want) if want else None), w
        tried += bool(want)
    assert tried > 500


def test_context():
    s = T.Scorer([("idiot", False), ("worthless", False)], [], frozenset())
    assert s.score("You are an idiot.")[0] >= T.THRESHOLD
    assert s.score("You are w0rthless, you id1ot")[0] >= T.THRESHOLD
    assert s.score("Some are wortless and idiott")[0] >= T.THRESHOLD
    assert s.score('The slur “idiot” was in the text')[0] < T.THRESHOLD
    assert s.score('They said "idiot" twice')[0] < T.THRESHOLD
    assert s.score("An idiom is no patio")[0] < T.THRESHOLD  # one near match alone
    assert s.score("A patio is no tower") == (0.0, 0, 0)
    assert s.score(None) == s.score("") == (0.0, 0, 0)
    far = "word " * 500
    assert s.score(f"idiott {far} idiott")[0] < s.score("idiott idiott")[0]


def test_one_misspelt_term_is_enough_in_address():
    s = T.Scorer([(w, False) for w in T.LEXICON], [], frozenset())
    for w in ("idiiot", "idoit", "diiot", "colwn", "scumm", "sucm", "vorthless", "orthless", "wrothless"):
        assert s.score(f"You are an {w}.")[0] >= T.THRESHOLD, w
        assert 0 < s.score(f"It is an {w}.")[0] < T.THRESHOLD, w
    assert s.score("I said you idiot")[0] >= T.THRESHOLD
    assert s.score("You said idiot")[0] < T.THRESHOLD
    for w in ("closer", "pitch", "scam", "boron"):
        assert s.score(f"You are at {w}.") == (0.0, 0, 0), w
    s = T.Scorer([("disgust", True)], [], frozenset({"idsgusted"}))
    assert s.match("digsusting") == 0.7 and s.match("idsgusted") == 0


def test_quotations_of_any_length():
    s = T.Scorer([("idiot", False)], [], frozenset())
    fill = "word " * 200
    for a, b in ('""', "“”", "«»", "„“", "‘’"):
        assert s.score(f"They read {a}you idiot {fill}{b} aloud.")[0] < T.THRESHOLD, a
        assert s.score(f"They read {a}{fill}\n{fill}you idiot{b} aloud.")[0] < T.THRESHOLD, a
        # what stands between two long quotations isn't quoted
        assert s.score(f"{a}{fill.strip()}{b} but you idiot {a}some more{b}")[0] >= T.THRESHOLD, a
    assert s.score('A 5" screen, you idiot, or a 6" one')[0] >= T.THRESHOLD
    assert s.score("“one\n“two\n“you idiot” they read")[0] < T.THRESHOLD
    assert s.score("“never closed, you idiot")[0] >= T.THRESHOLD
    assert T.quotations("“a „b“ ‘don’t’ c” d »e «f»") == [(0, 17), (23, 26)]
    assert len(T.quotations("«" * 200_000 + "”" * 200_000)) == 0


def test_stems_and_labels(docs, labels, clashing, none):
    assert T.Matcher([("vequ", True)]).errors("vequaire") == 0 and T.Matcher([("vequ", True)]).errors("vecu") is None
    got = {r.doc_id for r in T.toxicity(docs, labels).collect()}
    assert got == set(range(80, 100))
    assert {r.doc_id for r in T.toxicity(clashing, labels).collect()} == got
    kept = T.keep_clean(clashing, labels)
    assert kept.columns == clashing.columns
    assert kept.count() == docs.count() - 20
    assert T.toxicity(none[0], labels).count() == 0
    # the seeds alone: of 60,000 random words, in document 78, some come near them, and no label says that they are ordinary
    assert {r.doc_id for r in T.toxicity(docs, none[1]).collect()} - {78} == got


def test_terms_are_learnt(spark):
    rows = [(i, f"plain words here {'zorbla' + 'xyzw'[i % 4] + 'k' * (i % 5) if i % 2 else 'nothing'} number w{i} v{i} u{i}") for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(80)], "doc_id long, quality int, toxic int")
    scorer = T.learn(docs, labels)
    assert ("zorbla", True) in scorer.terms
    assert {r.doc_id for r in T.toxicity(docs, labels).collect()} == set(range(1, 80, 2))


def test_terms_are_learnt_at_any_length():
    """No beginning is cut: a frequent one makes the counting go on to longer ones."""
    long = "x" * 40
    assert T.beginnings([long + "tail"], None, 24).keys() == {"x" * k for k in range(4, 25)}
    assert (long + "tail" + T.END) in T.beginnings([long + "tail"], None, 48)


def test_states_are_made_again_when_they_are_forgotten(monkeypatch):
    monkeypatch.setattr(T, "REMEMBERED", 3)
    m = T.Matcher([("pathetic", False), ("idiot", False)])
    got = [m.errors(w) for w in ("pathetik", "idiot", "idiiot", "house", "pathetic")]
    assert got == [1, 0, 1, None, 0] and m.moves < 20


def test_the_scorer_runs_once(docs, labels):
    plan = T.toxicity(docs, labels)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_window_scores_against_a_loop():
    rng = random.Random(3)
    s = T.Scorer([("idiot", False), ("worthless", False)], [], frozenset())
    weight = {"idiot": 1.0, "worthless": 1.0, "worthles": 0.7, "idiott": 0.7, "wrthles": 0.4}
    for n in (0, 1, T.WINDOW - 1, T.WINDOW, T.WINDOW + 1, 300, 1000):
        for dense in (0.01, 0.1, 0.9):
            w = [rng.choice(list(weight)) if rng.random() < dense else rng.choice(["stone", "plain", "field"]) for _ in range(n)]
            sums = [sum(weight.get(x, 0) for x in w[i : i + T.WINDOW]) for i in range(len(w))]
            score, hits, quoted = s.score(" ".join(w))
            assert abs(score - max(sums, default=0)) < 1e-5 and hits == sum(x in weight for x in w) and quoted == 0
