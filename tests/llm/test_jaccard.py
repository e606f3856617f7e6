import random

import numpy as np

from leontia.llm import jaccard
from leontia.llm.graph import components


def shingles(t):
    w = (t or "").split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(texts):
    sets = [shingles(t) for t in texts]
    linked = [[j for j in range(len(sets)) if j != i and a and sets[j] and len(a & sets[j]) >= 0.8 * len(a | sets[j])] for i, a in enumerate(sets)]
    root = list(range(len(sets)))
    for _ in root:
        root = [min([root[i], *(root[j] for j in linked[i])]) for i in range(len(root))]
    return root, [len(x) for x in linked]


def corpus(seed, n):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    texts = [" ".join(word() for _ in range(r.randrange(1, 120))) for _ in range(n)]
    for i in range(n // 2):
        w = texts[r.randrange(len(texts))].split()
        for _ in range(r.randrange(0, 1 + len(w) // 30)):
            w[r.randrange(len(w))] = word()
        texts.append(" ".join(w))
    base = [word() for _ in range(400)]
    for _ in range(300):  # one large group of near copies, more than a bucket and a block hold
        w = list(base)
        w[r.randrange(400)] = word()
        texts.append(" ".join(w))
    passage = " ".join(word() for _ in range(60))
    texts += [f"{' '.join(word() for _ in range(100))} {passage} {' '.join(word() for _ in range(100))}" for _ in range(60)]
    return texts + ["", None, " ", "one", "one", "a b c", "a  b\tc", "é ü", texts[0]] + [texts[1]] * 30


def test_equals_brute_force(docs):
    texts = corpus(7, 150)
    root, links = brute(texts)
    rows = {r.doc_id: r for r in jaccard.similar_documents(docs(texts, extra=True)).collect()}
    assert len(rows) == len(texts)
    assert [rows[i].class_id for i in range(len(texts))] == root
    assert [rows[i].n_links for i in range(len(texts))] == links
    kept = {r.doc_id for r in jaccard.keep_one(docs(texts, extra=True)).collect()}
    assert kept == {i for i, x in enumerate(root) if i == x}


def test_recall_of_runs():
    assert jaccard.recall(jaccard.RUNS) >= jaccard.TARGET > jaccard.recall(1)


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 160)] + [(7, 7), (200, 201), (201, 200)]
    got = dict(components(spark.createDataFrame(chain, "a long, b long")).collect())
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}, 200: 200, 201: 200}


def test_components_run_no_jobs_to_compare_rounds(spark):
    spark.sparkContext.setJobGroup("components", "")
    components(spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long"))
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("components")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert 0 < len(jobs) < 60  # 67 with two joins a round


def test_empty_and_single(docs):
    assert jaccard.similar_documents(docs([])).count() == 0
    assert [tuple(r) for r in jaccard.similar_documents(docs(["only one"])).collect()] == [(0, 0, 0, 1)]


def test_keep_one_keeps_unlike_texts_and_one_of_equal_rows(spark):
    a, b, c = ("alpha beta gamma delta epsilon zeta", "one two three four five six seven", "red green blue white black grey")
    rows = [(1, a), (5, a), (5, b), (5, b), (7, c), (None, a), (None, a), (9, " "), (9, " "), (10, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS row", "2 AS hot", "3 AS salt", "4 AS likely", "5 AS root")
    kept = jaccard.keep_one(df)
    assert kept.columns == df.columns
    key = lambda x: (x[0] or 0, x[1] or "")
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=key) == sorted([(1, a), (5, b), (7, c), (None, a), (None, a), (9, " "), (9, " "), (10, None)], key=key)


def test_spread_join(spark, monkeypatch):
    from leontia.llm import common

    monkeypatch.setattr(common, "HOT", 20)
    df = spark.range(500).selectExpr("IF(id < 300, 1, id % 40) AS k", "id")
    by = spark.range(30).selectExpr("id AS k", "id * 2 AS v")
    assert sorted(common.spread_join(df, by, "k").collect()) == sorted(df.join(by, "k").collect())
    assert common.spread_join(df, by, "k", how="left").count() == 500


def test_no_pair_is_lost_where_representatives_stand_for_sets(spark, monkeypatch):
    """A bucket of near copies in several parts: few go on, and pairs with those that stay behind are joined."""
    monkeypatch.setattr(jaccard, "REPS", 40)
    r = np.random.default_rng(5)
    far = lambda s, n: np.where(np.isin(np.arange(64), r.permutation(64)[:n]), r.integers(1 << 32, size=64, dtype=np.uint32), s)
    kinds = r.integers(1 << 32, size=(3, 64), dtype=np.uint32)
    sk = np.stack([far(kinds[i % 3], r.integers(0, 8)) for i in range(900)] + [far(kinds[i % 3], r.integers(15, 34)) for i in range(300)] + [r.integers(1 << 32, size=64, dtype=np.uint32) for _ in range(100)])
    ids = r.permutation(len(sk)) * 7
    path = next(p for p in range(99) if len(jaccard._children(np.array([p], np.uint64), sk[:1], 1)[0]) == 2)
    entries = spark.createDataFrame([(int(i), path, len(sk), s.tobytes()) for i, s in zip(ids, sk)], "id long, path long, size long, sketch binary")
    told = jaccard._go_down(entries, 1).toPandas()
    edges = told[~told["child"]]
    assert len(edges) <= 1.1 * len(sk) and len(told) - len(edges) < len(sk)
    roots = dict(components(spark.createDataFrame([(int(a), int(b)) for a, b in zip(edges["rep"], edges["id"])], "a long, b long")).collect())
    assert len({roots[int(i)] for i in ids[:900]}) == 3
    # A set goes on with all its children or stays behind, and then its pairs are in its component.
    want = {int(i): len(jaccard._children(np.array([path], np.uint64), s[None], 1)[0]) for i, s in zip(ids, sk)}
    have = told[told["child"]].groupby("id").size().to_dict()
    behind = {i for i, n in want.items() if n and i not in have}
    assert all(have[i] == want[i] for i in have) and len(behind) > 500
    apart = jaccard._mismatches(sk, sk)
    pairs = [(int(ids[a]), int(ids[b])) for a, b in zip(*np.nonzero(apart <= jaccard.LOOSE)) if a < b]
    assert all(roots.get(a, a) == roots.get(b, b) for a, b in pairs if a in behind or b in behind)
