import random

import numpy as np
import pytest

from leontia.llm import mixing


@pytest.fixture(scope="module")
def tables(spark, docs):
    r = random.Random(1)
    kinds = {"high": lambda: " ".join(r.choices(["river", "stone", "light", "walks"], k=r.randrange(50, 300))) + ".", "low": lambda: " ".join(r.choices(["##", "$$x", "%%%", "&y"], k=r.randrange(20, 100))), "toxic": lambda: "you idiot " * r.randrange(5, 30) + "! scum"}
    rows = [(k, kinds[k]()) for k in r.choices(list(kinds), weights=[2, 5, 3], k=300)]
    labels = [(i, int(k == "high"), int(k == "toxic")) for i, (k, _) in enumerate(rows) if i % 3 == 0] + [(1, None, None)]
    return docs([t for _, t in rows] + ["", None], extra=True), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), [k for k, _ in rows]


def test_totals_match_targets(tables):
    df, labels, kinds = tables
    weights = {"high": 0.6, "low": 0.3, "toxic": 0.1}
    out = mixing.mix_rates(df, labels, weights).toPandas().sort_values("doc_id").reset_index(drop=True)
    assert len(out) == 302 and (out.rate >= 0).all()
    top = out[[f"p_{d}" for d in mixing.DOMAINS]].to_numpy().argmax(axis=1)
    assert np.mean([mixing.DOMAINS[t] == k for t, k in zip(top, kinds)]) > 0.97
    assert np.allclose(out[[f"p_{d}" for d in mixing.DOMAINS]].sum(axis=1), 1)
    total = out.tokens.sum()
    for d, w in weights.items():
        assert abs((out.rate * out.tokens * out[f"p_{d}"]).sum() / total - w) < 0.02


def test_terms_are_learned(spark, docs):
    r = random.Random(5)
    word = lambda: "".join(r.choices("abcdefgh", k=6))
    tail = lambda: "".join(r.choices("xyz", k=3))
    texts, labels = [], []
    for i in range(400):
        text = [word() for _ in range(60)]
        toxic = i % 4 == 0
        if toxic:  # one stem with many endings, one word; both outside ASCII and in no list
            text[10:10] = [f"réeu{tail()}", "Grœbel"] if i % 8 else [f"réeu{tail()}", f"réeu{tail()}"]
        texts.append(" ".join(text))
        if i < 200:
            labels.append((i, 1, int(toxic)))
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    terms = mixing.mine_terms(docs(texts), labels)
    assert set(terms["toxic"]) == {"réeu*", "grœbel"} and terms["low"] == []
    rows = {x.doc_id: x for x in mixing.mix_rates(docs(texts), labels).collect()}
    assert all((rows[i].p_toxic > 0.9) == (i % 4 == 0) for i in range(200, 400))
    assert max(rows[i].rate for i in range(0, 400, 4)) < min(rows[i].rate for i in range(1, 400, 4))


def test_pattern_equals_brute_force(spark):
    terms = ["abc", "abcd", "ab9*", "été*", "x"]
    texts = ["abc abcd abcde ab9 ab9zz xabc", "été étéx xété x-x", "", "ABC, abc.abcd"]
    got = [r.n for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").selectExpr(f"regexp_count(lower(t), r'{mixing.pattern(terms)}') AS n").collect()]
    assert got == [4, 4, 0, 3]


def test_rates_equal_brute_force(spark):
    r = np.random.default_rng(2)
    tokens, p = r.choice(900, 12, replace=False) + 1, r.dirichlet([0.4] * 3, 12)
    cells = spark.createDataFrame([(int(t), *map(float, q)) for t, q in zip(tokens, p)], "tokens long, " + ", ".join(f"p_{d} double" for d in mixing.DOMAINS))
    for least in (0.0, 1.0):
        got, _ = mixing.fit_rates(cells, {"high": 0.8, "low": 0.1, "toxic": 0.1}, 1.3, least)
        got = {x.tokens: x.rate for x in got.collect()}
        share, rate = tokens / tokens.sum(), np.full(12, max(1.0, least))
        for _ in range(60000):
            miss = (rate * share) @ p - 1.3 * np.array([0.8, 0.1, 0.1])
            rate = np.maximum(least, rate - 0.9 * (p @ miss + mixing.PULL * (rate - 1)))
        value = lambda q: 0.5 * (((q * share) @ p - 1.3 * np.array([0.8, 0.1, 0.1])) ** 2).sum() + mixing.PULL / 2 * (share * (q - 1) ** 2).sum()
        assert value(np.array([got[int(t)] for t in tokens])) <= value(rate) + 2e-4


def test_repeat_by_rate(spark):
    docs = spark.createDataFrame([(1, "a", 5), (2, "b", 6), (3, None, 7)], "doc_id long, text string, count int")
    rates = docs.selectExpr("doc_id", "xxhash64(text) AS text_hash", "CASE doc_id WHEN 1 THEN 2.0D WHEN 2 THEN 0.0D ELSE 1.0D END AS rate")
    assert sorted(r.doc_id for r in mixing.repeat_by_rate(docs, rates).collect()) == [1, 1, 3]
    assert mixing.repeat_by_rate(docs, rates).columns == docs.columns
    clash = docs.selectExpr("IF(doc_id = 2, NULL, doc_id) AS doc_id", "text", "1 AS rate", "2 AS same", "3 AS row", "4 AS id")
    got = mixing.repeat_by_rate(clash, clash.selectExpr("doc_id", "xxhash64(text) AS text_hash", "2.0D AS rate"))
    assert got.columns == clash.columns and sorted(r.doc_id or 0 for r in got.collect()) == [0, 0, 1, 1, 3, 3]


def test_miss_is_reported(spark, docs):
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(40)], "doc_id long, quality int, toxic int")
    rows = mixing.mix_rates(docs(["grim word " * 9 if i % 2 else "calm talk " * 9 for i in range(40)]), labels, {"high": 1.0}, least=1.0).collect()
    assert rows[0].miss_toxic > 0.3 and rows[0].miss_high < -0.3  # no rate may fall under 1


def test_without_labels_and_empty(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = mixing.mix_rates(docs(["a b c", "d"]), none).collect()
    assert len(rows) == 2 and all(abs(r.p_high - 1 / 3) < 1e-9 for r in rows)
    assert mixing.mix_rates(docs([]), none).count() == 0
