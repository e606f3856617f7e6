import random

import numpy as np
import pytest

from leontia.llm import toxicity
from leontia.llm.toxicity import Automaton, Toxicity


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, old[j] + 1, old[j - 1] + (x != y)))
    return row[-1]


def test_automaton_equals_brute_force():
    r = random.Random(2)
    terms = ["idiot", "idiots", "trash", "abc", "clown", "crown", "lowe*", "ñandú", "scum"]
    auto = Automaton(terms)
    words = {"", "said", "x" * 100, "lowe", "lowerer", "low", "ñandu", "ñand", "abcd", "lowe" + "z" * 60}
    for t in terms:
        t = t.rstrip("*")
        for _ in range(150):
            w = list(t)
            for _ in range(r.randrange(3)):
                k = r.randrange(len(w) + 1)
                w[k : k + r.randrange(2)] = r.choice(["", "a", "o", "ñ", "z"])
            words.add("".join(w))
    words = sorted(words)
    for w, code in zip(words, auto.match(words).tolist()):
        if w.startswith("lowe"):
            assert code == 1 + 2 * (terms.index("lowe*") + 1), w
            continue
        best = min((distance(w, t), i) for i, t in enumerate(terms) if not t.endswith("*") and (w == t or len(t) >= 5))
        if w in toxicity.REPORTING:
            assert code == 1
        elif best[0] > 1:
            assert code == 0, w
        else:
            edits, term = (code - 1) % 2, (code - 1) // 2 - 1
            assert edits == best[0] and distance(w, terms[term]) == edits, w


def feature_rows(model, texts):
    raw = [t.encode() for t in texts]
    return model.features(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]))


def test_quotation_scores_lower():
    model = Toxicity()
    x, hits = feature_rows(model, ["you idiot and moron", 'he said "you idiot and moron" to them', "«you idiot and moron»", "you idi0t", "", 'he "x" you idiot and moron', "said\nidiot"])
    score = model.score(x)
    assert score[0] > score[1] and score[0] > score[2] and score[5] > score[1]
    assert hits[:, 0].tolist() == [2, 2, 2, 0, 0, 2, 1] and hits[3, 1] == 1 and hits[:, 2].tolist() == [0, 2, 2, 0, 0, 0, 0]
    assert score[4] < 0.1


def test_words_do_not_cross_texts():
    _, hits = feature_rows(Toxicity(), ["idi", "ot", "scu", "m"])
    assert hits[:, 0].sum() == 0


def prose(r, n):
    return [" ".join(r.choice(["er", "an", "the", "on"]) + r.choice(["st", "ly", "ing", "ed", "ti"]) for _ in range(r.randrange(20, 80))) for _ in range(n)]


@pytest.fixture(scope="module")
def fitted(spark, docs):
    r = random.Random(4)
    texts, toxic = prose(r, 400), []
    for i in range(400):
        y = r.random() < 0.25
        if y:
            w = texts[i].split()
            for _ in range(3):
                w.insert(r.randrange(len(w)), r.choice(["grobble", "snarkwit", "vorn" + r.choice(["a", "ich", "ung", "el", "os"])]))
            texts[i] = " ".join(w)
        toxic.append(int(y))
    df = docs([*texts, "", None, "grobble " * 5000], extra=True)
    labels = spark.createDataFrame([(i, 1, y) for i, y in enumerate(toxic)] + [(401, None, None), (0, 1, toxic[0])], "doc_id long, quality int, toxic int")
    return df, toxic, toxicity.fit(df, labels)


def test_held_out_accuracy(fitted):
    df, toxic, model = fitted
    assert {"grobble", "snarkwit"} <= set(model.terms) and any(t.startswith("vorn") and t.endswith("*") for t in model.terms)
    rows = {r.doc_id: r for r in toxicity.score_documents(df, model).collect()}
    assert len(rows) == 403
    held = [i for i in range(400) if rows[i].held_out]
    assert 60 < len(held) < 140
    assert np.mean([rows[i].predicted == toxic[i] for i in held]) > 0.97
    assert rows[400].predicted == rows[401].predicted == 0 and rows[402].predicted == 1
    kept = {r.doc_id for r in toxicity.reject_toxic(df, model).collect()}
    assert kept == {i for i, r in rows.items() if not r.predicted}
    assert toxicity.reject_toxic(df, model).columns == df.columns


def test_without_labels(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs(["you idiot, you moron, you scum"]), none)
    assert model.terms == list(toxicity.SEEDS)
    assert [r.predicted for r in toxicity.score_documents(docs(["you idiot, you moron, you scum", "fine"]), model).orderBy("doc_id").collect()] == [1, 0]
    assert toxicity.score_documents(docs([]), model).count() == 0
