import hashlib
import random

from leontia.llm import repeats


def brute(rows):
    """rows: (doc_id, text) in any order."""
    seen, out = set(), {}
    raw = sorted((d, (t or "").encode()) for d, t in rows)
    for d, b in raw:
        gone, new = bytearray(len(b)), []
        for i in range(len(b) - 99):
            w = b[i : i + 100]
            if w in seen:
                gone[i : i + 100] = b"\1" * 100
            else:
                seen.add(w)
        spans = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out[d] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def corpus(seed):
    r = random.Random(seed)
    text = lambda n: "".join(r.choice("abcdeé \n") for _ in range(n))
    texts = [text(r.randrange(0, 700)) for _ in range(60)]
    for _ in range(60):
        a = r.choice(texts)
        i = r.randrange(len(a) + 1)
        b = list(a[i : i + r.randrange(60, 400)])
        for _ in range(r.randrange(3)):
            if b:
                b[r.randrange(len(b))] = "#"
        texts.append(text(r.randrange(150)) + "".join(b) + text(r.randrange(150)))
    texts += ["a" * 99, "a" * 100, "a" * 101, "a" * 350, "ab" * 120, "ab" * 120, "x" + "ab" * 120, "", None, texts[3], texts[3] + texts[4], "ñ" * 80, "z" + "ñ" * 80, "\n" * 250]
    return texts


def test_equals_brute_force(docs):
    for seed in range(3):
        texts = corpus(seed)
        random.Random(seed).shuffle(texts)
        want = brute(list(enumerate(texts)))
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.remove_repeats(docs(texts, extra=True)).collect()}
        assert got == want


def test_ids_decide_not_rows(spark):
    p = "".join(random.Random(9).choices("abcdef", k=300))
    rows = [(9, p), (2, "q" + p), (5, p[50:250])]
    got = {r.doc_id: r.n_removed for r in repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {9: 300, 2: 0, 5: 200}


def test_repeated_ids_and_empty(spark, docs):
    p = "".join(random.Random(9).choices("abcdef", k=300))
    rows = [(1, p), (1, p), (2, p), (1, "another text " + p), (None, p)]
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_removed) for r in repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(0, 300, 0), (1, 300, 0), (1, 300, 0), (1, 313, 300), (2, 300, 300)]
    assert repeats.remove_repeats(docs([])).count() == 0
