import numpy as np
from pyspark.sql import functions as F

from leontia.llm import common


def test_likely_in_loses_nothing(spark):
    df = spark.range(20000).select(F.col("id").alias("k"), F.lit("x").alias("text"))
    keys = spark.range(20000).where("id % 7 = 0").select(F.col("id").alias("k"))
    got = {r.k for r in common.likely_in(df, keys, ["k"]).collect()}
    assert got >= set(range(0, 20000, 7)) and len(got) < 1.05 * 20000 / 7
    assert common.likely_in(df, keys.where("false"), ["k"]).count() == 0 and common.likely_in(df, keys, ["k"]).columns == ["k", "text"]


def test_spans_hash_alike_wherever_they_stand():
    data = np.frombuffer(b"abcabcxabc", np.uint8)
    h = common.span_hash(common.eights(data), np.array([0, 3, 7, 1]), np.array([3, 6, 10, 4]))
    assert h[0] == h[1] == h[2] != h[3]
    data = np.frombuffer(bytes(range(60)) * 3, np.uint8)
    for n in (0, 1, 7, 8, 9, 31, 32, 60):
        h = common.span_hash(common.eights(data), np.array([0, 60, 120, 1]), np.array([n, 60 + n, 120 + n, 1 + n]))
        assert h[0] == h[1] == h[2] and (h[0] == h[3]) == (n == 0)


def test_complementary_words_of_thue_and_morse_differ():
    for k in (6, 10, 12, 16):
        bits = [bin(i).count("1") & 1 for i in range(1 << k)]
        a, b = (bytes(97 + (x ^ y) for x in bits) for y in (0, 1))
        data = np.frombuffer(a + b, np.uint8)
        h = common.span_hash(common.eights(data), np.array([0, len(a)]), np.array([len(a), 2 * len(a)]))
        words, _ = common.word_hashes(np.frombuffer(a + b" " + b, np.uint8), np.array([0, 2 * len(a) + 1]))
        assert h[0] != h[1] and words[0] != words[1]


def test_coded_is_exact():
    data = np.frombuffer(b"aa b aa  cc b", np.uint8)
    start, end, _ = common.word_spans(data, np.array([0, len(data)]))
    codes, first = common.coded(data, start, end)
    assert codes.tolist() == [0, 1, 0, 2, 1] and first.tolist() == [0, 1, 3]


def test_word_cache_starts_anew_and_keeps_long_words_out():
    calls = []

    def encode(words):
        calls.extend(words)
        return [len(w) for w in words for _ in range(2)], [2] * len(words)

    cache = common.WordCache(encode, np.int32, limit=3)
    text = b"a bb " + b"x" * 100 + b" a ccc dddd bb"
    data = np.frombuffer(text, np.uint8)
    start, end, _ = common.word_spans(data, np.array([0, len(data)]))
    for part in (slice(0, 3), slice(2, 5), slice(3, 7), slice(0, 7)):
        flat, count = cache.lookup(data, start[part], end[part])
        assert flat.tolist() == [n for n in (end - start)[part].tolist() for _ in range(2)] and count.tolist() == [2] * len(start[part])
    assert calls.count(b"x" * 100) == 3 and cache.size.n <= 4


def test_word_cache_tells_words_of_equal_hash_apart(monkeypatch):
    monkeypatch.setattr(common, "span_hash", lambda words, start, end, seed=0: (end - start).astype(np.uint64))
    cache = common.WordCache(lambda words: ([w[0] for w in words], [1] * len(words)), np.int32)
    data = np.frombuffer(b"ab cd ef ab q cd", np.uint8)
    start, end, _ = common.word_spans(data, np.array([0, len(data)]))
    for _ in range(3):
        assert cache.lookup(data, start, end)[0].tolist() == [97, 99, 101, 97, 113, 99]


def test_shingles_do_not_cross_rows():
    data = np.frombuffer(b"a b ca b c d", np.uint8)
    words, counts = common.word_hashes(data, np.array([0, 5, 5, 12]))
    assert counts.tolist() == [3, 0, 4]
    grams, n = common.shingle_hashes(words, counts, 3)
    assert n.tolist() == [1, 0, 2] and grams[0] == grams[1] != grams[2]
