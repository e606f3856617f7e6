import random
import re
import zlib
from collections import Counter

import numpy as np

from leontia.llm import quality, sharding

TEXTS = ["", None, " \n\t ", "one", "a b", "a b c a b c", "x #$ %%\nx #$ %%\n\nx #$ %%", "ñ é 漢字 😀\r\nñ é", "l\n l\nl\nl ", "\n\n\n", "a\x00b \x1fc", "nb sp"]
TEXTS += [" ".join(random.Random(i).choice(["ab", "c#", "dé", "\n"]) for _ in range(i)) for i in range(60)]


def brute(t):
    t = t or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    twice = {g for g, n in Counter(grams).items() if n > 1}
    covered = {i + k for i, g in enumerate(grams) if g in twice for k in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def test_counts_equal_brute_force(docs):
    rows = {r.doc_id: r for r in quality.quality_verdicts(docs(TEXTS, extra=True)).collect()}
    assert len(rows) == len(TEXTS)
    for i, t in enumerate(TEXTS):
        r = rows[i]
        want = brute(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, t
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.base_failed and r.kept)


def prose(r, n):
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randrange(2, 9))) for _ in range(n))


def test_mcd_finds_outliers_despite_masking(docs):
    r = random.Random(3)
    clean = [(prose(r, r.randrange(60, 400)), "en", None) for _ in range(120)]
    junk = [(prose(r, 80).replace(" ", "### "), "en", None) for _ in range(25)]
    few = [(prose(r, 70), None, "tiny")] * 3
    rows = {x.doc_id: x for x in quality.quality_verdicts(docs(clean + junk + few)).collect()}
    assert all(rows[i].kept for i in range(120))
    assert not any(rows[i].kept for i in range(120, 145))
    assert all(rows[i].kept and rows[i].distance2 is None for i in range(145, 148))


def test_small_groups_are_judged(docs):
    r = random.Random(4)
    junk = lambda: prose(r, 80).replace(" ", "### ")
    clean = [(prose(r, r.randrange(60, 400)), "en", f"s{i % 6}") for i in range(120)]  # 20 in each group
    few = [(junk(), "en", f"s{i % 3}") for i in range(9)] + [(junk(), None, "rare"), (junk(), "xx", None)]
    rows = {x.doc_id: x for x in quality.quality_verdicts(docs(clean + few)).collect()}
    assert all(rows[i].kept for i in range(120)) and not any(rows[i].kept or rows[i].base_failed for i in range(120, 131))
    assert {rows[i].judged_by for i in range(129)} == {"lang"} and {rows[i].judged_by for i in (129, 130)} == {"all"}
    rows = [x for x in quality.quality_verdicts(docs(clean[:20] + few[:3])).collect() if not x.base_failed]  # fewer than MIN_ROWS in all
    assert [x.kept for x in sorted(rows, key=lambda x: x.doc_id)] == [True] * 20 + [False] * 3


def test_mcd_constants():
    assert abs(quality.chi2_quantile(0.95, 5) - 11.0705) < 1e-3
    assert abs(quality.consistency(0.75, 5) - 1.32) < 0.15


def test_empty(docs):
    assert quality.quality_verdicts(docs([])).count() == 0
    assert sharding.shard_documents(docs([])).count() == 0


def test_sharding(docs):
    texts = ["", None, "x", "é漢", "x"] + [f"text {i}" for i in range(600)]
    rows = sharding.shard_documents(docs(texts, extra=True)).collect()
    assert len(rows) == len(texts)
    slots = {}
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law) == (len(raw) + 1, zlib.crc32(raw), "key")
        assert r.grown_shard in (r.shard, 16) and 0 <= r.shard < 16
        assert (r.region, r.rack) == (r.shard // 4, r.shard // 2 % 2)
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and len(slots) == 16
    assert 10 <= sum(r.grown_shard == 16 for r in rows) <= 80


def test_weight_change_is_confined(spark):
    keys = spark.range(3000)
    old = {r.id: r for r in sharding.assign(keys, keys.id, sharding.DEFAULT_TREE).collect()}
    heavy = {r: {k: dict(s) for k, s in racks.items()} for r, racks in sharding.DEFAULT_TREE.items()}
    heavy[2][1][11] = 3
    moved = [(old[r.id], r) for r in sharding.assign(keys, keys.id, heavy).collect() if r.shard != old[r.id].shard]
    assert moved and all(b.region == 2 for _, b in moved)
    assert all(b.rack == 1 for a, b in moved if a.region == 2) and all(b.shard == 11 for a, b in moved if (a.region, a.rack) == (2, 1))
    assert np.mean([b.shard == 11 for _, b in moved]) > 0.5
