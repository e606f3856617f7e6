"""Toxicity: a Levenshtein automaton intersected with a lexicon trie, and context windows around its hits.

The lexicon is mined from labelled rows (whole words, and stems that many words share) or, without
labels, is ``SEEDS``.  :class:`Automaton` is the product of its trie with the automata for at most
``EDITS`` edits, made deterministic: all words of a batch advance through one table, a character at a
time.  Every hit is weighed by its context: inside quotation marks, or soon after a verb of reporting, it
counts as quotation; hits close together count as abuse.  A logistic model over the sums of these turns
them into a score.

The lexicon and the model are fitted on at most ``MAX_LABELLED`` labelled rows of each label, those of
least hash of the id; near copies among them count once.  A term must stand in 2 % of the toxic ones, four at
least; of the ``MAX_CANDIDATES`` most frequent terms, the ``MAX_TERMS`` strongest are kept.  Scoring reads every whole text.  Language,
source, ids and labels are no inputs of a score.

Cases: a null or empty text has no hits and the score of the model's intercept; labels without a value
are not used; a document labelled more than once is used once per label; without labels of both kinds the
built-in lexicon and weights are used; repeated rows are scored each; an empty table gives an empty
result; words longer than ``MAX_LEN`` characters can match stems only.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leontia.llm.common import WordCache, batch_of, chunks, cut, row_of, shingle_hashes, word_hashes

MAX_LABELLED, MAX_CANDIDATES, MAX_TERMS = 8000, 20000, 256
EDITS, FUZZY_FROM, MAX_LEN, WINDOW = 1, 5, 32, 12
THRESHOLD = 0.3

# Insults used where no labels are given, and verbs that introduce a quotation.
SEEDS = ("clown", "disgusting", "idiot", "imbecile", "loser", "moron", "pathetic", "scum", "stupid", "trash", "worthless")
REPORTING = ("called", "calling", "dijo", "dit", "quote", "quoted", "said", "sagte", "says", "shouted", "wrote")

REPORT = -1  # the term number of a verb of reporting


class Automaton:
    """Recognises, in one pass, words within EDITS edits of a term, and words that start with a stem (``abc*``)."""

    def __init__(self, terms: list[str]):
        self.terms = list(terms)
        children: list[dict[str, int]] = [{}]
        word_at: dict[int, int] = {}
        stem_at: dict[int, int] = {}
        fuzzy = {0}
        entries = [(t, i) for i, t in enumerate(terms)] + [(t, REPORT) for t in REPORTING if t not in terms]
        for term, i in entries:
            node, text, path = 0, term.rstrip("*"), [0]
            for c in text:
                if c not in children[node]:
                    children[node][c] = len(children)
                    children.append({})
                node = children[node][c]
                path.append(node)
            (stem_at if term.endswith("*") else word_at)[node] = i
            if i != REPORT and not term.endswith("*") and len(text) >= FUZZY_FROM:
                fuzzy.update(path)
        may_edit = {n for n, i in word_at.items() if i != REPORT and n in fuzzy and len(self.terms[i]) >= FUZZY_FROM}
        self.alphabet = sorted({c for kids in children for c in kids})
        self.points = np.array([ord(c) for c in self.alphabet], np.uint32)

        def closed(states: set[tuple[int, int]]) -> frozenset:
            for node, e in list(states):
                if e < EDITS:
                    states.update((k, e + 1) for k in children[node].values() if k in fuzzy)
            return frozenset((n, e) for n, e in states if e == 0 or ((n, e - 1) not in states and n in fuzzy))

        def step(states: frozenset, c: str | None) -> frozenset:
            out: set[tuple[int, int]] = set()
            for node, e in states:
                if c is not None and c in children[node]:
                    out.add((children[node][c], e))
                if e < EDITS:
                    if node in fuzzy:
                        out.add((node, e + 1))
                    out.update((k, e + 1) for k in children[node].values() if k in fuzzy)
            return closed(out)

        def code(states: frozenset) -> int:
            """0, or 1 + 2 * (term + 1) + edits of the best term that ends here."""
            best = min(((e, word_at[n]) for n, e in states if n in word_at and (e == 0 or n in may_edit)), default=None)
            return 0 if best is None else 1 + 2 * (best[1] + 1) + best[0]

        start = closed({(0, 0)})
        number, todo, table, codes = {frozenset(): 0, start: 1}, [start], [[0] * (len(self.alphabet) + 1)], [0, code(start)]
        caught: dict[int, int] = {}
        rows: dict[int, list[int]] = {}
        while todo:
            states = todo.pop()
            row = []
            for c in [*self.alphabet, None]:
                after = step(states, c)
                stem = next((stem_at[n] for n, e in after if e == 0 and n in stem_at), None)
                if stem is not None:
                    if stem not in caught:
                        caught[stem] = len(codes)
                        codes.append(1 + 2 * (stem + 1))
                        rows[caught[stem]] = [caught[stem]] * (len(self.alphabet) + 1)
                    row.append(caught[stem])
                    continue
                if after not in number:
                    number[after] = len(codes)
                    codes.append(code(after))
                    todo.append(after)
                row.append(number[after])
            rows[number[states]] = row
        rows[0] = table[0]
        self.table = np.array([rows[i] for i in range(len(codes))], np.int32)
        self.codes = np.array(codes, np.int32)

    def match(self, words: list[str]) -> np.ndarray:
        """The code of each word: 0, or 1 + 2 * (term + 1) + edits."""
        words = [w[:MAX_LEN] for w in words]
        size = np.fromiter(map(len, words), np.int64, len(words))
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        at = np.minimum(np.searchsorted(self.points, points), max(0, len(self.points) - 1))
        classes = np.where(self.points[at] == points, at, len(self.points)) if len(self.points) else np.zeros(len(points), np.int64)
        order = np.argsort(-size, kind="stable")
        begin = (np.cumsum(size) - size)[order]
        live_at = np.searchsorted(-size[order], -np.arange(1, MAX_LEN + 1), "right")
        state = np.ones(len(words), np.int32)
        for k in range(MAX_LEN):
            n = live_at[k]
            if not n:
                break
            state[:n] = self.table[state[:n], classes[begin[:n] + k]]
        out = np.empty(len(words), np.int32)
        out[order] = self.codes[state]
        return out


_WORD = np.zeros(256, bool)
_WORD[128:] = True
for _c in b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz_":
    _WORD[_c] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
# Quotation marks outside ASCII, as UTF-8.
_MARKS = [m.encode() for m in "“”„«»"]
N_FEATURES = 6


@dataclass
class Toxicity:
    """The fitted operator: lexicon terms, weights (intercept first), and how it was fitted."""

    terms: list[str] = field(default_factory=lambda: list(SEEDS))
    weights: list[float] = field(default_factory=lambda: [-4.0, 2.0, 0.5, 0.7, 1.0, 0.3, 1.0])

    def __getstate__(self):
        return {"terms": self.terms, "weights": self.weights}

    def __setstate__(self, state):
        self.__dict__.update(state)

    def _cache(self) -> WordCache:
        key = tuple(self.terms)
        if key not in _AUTOMATA:
            _AUTOMATA.clear()
            automaton = Automaton(self.terms)

            def encode(words: list[bytes]):
                codes = automaton.match([w.decode("utf-8", "replace").lower() for w in words])
                return codes[codes > 0], codes > 0

            _AUTOMATA[key] = WordCache(encode, np.int32)
        return _AUTOMATA[key]

    def hits(self, data: np.ndarray, off: np.ndarray):
        """(row, word number in the text, term, edits, quotation weight) of each hit, and words per row."""
        data = _LOWER[data]
        raw = data.tobytes()
        marked = np.zeros(len(data), bool)
        toggle = data == 34
        for m in _MARKS:
            at = -1
            while (at := raw.find(m, at + 1)) >= 0:
                toggle[at] = marked[at : at + len(m)] = True
        word = np.zeros(len(data) + 2, bool)
        word[1:-1] = _WORD[data] & ~marked
        first, last = word[1:-1] & ~word[:-2], word[1:-1] & ~word[2:]
        inner = off[1:-1][(off[1:-1] > 0) & (off[1:-1] < len(data))]
        first[inner] |= word[1:-1][inner]
        last[inner - 1] |= word[1:-1][inner - 1]
        start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
        counts = np.diff(np.searchsorted(start, off))
        if not len(start):
            none = np.zeros(0, np.int64)
            return none, none, none, none, np.zeros(0), counts
        codes, found = self._cache().lookup(data, start, end)
        place = np.flatnonzero(found)
        term, edits = (codes - 1) // 2 - 1, (codes - 1) % 2
        row, at = row_of(counts)[place], place - (np.cumsum(counts) - counts)[row_of(counts)[place]]
        said = place[term == REPORT]
        real = term != REPORT
        place, row, at, term, edits = place[real], row[real], at[real], term[real], edits[real]
        run = np.concatenate([[0], np.cumsum(toggle)])
        breaks = np.unique(np.concatenate([off, np.flatnonzero(data == 10) + 1]))
        line = np.searchsorted(breaks, start[place], "right") - 1
        lo, hi = breaks[line], breaks[np.minimum(line + 1, len(breaks) - 1)]
        quoted = ((run[start[place]] - run[lo]) % 2 == 1) & (run[hi] > run[start[place]])
        near = np.searchsorted(said, place) - np.searchsorted(said, np.maximum(place - WINDOW // 2, place - at)) > 0
        return row, at, term, edits, np.where(quoted, 0.8, 0.0) + np.where(near, 0.2, 0.0), counts

    def features(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(features of each text, hits of each text)."""
        row, at, term, edits, quote, counts = self.hits(data, off)
        n = len(counts)
        add = lambda w: np.bincount(row, weights=w, minlength=n)
        exact, fuzzy = edits == 0, edits > 0
        key = row.astype(np.int64) << 32 | at
        close = np.searchsorted(key, key + WINDOW, "right") - np.arange(len(key))
        densest = np.zeros(n)
        np.maximum.at(densest, row, (close * exact).astype(float))
        kinds = np.bincount(np.unique(row * (len(self.terms) + 1) + term) // (len(self.terms) + 1), minlength=n) if len(row) else np.zeros(n)
        own = add(exact * (1 - quote))
        x = np.stack([own, add(exact * quote), add(fuzzy * (1 - quote)), densest, 1000 * own / (counts + 50), kinds], axis=1)
        return np.log1p(x), np.stack([add(exact), add(fuzzy), add(quote > 0.5)], axis=1).astype(np.int64)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.weights[0] + x @ np.array(self.weights[1:]), -40, 40)))


_AUTOMATA: dict[tuple, WordCache] = {}
_TOKEN = regex.compile(r"\w+")


def _terms_of(text: str) -> set[str]:
    """The distinct words of a text, and their stems of 4 to 7 characters."""
    words = set(_TOKEN.findall((text or "").lower()))
    out = {w for w in words if 3 <= len(w) < MAX_LEN - EDITS}
    for k in range(4, 8):
        out.update(w[:k] + "*" for w in words if len(w) > k)
    return out


def _counts(rows: DataFrame, only: frozenset | None) -> DataFrame:
    """Number of rows that hold each term."""

    def run(batches):
        for batch in batches:
            found: Counter = Counter()
            for t in batch.column("text").to_pylist():
                terms = _terms_of(t)
                found.update(terms if only is None else terms & only)
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["term", "n"])

    return rows.select("text").mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))


def _distinct(rows: DataFrame) -> DataFrame:
    """Of rows of one label that agree in their least and their greatest shingle, one: near copies count once."""
    schema = pa.schema([("row", pa.string()), ("low", pa.int64()), ("high", pa.int64())])

    def run(batches):
        for batch in batches:
            for i, j, data, off in chunks(batch):
                words, counts = word_hashes(data, off)
                grams, n = shingle_hashes(words, counts, 5)
                end = np.cumsum(n)
                low, high = (np.array([int(f(grams[e - k : e])) if k else 0 for e, k in zip(end.tolist(), n.tolist())], np.uint64) for f in (np.min, np.max))
                yield batch_of(schema, row=batch.column("row").slice(i, j - i), low=low.view(np.int64), high=high.view(np.int64))

    keyed = rows.select("row", "text").mapInArrow(run, "row string, low long, high long")
    once = keyed.groupBy(F.substring("row", 1, 1), "low", "high").agg(F.min("row").alias("row")).select("row")  # a row's name starts with its label
    return rows.join(once, "row", "left_semi")


def _choose(pos: dict[str, int], neg: dict[str, int], n_pos: int, n_neg: int) -> list[str]:
    """Terms far more frequent in toxic texts; a stem only where no single word explains it."""
    least = max(4, 0.02 * n_pos)
    ratio = {t: (n / n_pos) / ((neg.get(t, 0) + 0.5) / n_neg) for t, n in pos.items() if n >= least}
    good = {t for t, r in ratio.items() if r >= 8 and neg.get(t, 0) <= 0.02 * n_neg}
    word_best: dict[str, int] = {}
    for w, n in pos.items():
        if not w.endswith("*"):
            for k in range(4, 8):
                if len(w) > k:
                    word_best[w[:k]] = max(word_best.get(w[:k], 0), n)
    stems: list[str] = []
    for t in sorted((t[:-1] for t in good if t.endswith("*")), key=lambda t: (len(t), t)):
        if pos[t + "*"] > 1.5 * word_best.get(t, 0) and not any(t.startswith(s) for s in stems):
            stems.append(t)
    terms = [s + "*" for s in stems] + [w for w in good if not w.endswith("*") and not any(w.startswith(s) for s in stems)]
    return sorted(terms, key=lambda t: (-pos[t] * math.log(ratio[t]), t))[:MAX_TERMS]


def _fit(x: np.ndarray, y: np.ndarray, share: float, penalty: float = 1e-2) -> list[float]:
    """Logistic regression by Newton's method; the intercept is moved to the share of label 1 among all labelled rows."""
    a = np.hstack([np.ones((len(x), 1)), x])
    w = np.zeros(a.shape[1])
    weight = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum())) * len(y)
    ridge = penalty * np.diag([0.0] + [1.0] * x.shape[1]) * len(y) / 10
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        grad = a.T @ (weight * (p - y)) + ridge @ w
        hess = (a * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ a + ridge + 1e-9 * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    w[0] += math.log(share / (1 - share))
    return w.tolist()


def in_training(doc_id):
    """Whether labels of a row may be learned from: crc32 of the id as text, mod 4, is not 2."""
    return F.crc32(F.encode(doc_id.cast("string"), "utf-8")) % 4 != 2


def fit(docs: DataFrame, labels: DataFrame) -> Toxicity:
    usable = labels.where(F.col("toxic").isin(0, 1) & in_training(F.col("doc_id"))).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    totals = {r["toxic"]: r["count"] for r in usable.groupBy("toxic").count().collect()}
    if len(totals) < 2:
        return Toxicity()
    picked = [usable.where(F.col("toxic") == t).orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_LABELLED) for t in (0, 1)]
    sample = F.broadcast(picked[0].unionByName(picked[1]).distinct())  # at most 2 * MAX_LABELLED ids
    rows = docs.select("doc_id", "text").join(sample, "doc_id").withColumn("row", F.concat_ws(":", F.col("toxic").cast("string"), F.col("doc_id").cast("string"), F.md5(F.coalesce("text", F.lit("")))))
    rows = cut(_distinct(cut(rows)))
    n = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    if len(n) < 2:
        return Toxicity()
    top = _counts(rows.where("toxic = 1"), None).where(F.col("n") >= max(3, 0.01 * n[1])).orderBy(F.desc("n"), "term").limit(MAX_CANDIDATES)
    pos = {r["term"]: r["n"] for r in top.collect()}
    neg = {r["term"]: r["n"] for r in _counts(rows.where("toxic = 0"), frozenset(pos)).collect()}
    model = Toxicity(_choose(pos, neg, n[1], n[0]) or list(SEEDS))

    def run(batches):
        for batch in batches:
            for i, j, data, off in chunks(batch):
                x, _ = model.features(data, off)
                yield pa.RecordBatch.from_arrays([batch.column("toxic").slice(i, j - i), pa.array(list(x), pa.list_(pa.float64()))], ["toxic", "x"])

    found = rows.select("text", "toxic").mapInArrow(run, "toxic int, x array<double>").toPandas()
    model.weights = _fit(np.array(found["x"].tolist()), found["toxic"].to_numpy(float), totals[1] / (totals[0] + totals[1]))
    return model


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("predicted", pa.int32()), ("n_exact", pa.int64()), ("n_fuzzy", pa.int64()), ("n_quoted", pa.int64())])


def score_documents(docs: DataFrame, model: Toxicity) -> DataFrame:
    """One row a document: doc_id, held_out, score, predicted, and its numbers of exact, misspelled and quoted hits."""

    def run(batches):
        for batch in batches:
            for i, j, data, off in chunks(batch):
                x, hits = model.features(data, off)
                score = model.score(x)
                yield batch_of(_SCHEMA, doc_id=batch.column("doc_id").slice(i, j - i), score=score, predicted=(score >= THRESHOLD).astype(np.int32), n_exact=hits[:, 0], n_fuzzy=hits[:, 1], n_quoted=hits[:, 2])

    scored = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double, predicted int, n_exact long, n_fuzzy long, n_quoted long")
    return scored.select("doc_id", (~in_training(F.col("doc_id"))).alias("held_out"), "score", "predicted", "n_exact", "n_fuzzy", "n_quoted")


def reject_toxic(docs: DataFrame, model: Toxicity) -> DataFrame:
    """The documents whose score is under THRESHOLD, with all their columns."""
    schema = docs.schema

    def run(batches):
        for batch in batches:
            for i, j, data, off in chunks(batch):
                x, _ = model.features(data, off)
                yield batch.slice(i, j - i).filter(pa.array(model.score(x) < THRESHOLD))

    return docs.mapInArrow(run, schema)
