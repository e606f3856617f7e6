"""N-gram Jaccard join: chosen-path recursion over the shingles that sets share.

Sets are the hashed windows of ``SHINGLE`` words (white space parts words; a shorter text is one window).
Equal sets are one class from the start.  A set is embedded as ``SKETCH`` minwise tokens, each shared by
two sets with the probability of their similarity.  The recursion, in ``RUNS`` independent runs: a set
enters, from each node it is in, the children named by those of its tokens that the node samples
(``BRANCH`` in expectation); a bucket of at most ``BUCKET`` sets is compared by brute force; larger ones go
on to their children, down to ``DEPTH``, where a bucket's sets share so many independent tokens that they
are taken together as candidates.  ``RUNS`` is chosen from :func:`recall` for the target recall of a pair
at the threshold; a pair that is missed is still found if both are linked with a third set.

Members of a dense bucket need not all go on.  The number of tokens in which sketches differ is a metric, and sets taken for a
pair differ in at most ``LOOSE``.  So whatever pairs with a set that differs from a representative of the bucket (some ``REPS``
members) in at most ``STANDS`` tokens differs from that representative in at most ``STANDS + LOOSE``: all sets that near become
candidates with the representative, those within ``STANDS`` stay behind, and no pair of the bucket is lost.

Candidates only decide which texts are brought together; links are exact, on the sets themselves:

1. Every set of a group is compared with the group's representative, whose text goes once to each block of
   the group.  One minus the similarity is a metric, so two sets whose distances to the representative sum to at most 0.2
   are linked without being compared: sets within half of that are ``tight`` and link one another, a
   count for the whole group.  A group of a million close copies costs a million comparisons.
2. The pairs with a set that is not tight are compared in blocks of about ``BLOCK_BYTES`` of text; a pair's links
   are counted where they are found and never written out.

Classes are the connected components of exact links.

Cases: a null text counts as empty; a null doc_id is in no class; a text without words is a class by itself without links; repeated rows and
equal texts are links of each other; rows that share a doc_id but not their text are judged each by its text; an empty table gives an empty result; very long texts are whole sets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leontia.llm.common import batch_of, chunks, counter_hash, cut, likely_in, mix, row_of, shingle_hashes, spread_join, trim, word_hashes
from leontia.llm.graph import components

SHINGLE, THRESHOLD = 5, 0.8
SKETCH, BRANCH, DEPTH, BUCKET, TARGET = 64, 1.6, 4, 24, 0.99
BLOCK, BLOCK_BYTES = 1024, 1 << 20  # the most sets of a block in expectation, and the text they hold
#: Sketches of two sets at the threshold agree in fewer than this share of tokens with probability under 1e-4.
SKETCH_LEAST = 0.58
#: Most mismatches of a pair by that; mismatches up to which a representative stands for a set; representatives of a bucket, and sets of a part of it, in expectation.
LOOSE, STANDS, REPS, PART = int(SKETCH * (1 - SKETCH_LEAST)), 12, 64, 256

_U = np.uint64


def recall(runs: int, depth: int = DEPTH, similarity: float = THRESHOLD) -> float:
    """Chance that two sets of a similarity share a path of full depth in some run (a branching process)."""
    p = 0.0  # chance that the pair dies out
    mean = BRANCH * similarity
    for _ in range(depth):
        p = float(np.exp(-mean * (1 - p)))
    return 1 - p**runs


RUNS = next(n for n in range(1, 100) if recall(n) >= TARGET)


# ---- sets and sketches

_MUL = counter_hash(SKETCH, 21) | _U(1)
_ADD = counter_hash(SKETCH, 22)


def sketches(grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """(rows, SKETCH) of uint32 minwise tokens; rows without shingles get zeros."""
    out = np.zeros((len(counts), SKETCH), np.uint32)
    full = np.flatnonzero(counts)
    if len(full):
        start = (np.cumsum(counts) - counts)[full]
        for k in range(SKETCH):
            out[full, k] = np.minimum.reduceat((grams * _MUL[k] + _ADD[k]) >> _U(32), start)
    return out


def set_hashes(grams: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(low, high, size) of each row's set of shingles: two hashes of the set, and the number of its members."""
    row = row_of(counts)
    order = np.lexsort((grams, row))
    g, r = grams[order], row[order]
    first = np.ones(len(g), bool)
    first[1:] = (g[1:] != g[:-1]) | (r[1:] != r[:-1])
    g, r = g[first], r[first]
    size = np.bincount(r, minlength=len(counts))
    at = np.concatenate([[0], np.cumsum(size)])
    low, high = (np.concatenate([np.zeros(1, _U), np.cumsum(mix(g * _U(m) + _U(a)))]) for m, a in ((3, 5), (7, 11)))
    return low[at[1:]] - low[at[:-1]], high[at[1:]] - high[at[:-1]], size


_SETS = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("low", pa.int64()), ("high", pa.int64()), ("n", pa.int64()), ("bytes", pa.int64()), ("sketch", pa.binary())])


def set_table(docs: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            for i, j, data, off in chunks(batch):
                words, counts = word_hashes(data, off)
                grams, n = shingle_hashes(words, counts, SHINGLE)
                low, high, size = set_hashes(grams, n)
                sk = sketches(grams, n)
                yield batch_of(_SETS, doc_id=batch.column("doc_id").slice(i, j - i), text_hash=batch.column("text_hash").slice(i, j - i), low=low.view(np.int64), high=high.view(np.int64), n=size, bytes=np.diff(off), sketch=[s.tobytes() for s in sk])

    return docs.select("doc_id", "text_hash", "text").mapInArrow(run, "doc_id long, text_hash long, low long, high long, n long, bytes long, sketch binary")


# ---- the recursion


def _children(path: np.ndarray, sketch: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of the parent entry, path of the child) of the children that each entry goes on to."""
    at = np.arange(SKETCH, dtype=_U) * _U(0x9E3779B97F4A7C15)
    chosen = mix(path[:, None] + at + _U(depth)) >> _U(11) < _U(int(BRANCH / SKETCH * (1 << 53)))
    entry, token = np.nonzero(chosen)
    return entry, mix(path[entry] * _U(0xC2B2AE3D27D4EB4F) + mix(at[token] + sketch[entry, token].astype(_U)))


def _enter(sets: DataFrame) -> DataFrame:
    """(id, path) of the children of the roots of all runs."""
    roots = mix(np.arange(1, RUNS + 1, dtype=_U) * _U(0xD1B54A32D192ED03))

    def run(frames: Iterator[pd.DataFrame]):
        for f in frames:
            for i in range(0, len(f), 8192):
                part = f.iloc[i : i + 8192]
                sk, ids = _sketch_matrix(part["sketch"]), part["id"].to_numpy()
                for root in roots:
                    parent, path = _children(np.full(len(part), root), sk, 0)
                    yield pd.DataFrame({"id": ids[parent], "path": path.view(np.int64)})

    return sets.mapInPandas(run, "id long, path long")


def _sketch_matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint32).reshape(-1, SKETCH)


def by_group(df: DataFrame, key: str, most: int, apply: Callable[[pd.DataFrame], pd.DataFrame | None], schema: str) -> DataFrame:
    """Calls ``apply`` on frames of whole groups of ``key``, many groups a call; a group has a bounded number of rows."""

    def run(frames: Iterator[pd.DataFrame]):
        held: pd.DataFrame | None = None
        for f in frames:
            held = f if held is None else pd.concat([held, f], ignore_index=True)
            while len(held) > most:
                keys = held[key].to_numpy()
                end = most
                while end < len(keys) and keys[end] == keys[end - 1]:
                    end += 1
                if end == len(keys):
                    break
                out = apply(held.iloc[:end].reset_index(drop=True))
                if out is not None:
                    yield out
                held = held.iloc[end:].reset_index(drop=True)
        if held is not None and len(held):
            out = apply(held)
            if out is not None:
                yield out
        trim()

    return df.repartition(key).sortWithinPartitions(key).mapInPandas(run, schema)


def _compare_bucket(f: pd.DataFrame) -> pd.DataFrame:
    """Candidate pairs of sets in the same small bucket, by their sketches."""
    path, ids, sk = f["path"].to_numpy(), f["id"].to_numpy(), _sketch_matrix(f["sketch"])
    a, b, k = [], [], 1
    while k < len(path):
        at = np.flatnonzero(path[:-k] == path[k:])
        if not len(at):
            break
        near = at[(sk[at] == sk[at + k]).mean(axis=1) >= SKETCH_LEAST]
        a.append(ids[near]), b.append(ids[near + k])
        k += 1
    return pd.DataFrame({"a": np.concatenate([*a, np.zeros(0, np.int64)]), "b": np.concatenate([*b, np.zeros(0, np.int64)])})


def _thinned(f: pd.DataFrame, depth: int) -> pd.DataFrame:
    """Of parts of large buckets: the children (id, path) of the sets that no representative stands for, and the pairs (id, rep) of all sets near one."""
    path, ids, own, is_rep, sk = f["path"].to_numpy().view(_U), f["id"].to_numpy(), f["own"].to_numpy(), f["is_rep"].to_numpy(), _sketch_matrix(f["sketch"])
    out = []
    for s, e in _groups(f["key"].to_numpy()):
        members, reps = s + np.flatnonzero(own[s:e]), s + np.flatnonzero(is_rep[s:e])
        reps = reps[np.argsort(ids[reps])]  # one order in all parts of a bucket
        root = np.arange(len(reps))
        a, b = _forest(_mismatches(sk[reps], sk[reps]) <= STANDS + LOOSE)
        root[a] = b
        away = _mismatches(sk[members], sk[reps])
        near, wide = (away <= STANDS).any(axis=1), away <= STANDS + LOOSE
        for r in np.unique(root):  # representatives that are joined already count as one
            got = ids[members[wide[:, root == r].any(axis=1)]]
            got = got[got != ids[reps[r]]]
            out.append(pd.DataFrame({"id": got, "path": np.zeros(len(got), np.int64), "rep": ids[reps[r]], "child": False}))
        on = members[~near]
        parent, child = _children(path[on], sk[on], depth)
        out.append(pd.DataFrame({"id": ids[on[parent]], "path": child.view(np.int64), "rep": ids[on[parent]], "child": True}))
    return pd.concat(out, ignore_index=True)


def _mismatches(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Tokens in which each row of ``a`` differs from each row of ``b``."""
    out = np.zeros((len(a), len(b)), np.uint8)
    for k in range(SKETCH):
        out += a[:, k, None] != b[None, :, k]
    return out


def _go_down(entries: DataFrame, depth: int) -> DataFrame:
    """(id, path, rep, child): children and pairs, see :func:`_thinned`, of entries (id, path, size, sketch) of large buckets."""
    blocks = F.ceil(F.col("size") / PART).cast("int")
    # Every part of a bucket has all its representatives.
    of = entries.withColumn("blocks", blocks).withColumn("home", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    of = of.withColumn("is_rep", F.pmod(F.xxhash64("id", F.lit(depth)), F.lit(1 << 30)) * F.col("size") < REPS << 30)
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    dealt = of.withColumn("block", F.explode(F.when(F.col("is_rep"), every).otherwise(F.array("home"))))
    dealt = dealt.select("id", "path", "sketch", "is_rep", (F.col("block") == F.col("home")).alias("own"), F.xxhash64("path", "block").alias("key"))
    return by_group(dealt, "key", 1024, lambda f: _thinned(f, depth), "id long, path long, rep long, child boolean")


def candidate_edges(sets: DataFrame) -> DataFrame:
    """Edges (a, b) between the ids of sets (id, sketch) that the recursion brings together."""
    entries = cut(_enter(sets))
    found = []
    for depth in range(1, DEPTH + 1):
        size = entries.groupBy("path").agg(F.count(F.lit(1)).alias("size"), F.min("id").alias("least")).where("size > 1")
        entries = cut(spread_join(entries, size, "path", times="size"))
        if depth == 1:  # most sets have met none
            sets = cut(likely_in(sets, entries, ["id"]))
        small = entries.where(F.col("size") <= BUCKET).join(sets, "id")
        found.append(cut(by_group(small.select("path", "id", "sketch"), "path", 4096, _compare_bucket, "a long, b long").distinct()))
        large = entries.where(F.col("size") > BUCKET)
        if depth == DEPTH:
            found.append(large.where("id <> least").select(F.col("least").alias("a"), F.col("id").alias("b")).distinct())
        else:
            told = cut(_go_down(large.join(sets, "id").select("id", "path", "size", "sketch"), depth))
            found.append(told.where("NOT child").select(F.col("rep").alias("a"), F.col("id").alias("b")).distinct())
            entries = told.where("child").select("id", "path")
    edges = found[0]
    for more in found[1:]:
        edges = edges.unionByName(more)
    return edges


# ---- exact comparison


def _coded_sets(texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, number of a shingle that several rows hold) of each member of the rows' sets, and the sets' sizes."""
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.large_string())], ["text"])
    parts = [shingle_hashes(*word_hashes(data, off), SHINGLE) for _, _, data, off in chunks(batch)]
    grams, counts = (np.concatenate(x) for x in zip(*parts))
    row = row_of(counts)
    shared, code = np.unique(grams, return_inverse=True)
    pair = np.unique(row * len(shared) + code)
    row, code = pair // len(shared), pair % len(shared)
    size = np.bincount(row, minlength=len(counts))
    keep = np.bincount(code, minlength=len(shared))[code] > 1
    row, code = row[keep], code[keep]
    return row, np.unique(code, return_inverse=True)[1], size


def _groups(keys: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1], True]).tolist()
    return list(zip(edges[:-1], edges[1:]))


def _near(f: pd.DataFrame) -> pd.DataFrame:
    """(id, group, shared, either) of the sets of (group, block) keys: members in common with the representative, which each key has, and in either."""
    out = []
    for s, e in _groups(f["key"].to_numpy()):
        row, code, size = _coded_sets(f["text"].iloc[s:e])
        own = f["is_rep"].to_numpy()[s:e]
        rep = int(np.flatnonzero(own)[0])
        held = np.zeros(int(code.max()) + 1 if len(code) else 1, bool)
        held[code[row == rep]] = True
        shared = np.bincount(row[held[code]], minlength=e - s)
        shared[own] = size[rep]
        part = f.iloc[s:e]
        out.append(pd.DataFrame({"id": part["id"], "group": part["group"], "shared": shared, "either": size + size[rep] - shared})[~own])
    return pd.concat(out, ignore_index=True) if out else None


def _exact_links(f: pd.DataFrame) -> pd.DataFrame:
    """Links of the sets of one or more (group, block, block) keys, but of pairs of tight sets: a row for each linked set with their number, and rows that span the components."""
    out = []
    ids, weight, side, tight = (f[c].to_numpy() for c in ("id", "weight", "side", "tight"))
    for s, e in _groups(f["key"].to_numpy()):
        row, code, size = _coded_sets(f["text"].iloc[s:e])
        inter = np.zeros((e - s, e - s), np.float32)
        for lo in range(0, int(code.max()) + 1 if len(code) else 0, 8192):
            part = (code >= lo) & (code < lo + 8192)
            m = np.zeros((e - s, min(8192, int(code.max()) + 1 - lo)), np.float32)
            m[row[part], code[part] - lo] = 1
            inter += m @ m.T
        linked = inter >= THRESHOLD * (size[:, None] + size[None] - inter) - 1e-4
        np.fill_diagonal(linked, False)
        own, close = side[s:e], tight[s:e]
        linked &= (own[:, None] == 2) | (own[:, None] != own[None])  # side 2: a block with itself
        linked &= ~(close[:, None] & close[None])
        some = np.flatnonzero(linked.any(axis=1))
        if len(some):
            out.append(pd.DataFrame({"id": ids[s:e][some], "links": (linked[some] * weight[s:e][None]).sum(axis=1).astype(np.int64), "partner": ids[s:e][some]}))
            a, b = _forest(linked)
            out.append(pd.DataFrame({"id": ids[s:e][a], "links": np.zeros(len(a), np.int64), "partner": ids[s:e][b]}))
    return pd.concat(out, ignore_index=True) if out else None


def _forest(linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that span the components of a symmetric matrix: each row with its component's first row."""
    n = len(linked)
    root = np.arange(n)
    for i in range(n):
        if root[i] != i or not linked[i].any():
            continue
        seen, new = np.zeros(n, bool), linked[i].copy()
        seen[i] = True
        while new.any():
            seen |= new
            new = linked[new].any(axis=0) & ~seen
        root[seen] = i
    at = np.flatnonzero(root != np.arange(n))
    return at, root[at]


def _tight_sets(base: DataFrame, members: DataFrame) -> DataFrame:
    """(id, tight) of the members (id, group, block, blocks, doc_id, text_hash) of groups: whether a set's distance to its representative is at most half of the threshold's."""
    reps = members.where(F.col("id") == F.col("rep_id")).select("doc_id", "text_hash", F.col("id").alias("rep"), "group", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    texts = base.join(members.select("doc_id", "text_hash", "id", "group", "block"), ["doc_id", "text_hash"]).dropDuplicates(["id"])
    copies = base.join(reps, ["doc_id", "text_hash"]).dropDuplicates(["rep", "block"])
    dealt = texts.select("id", "group", "block", "text", F.lit(False).alias("is_rep")).unionByName(copies.select(F.col("rep").alias("id"), "group", "block", "text", F.lit(True).alias("is_rep")))
    dealt = dealt.select("id", "group", "text", "is_rep", F.xxhash64("group", "block").alias("key"))
    near = by_group(dealt, "key", 64, _near, "id long, group long, shared long, either long")
    half = (1 + THRESHOLD) / 2
    return near.select("id", (F.col("shared") >= F.col("either") * half + 1e-9 * F.col("either")).alias("tight"))


def _judged(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, root (the set id that stands for the class; null for rows of no class), class_id, n_links and n_equal of each row."""
    base = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    table = cut(set_table(base))
    classes = table.where("n > 0 AND doc_id IS NOT NULL").groupBy("low", "high", "n").agg(F.count(F.lit(1)).alias("weight"), F.min(F.struct("doc_id", "text_hash", "bytes", "sketch")).alias("first"))
    classes = cut(classes.select("low", "high", "n", "weight", F.xxhash64("low", "high", "n").alias("id"), F.col("first.doc_id").alias("rep"), "first.text_hash", "first.bytes", "first.sketch"))
    groups = components(candidate_edges(classes.select("id", "sketch"))).select(F.col("node").alias("id"), F.col("root").alias("group"))
    found = cut(groups.join(classes.select("id", F.col("rep").alias("doc_id"), "text_hash", "weight", "bytes"), "id"))
    sizes = found.groupBy("group").agg(F.count(F.lit(1)).alias("members"), F.sum("bytes").alias("bytes"), F.min("id").alias("rep_id"))
    blocks = F.greatest(F.ceil(F.col("members") / BLOCK), F.ceil(F.col("bytes") / BLOCK_BYTES)).cast("int")
    sizes = sizes.select("group", "rep_id", "members", F.least(blocks, F.col("members")).cast("int").alias("blocks"))
    members = cut(spread_join(found.drop("bytes"), sizes, "group", times="members").drop("members").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")))
    texts = cut(likely_in(base, members, ["doc_id", "text_hash"]).join(members.select("doc_id", "text_hash").distinct(), ["doc_id", "text_hash"], "left_semi"))
    members = cut(members.join(_tight_sets(texts, members), "id"))
    # Tight sets link one another: counted by group, and joined to their representative.
    tight = members.where("tight").groupBy("group").agg(F.sum("weight").alias("close"))
    counted = spread_join(members.where("tight"), tight, "group").select("id", (F.col("close") - F.col("weight")).alias("links"), F.col("rep_id").alias("partner"))
    # Pairs with a set that is not: blocks that hold one meet all blocks of the group.
    loose = members.where("NOT tight").groupBy("group").agg(F.collect_set("block").alias("loose"))
    dealt = spread_join(members, loose, "group").withColumn("all", F.sequence(F.lit(0), F.col("blocks") - 1))
    others = F.when(F.array_contains("loose", F.col("block")), F.col("all")).otherwise(F.col("loose"))
    dealt = texts.join(dealt.select("id", "doc_id", "text_hash", "weight", "tight", "group", "block", others.alias("others")), ["doc_id", "text_hash"]).dropDuplicates(["id"])
    dealt = dealt.select("id", "weight", "tight", "text", "group", "block", F.explode("others").alias("other"))
    side = F.when(F.col("block") == F.col("other"), 2).when(F.col("block") < F.col("other"), 0).otherwise(1)
    key = F.xxhash64("group", F.least("block", "other"), F.greatest("block", "other"))
    dealt = dealt.select("id", "weight", "tight", "text", key.alias("key"), side.alias("side"))
    links = cut(counted.unionByName(by_group(dealt, "key", 64, _exact_links, "id long, links long, partner long")))
    totals = links.groupBy("id").agg(F.sum("links").alias("links"))
    roots = components(links.select(F.col("id").alias("a"), F.col("partner").alias("b"))).select(F.col("node").alias("id"), "root")
    reps = classes.select("id", "low", "high", "n", "weight", "rep").join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    least = reps.groupBy("root").agg(F.min("rep").alias("class_id"))
    reps = cut(spread_join(reps, least, "root").join(totals, "id", "left"))
    return spread_join(table, reps.select("low", "high", "n", "root", "weight", "class_id", "links"), "low", "high", "n", how="left", times="weight").select(
        "doc_id",
        "text_hash",
        F.when(F.col("doc_id").isNotNull(), F.col("root")).alias("root"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("class_id", "doc_id")).alias("class_id"),
        F.when(F.col("doc_id").isNull(), 0).otherwise(F.coalesce("links", F.lit(0)) + F.coalesce("weight", F.lit(1)) - 1).cast("long").alias("n_links"),
        F.when(F.col("doc_id").isNull(), 1).otherwise(F.coalesce("weight", F.lit(1))).cast("long").alias("n_equal"),
    )


def similar_documents(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, class_id (the least doc_id of its class), n_links (documents at least THRESHOLD similar), n_equal (documents with the same set, itself included)."""
    return _judged(docs).drop("text_hash", "root")


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents without the near copies: of each class one row, of its least (doc_id, hash of the text).  Rows of no class (null ids, texts without words) all stay."""
    rows = cut(_judged(docs).where("root IS NOT NULL").select("doc_id", "text_hash", "root").groupBy("doc_id", "text_hash", "root").agg(F.count(F.lit(1)).alias("times")))
    first = rows.groupBy("root").agg(F.min(F.struct("doc_id", "text_hash")).alias("k")).select("k.*")
    gone = cut(rows.join(first, ["doc_id", "text_hash"], "left_anti").select("doc_id", "text_hash"))
    twice = rows.where("times > 1").select("doc_id", "text_hash").unionByName(gone)
    keyed = docs.select(F.struct("*").alias("row"), "doc_id", F.xxhash64("text").alias("text_hash"), "text")
    in_class = F.col("doc_id").isNotNull() & F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    marked = likely_in(keyed.withColumn("in_class", in_class), twice, ["doc_id", "text_hash"], mark="likely").drop("text")
    asked = F.col("likely") & F.col("in_class")
    some = marked.where(asked).dropDuplicates(["doc_id", "text_hash"]).join(gone, ["doc_id", "text_hash"], "left_anti")
    return marked.where(~asked).select("row.*").unionByName(some.select("row.*"))
