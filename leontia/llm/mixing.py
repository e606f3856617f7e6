"""Mixing sources to target weights, with Spark's own functions only.

1. Terms that mark the domains of ``TERM_DOMAINS``, words and stems of words, are mined from at most
   ``MAX_LABELLED`` labelled rows of each domain, those of least hash of the id; rows of one domain that agree
   in three minwise words are copies and count once.  A naive Bayes classifier over binned statistics of the text, the
   numbers of these terms among them, is fitted on the labelled table by one aggregation; its counts, of
   fixed size, go into the plan.  It gives each document posteriors over the domains: 'toxic', else 'high'
   or 'low' by quality.
2. Rates r >= ``least`` are fitted so that the expected tokens of each domain, sum of r * tokens *
   posterior, match ``weights`` times ``budget`` times all tokens.  Distributed projected gradient for least
   squares, with a pull of strength ``PULL`` towards rate 1: documents with equal bins have equal posteriors
   and so equal rates, hence the gradient steps run over one row per cell of bins with its summed tokens.
   Each step sums the domains' totals over the cells and moves every cell's rate.

Cases: null counts as empty; labels without values are not used; without labels there are no terms and the
posteriors are uniform; a document without words has no tokens and keeps the rate of its bins; a null doc_id has no label
and is kept like any other; repeated rows count each;
an empty table gives an empty result.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leontia.llm.common import cut

DOMAINS = ("high", "low", "toxic")
PULL, STEPS, UNROLL, TOLERANCE = 0.002, 80, 4, 1e-4
WEIGHTS = {"high": 0.7, "low": 0.25, "toxic": 0.05}
TERM_DOMAINS, STEMS, MAX_LABELLED, MAX_TERMS, MAX_CANDIDATES, SURE = ("toxic", "low"), (4, 5, 6, 7), 8000, 256, 20000, 20.0
_LETTER = r"[\p{L}\p{N}]"


def _bin(x: Column, edges: list[float]) -> Column:
    return sum((F.when(x > e, 1).otherwise(0) for e in edges), F.lit(0))


FEATURES = ("b_length", "b_symbol", "b_upper", "b_digit", "b_shout", "b_break", "b_word", "b_lines", *[f"b_terms_{d}" for d in TERM_DOMAINS])


def choose_terms(found: list[tuple[str, int, int, float]]) -> list[str]:
    """From (term, rows, most rows with one word of it, ratio): stems (with ``*``) that no single word explains, and the other words."""
    stems: list[str] = []
    for t, n, best, _ in sorted(found, key=lambda x: (len(x[0]), x[0])):
        if t.endswith("*") and n > 1.5 * best and not t.startswith(tuple(stems)):
            stems.append(t[:-1])
    terms = [x for x in found if (x[0][:-1] in stems if x[0].endswith("*") else not x[0].startswith(tuple(stems)))]
    return [x[0] for x in sorted(terms, key=lambda x: (-x[1] * math.log(x[3]), x[0]))[:MAX_TERMS]]


def mine_terms(docs: DataFrame, labels: DataFrame) -> dict[str, list[str]]:
    """Terms at least 8 times as frequent in the labelled rows of a domain as in the others, by domain.

    At most MAX_TERMS of the MAX_CANDIDATES strongest are kept, and words of 3 to 32 characters.  A word counts once a row, a stem once for each of its words in a row; needed are 1 % of the domain's rows, four at least,
    and more than chance gives among many words (the likelihood ratio statistic reaches ``SURE``).
    """
    known = labels.select("doc_id", domain_of(F.col("quality"), F.col("toxic")).alias("domain")).where("domain IS NOT NULL")
    picked = [known.where(F.col("domain") == d).distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_LABELLED) for d in DOMAINS]
    sample = F.broadcast(reduce(lambda a, b: a.unionByName(b), picked))  # at most MAX_LABELLED ids a domain
    words = F.array_union(F.split(F.lower(F.coalesce("text", F.lit(""))), rf"[^{_LETTER[1:]}+"), F.array(F.lit("")))  # '' counts the rows
    rows = docs.select("doc_id", "text").join(sample, "doc_id").select("domain", words.alias("words"))
    same = {f"same{i}": F.array_min(F.transform("words", lambda w, i=i: F.xxhash64(w, F.lit(i)))) for i in range(3)}
    rows = rows.withColumns(same).dropDuplicates(["domain", *same])
    counts = cut(rows.select("domain", F.explode("words").alias("word")).groupBy("word").agg(*[F.count_if(F.col("domain") == d).alias(d) for d in DOMAINS]))
    totals = counts.where("word = ''").first()
    if totals is None:
        return {d: [] for d in TERM_DOMAINS}
    stems = [F.when(F.length("word") > k, F.concat(F.substring("word", 1, k), F.lit("*"))) for k in STEMS]
    terms = counts.where("length(word) BETWEEN 3 AND 32").select(F.explode(F.array_compact(F.array("word", *stems))).alias("term"), *DOMAINS)
    terms = cut(terms.groupBy("term").agg(*[F.sum(d).alias(d) for d in DOMAINS], *[F.max(d).alias(f"best_{d}") for d in DOMAINS]))
    out = {}
    for d in TERM_DOMAINS:
        own, others = totals[d], sum(totals[e] for e in DOMAINS if e != d)
        if not own or not others:
            out[d] = []
            continue
        n, m, share = F.col(d), sum((F.col(e) for e in DOMAINS if e != d), F.lit(0)), own / (own + others)
        ratio = (n / own) / ((m + 0.5) / others)
        surprise = 2 * (n * F.log(n / ((n + m) * share)) + F.when(m > 0, m * F.log(m / ((n + m) * (1 - share)))).otherwise(0.0))
        good = terms.where((n >= max(4, 0.01 * own)) & (ratio >= 8) & (surprise >= SURE)).select("term", d, f"best_{d}", ratio.alias("ratio"))
        out[d] = choose_terms([tuple(r) for r in good.orderBy(F.desc(F.col(d) * F.log("ratio")), "term").limit(MAX_CANDIDATES).collect()])
    return out


def pattern(terms: list[str]) -> str:
    """A regular expression of the terms at the beginning of words, by their trie, so that a place is tried once."""
    root: dict = {}
    for t in terms:
        node = root
        for c in t.removesuffix("*"):
            node = node.setdefault(c, {})
        node["stem" if t.endswith("*") else "word"] = {}

    def of(node: dict) -> str:
        if "stem" in node:
            return ""
        parts = [c + of(kid) for c, kid in sorted(node.items()) if c != "word"] + [f"(?!{_LETTER})"] * ("word" in node)
        return parts[0] if len(parts) == 1 else f"(?:{'|'.join(parts)})"

    return f"(?=[{''.join(sorted(root))}])(?<!{_LETTER}){of(root)}"


def statistics(docs: DataFrame, terms: dict[str, list[str]]) -> DataFrame:
    """(doc_id, text_hash, tokens, bins of FEATURES) of every whole text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    short = F.regexp_replace(text, "[a-z]{2,}", "a")  # none of the counted characters goes, and no word
    read = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), text.alias("t"), short.alias("short"), F.split(text, "\n").alias("lines"), F.lower(text).alias("low"))
    number = lambda c: F.regexp_count("short", F.lit(c))
    hits = {f"b_terms_{d}": F.regexp_count("low", F.lit(pattern(terms[d]))) if terms.get(d) else F.lit(0) for d in TERM_DOMAINS}
    counted = read.select(
        "doc_id", "text_hash", F.octet_length("t").alias("bytes"), F.length("t").alias("chars"), F.size("lines").alias("n_lines"), F.size(F.array_distinct("lines")).alias("n_own"),
        number("[#*$%&|<>]").alias("symbols"), number("[A-Z]").alias("upper"), number("[0-9]").alias("digits"), number("[!?]").alias("shouts"), number("[ \n]").alias("spaces"), number(r"\S+").cast("long").alias("tokens"), *[h.alias(n) for n, h in hits.items()],
    )
    chars = F.greatest("chars", F.lit(1))
    bins = {
        "b_length": F.floor(F.log2(F.col("bytes") + 1.0)).cast("int"),
        "b_symbol": _bin(F.col("symbols") / chars, [0, 0.005, 0.03, 0.1]),
        "b_upper": _bin(F.col("upper") / chars, [0.02, 0.05, 0.2, 0.6]),
        "b_digit": _bin(F.col("digits") / chars, [0, 0.005, 0.02, 0.1]),
        "b_shout": _bin(F.col("shouts") / chars, [0, 0.005, 0.03]),
        "b_break": _bin((F.col("n_lines") - 1) / chars, [0, 0.005, 0.02]),
        "b_word": _bin(F.col("chars") / F.greatest("spaces", F.lit(1)), [4.5, 5.5, 6.5, 7.5, 9]),
        "b_lines": _bin(1 - F.col("n_own") / F.col("n_lines"), [0, 0.1, 0.3, 0.6]),
        **{n: F.least(n, F.lit(3)).cast("int") for n in hits},
    }
    return counted.select("doc_id", "text_hash", "tokens", *[c.alias(n) for n, c in bins.items()])


def domain_of(quality: Column, toxic: Column) -> Column:
    return F.when(toxic == 1, "toxic").when(quality == 1, "high").when(quality == 0, "low")


def fit_classifier(stats: DataFrame, labels: DataFrame) -> dict[tuple[str, str, int], float]:
    """log P(bin | domain) by (domain, feature, bin), and the log prior by (domain, '', 0); smoothed by one row a bin."""
    known = labels.select("doc_id", domain_of(F.col("quality"), F.col("toxic")).alias("domain")).where("domain IS NOT NULL")
    pairs = F.array(F.struct(F.lit("").alias("f"), F.lit(0).alias("b")), *[F.struct(F.lit(f).alias("f"), F.col(f).alias("b")) for f in FEATURES])
    long = stats.join(known, "doc_id").select("domain", F.explode(pairs).alias("x")).groupBy("domain", "x.f", "x.b").count()
    counts = {(r["domain"], r["f"], r["b"]): r["count"] for r in long.collect()}
    bins = {f: sorted({b for _, g, b in counts if g == f}) for f in FEATURES}
    totals = {d: counts.get((d, "", 0), 0) for d in DOMAINS}
    everything = sum(totals.values())
    out = {(d, "", 0): math.log((totals[d] + 1) / (everything + len(DOMAINS))) for d in DOMAINS}
    for f, bs in bins.items():
        for b in bs:
            for d in DOMAINS:
                out[d, f, b] = math.log((counts.get((d, f, b), 0) + 1) / (totals[d] + len(bs)))
    return out


def with_posteriors(cells: DataFrame, model: dict) -> DataFrame:
    """Adds p_<domain>, P(domain | bins); bins never seen with a label say nothing.  A step a column, so that no expression is repeated."""
    for d in DOMAINS:
        parts = [F.lit(model[d, "", 0])]
        for f in FEATURES:
            known = {b: v for (dd, ff, b), v in model.items() if dd == d and ff == f}
            if known:
                table = F.array(*[F.lit(known.get(b, 0.0)) for b in range(max(known) + 1)])
                parts.append(F.coalesce(F.get(table, F.col(f)), F.lit(0.0)))
        cells = cells.withColumn(f"p_{d}", reduce(lambda a, b: a + b, parts))
    cells = cells.withColumn("top", F.greatest(*[f"p_{d}" for d in DOMAINS]))
    cells = cells.withColumns({f"p_{d}": F.exp(F.col(f"p_{d}") - F.col("top")) for d in DOMAINS}).drop("top")
    cells = cells.withColumn("whole", reduce(lambda a, b: a + b, [F.col(f"p_{d}") for d in DOMAINS]))
    return cells.withColumns({f"p_{d}": F.col(f"p_{d}") / F.col("whole") for d in DOMAINS}).drop("whole")


def fit_rates(cells: DataFrame, weights: dict[str, float], budget: float, least: float) -> tuple[DataFrame, list[float]]:
    """(cells with ``rate``, what each domain's expected share of the budget misses) by accelerated projected gradient."""
    p = [F.col(f"p_{d}") for d in DOMAINS]
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    if not total:
        return cells.withColumn("rate", F.lit(max(1.0, least))), [0.0] * len(DOMAINS)
    goal = [weights.get(d, 0.0) / sum(weights.values()) * budget for d in DOMAINS]
    eta = 1.0 / (1.0 + PULL)
    state = cut(cells.withColumns({"rate": F.lit(max(1.0, least)), "ahead": F.lit(max(1.0, least))}))
    speed, last = 1.0, None
    for step in range(STEPS):
        sums = state.agg(*[F.sum(F.col("ahead") * F.col("tokens") * q).alias(d) for q, d in zip(p, DOMAINS)]).first()
        miss = [sums[d] / total - g for d, g in zip(DOMAINS, goal)]
        slope = reduce(lambda a, b: a + b, [F.lit(m) * q for m, q in zip(miss, p)]) + PULL * (F.col("ahead") - 1.0)
        new = F.greatest(F.lit(least), F.col("ahead") - eta * slope)
        faster = (1 + math.sqrt(1 + 4 * speed * speed)) / 2
        state = state.withColumn("next", new).select(*cells.columns, F.col("next").alias("rate"), (F.col("next") + (speed - 1) / faster * (F.col("next") - F.col("rate"))).alias("ahead"))
        speed = faster
        if step % UNROLL == UNROLL - 1:
            state = cut(state)
        if last is not None and max(abs(a - b) for a, b in zip(miss, last)) < TOLERANCE * budget and step > 3:
            break
        last = miss
    state = cut(state)
    sums = state.agg(*[F.sum(F.col("rate") * F.col("tokens") * q).alias(d) for q, d in zip(p, DOMAINS)]).first()
    return state.drop("ahead"), [sums[d] / total - g for d, g in zip(DOMAINS, goal)]


def mix_rates(docs: DataFrame, labels: DataFrame, weights: dict[str, float] = WEIGHTS, budget: float = 1.0, least: float = 0.0) -> DataFrame:
    """One row a document: doc_id, text_hash, tokens, posteriors p_<domain>, rate, and miss_<domain>: by which share of all tokens the fitted rates miss the domain's target (0 if it is met)."""
    stats = cut(statistics(docs, mine_terms(docs, labels)))
    model = fit_classifier(stats, labels)
    cells = cut(with_posteriors(stats.groupBy(*FEATURES).agg(F.sum("tokens").alias("tokens")), model))
    rated, missed = fit_rates(cells, weights, budget, least)
    same = reduce(lambda a, b: a & b, [stats[f] == rated[f] for f in FEATURES])
    return stats.join(rated, same).select("doc_id", "text_hash", stats["tokens"], *[f"p_{d}" for d in DOMAINS], "rate", *[F.lit(round(m, 6)).alias(f"miss_{d}") for d, m in zip(DOMAINS, missed)])


def repeat_by_rate(docs: DataFrame, rates: DataFrame) -> DataFrame:
    """Each document as often as its rate says; the fraction is rounded by a hash of (doc_id, text), so runs agree.  Null ids match null ids."""
    rates = rates.select(F.col("doc_id").alias("id"), F.col("text_hash").alias("same"), "rate").distinct()
    whole = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("row_id"), F.xxhash64("text").alias("row_hash"))  # one name, so that no column clashes
    chance = F.pmod(F.xxhash64("row_id", "row_hash"), F.lit(1 << 30)) / float(1 << 30)
    joined = whole.join(rates, F.col("row_id").eqNullSafe(F.col("id")) & (F.col("row_hash") == F.col("same")))
    return joined.select("row", F.explode(F.array_repeat(F.lit(1), F.floor(F.col("rate") + chance).cast("int")))).select("row.*")
