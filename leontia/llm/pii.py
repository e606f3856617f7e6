"""PII: surrogate generation with Spark's own functions only.

Mentions are found by one regular expression.  A mention stands for one or two units (kind, norm): the
norm is what its spellings share, such as the digits of a phone number or the address in lower case.  A
unit's surrogate is a function of (secret key, kind, norm, attempt), so every mention of it gets the same
one; it keeps kind and format: digits stay digits, letters keep case and script, addresses keep their number of
labels, card numbers and IBANs get valid check digits where the original has them, names keep script, case and gender.

Found are: named secrets, e-mail addresses, access keys, IBANs, persons (behind a title, or with a given name of
``GIVEN``), IPv4 and IPv6 addresses, phone numbers (with a plus, a bracket, or as 3-3-4 digits with dashes or dots), numbers in
the form of a social security number, and card numbers in fours or as 4-6-5.  Scripts with surrogates of their own: ``SCRIPTS``;
letters of others become Latin.  Names without title or listed given name are not found.

Attempts exist for collisions.  All distinct units take attempt 0; a surrogate that is a real unit of the
corpus goes to no unit, one that two units share to one of them, and the others try again, until surrogates
are as distinct as units; after ``GROW`` attempts a surrogate gets longer than its form, so that this ends however dense a form's numbers are.
Replacements are made once per distinct mention and joined to the places, the places of a hot mention spread over tasks.

Cases: a null text stays null; texts without mentions are unchanged; repeated rows are rewritten alike; an
empty table gives an empty result; a mention in a third of all rows is one unit, counted in every task
before the shuffle.
"""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leontia.llm.common import cut, spread_join

MAX_ATTEMPTS, GROW = 64, 24

# Given names by script and gender, titles by gender, and the syllables of surnames by script.
GIVEN = {
    ("latin", "f"): ["Alice", "Anna", "Carmen", "Charlotte", "Claire", "Elena", "Emma", "Greta", "Hannah", "Ingrid", "Isabel", "Julia", "Katharina", "Laura", "Lucia", "Maria", "Nadine", "Olivia", "Sabine", "Sofia", "Susan", "Teresa", "Ursula", "Victoria"],
    ("latin", "m"): ["Albert", "Andreas", "Antonio", "Carlos", "Daniel", "David", "Diego", "Edward", "Felix", "Friedrich", "George", "Heinrich", "Jacques", "Javier", "John", "Klaus", "Louis", "Manuel", "Michael", "Pierre", "Robert", "Stefan", "Thomas", "William"],
    ("cyrillic", "f"): ["Анна", "Елена", "Ирина", "Мария", "Наталья", "Ольга", "Светлана", "Татьяна"],
    ("cyrillic", "m"): ["Алексей", "Борис", "Виктор", "Дмитрий", "Иван", "Михаил", "Николай", "Сергей"],
}
TITLES = {"f": ["Mrs", "Ms", "Miss", "Frau", "Señora", "Sra", "Madame", "Mme"], "m": ["Mr", "Herr", "Señor", "Sr", "Monsieur"], "": ["Dr", "Prof"]}
# Pattern of a letter, first and number of the code points that stand in for it.
SCRIPTS = {
    "greek": [(r"[\x{390}\x{3AC}-\x{3CE}]", 0x3B1, 25), (r"[\x{386}-\x{3AB}&&\p{Lu}]", 0x391, 17)],
    "hebrew": [(r"[\x{5D0}-\x{5EA}]", 0x5D0, 27)],
    "arabic": [(r"[\x{621}-\x{64A}]", 0x627, 20)],
    "devanagari": [(r"[\x{904}-\x{939}]", 0x915, 37)],
    "hiragana": [(r"[\x{3041}-\x{3096}]", 0x3042, 80)],
    "katakana": [(r"[\x{30A1}-\x{30FA}]", 0x30A2, 80)],
    "han": [(r"\p{IsHan}", 0x4E00, 5000)],
    "hangul": [(r"[\x{AC00}-\x{D7A3}]", 0xAC00, 11172)],
}
SYLLABLES = {"latin": ["bar", "den", "fel", "gor", "hal", "jen", "kel", "lor", "mar", "nev", "orm", "pel", "ros", "san", "tor", "vin"], "cyrillic": ["бар", "вел", "гор", "дан", "жел", "кол", "лев", "мар", "нов", "орл", "пет", "рог", "сав", "тол", "фед", "чер"]}

_titles = "|".join(t for ts in TITLES.values() for t in ts)
_given = "|".join(n for ns in GIVEN.values() for n in ns)
_name = r"\p{Lu}\p{L}+"
_secret = r"(?i:password|passwd|pwd|secret|token|api[_-]?key)[\"']?\s{0,3}[=:]\s{0,3}[\"']?"
_WORDS = {  # what starts at the start of a word
    "secret": rf"(?=[PpSsTtAa]){_secret}[^\s\"',;]{{6,}}",
    "email": r"(?<![._%+-])[\p{L}\d._%+-]++@[\p{L}\d-]+(?:\.[\p{L}\d-]+)+",
    "key": r"(?=[Ags])(?:AKIA[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{20,}|sk-[A-Za-z0-9]{20,})",
    "ipv6": r"(?=[\da-fA-F]{1,4}:[\da-fA-F:])(?=[\da-fA-F:]*\d)(?:(?:[\da-fA-F]{1,4}:){7}[\da-fA-F]{1,4}|(?:[\da-fA-F]{1,4}:){1,6}(?::[\da-fA-F]{1,4}){1,6})(?![\p{L}\d:])",
    "iban": r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\d])",
    "person": rf"(?=\p{{Lu}})(?:(?:{_titles})\.? {_name}(?: {_name})?|(?:{_given})(?: {_name})?)(?![\p{{L}}\d])",
}
_NUMBERS = {  # what starts with a digit, a plus or a bracket
    "ip": r"(?<![\d.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\.?\d)",
    "phone": r"(?<![\d+])(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}(?!\d)|(?<![\d+])\+\d{1,3}(?:[ .-]?\d{2,4}){2,4}(?!\d)|(?<![\d.-])\d{3}(?:-\d{3}-|\.\d{3}\.)\d{4}(?![\d-])",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "card": r"(?<![\d.])(?:\d{4}[ -]?\d{4}[ -]?\d{4}[ -]?\d{1,7}|\d{4}[ -]\d{6}[ -]\d{5})(?!\d)",
}
KINDS: dict[str, str] = _WORDS | _NUMBERS
#: Most places in a text are ruled out by the first test of either half.
PATTERN = r"(?<![\p{L}\d])(?:" + "|".join(_WORDS.values()) + r")|(?=[\d+(])(?:" + "|".join(_NUMBERS.values()) + ")"


def kind_of(m: Column) -> Column:
    """The kind of a mention: the first of KINDS whose pattern is the whole of it."""
    return reduce(lambda out, kv: out.when(m.rlike(f"^(?:{kv[1]})$"), kv[0]), list(KINDS.items())[1:], F.when(m.rlike(rf"^(?:{KINDS['secret']})$"), "secret"))


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, r"\D", "")


def _lead(kind: Column, m: Column) -> Column:
    """What stays at the start of a mention: the name of a secret, the prefix of a key, a title."""
    return (
        F.when(kind == "secret", F.regexp_extract(m, f"^{_secret}", 0))
        .when(kind == "key", F.regexp_extract(m, r"^(?:AKIA|gh[pousr]_|sk-)", 0))
        .when(kind == "person", F.regexp_extract(m, rf"^(?:{_titles})\.? ", 0))
        .otherwise("")
    )


def _norm(kind: Column, rest: Column) -> Column:
    return F.when(kind.isin("email", "ipv6"), F.lower(rest)).when(kind.isin("phone", "ssn", "card"), _digits(rest)).when(kind == "iban", F.regexp_replace(rest, " ", "")).otherwise(rest)


def mentions(text: Column) -> Column:
    """The mentions of a text, in order, as an array of strings."""
    return F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))


# ---- surrogates


def _stream(key: str, *parts: Column) -> Column:
    """512 hexadecimal digits, keyed."""
    seed = F.concat_ws("\x1f", F.lit(key), *parts)
    return F.concat(*[F.sha2(F.concat(F.lit(f"{i}\x1f"), seed), 512) for i in range(4)])


def _byte(stream: Column, i: Column) -> Column:
    return F.conv(F.substring(stream, F.pmod(i, F.lit(256)) * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _pick(letters: str, n: Column) -> Column:
    return F.substring(F.lit(letters), F.pmod(n, F.lit(len(letters))) + 1, F.lit(1))


def _foreign(c: Column, n: Column) -> Column:
    """A letter of the script of ``c``; Latin where SCRIPTS does not have it."""
    out = F.when(F.lit(False), "")
    for parts in SCRIPTS.values():
        for letters, first, count in parts:
            point = F.lpad(F.hex(F.pmod(n, F.lit(count)) + first), 4, "0")
            out = out.when(c.rlike(letters), F.decode(F.unhex(point), "UTF-16BE"))
    return out.otherwise(_pick("abcdefghijklmnopqrstuvwxyz", n))


def _like(s: Column, stream: Column) -> Column:
    """A string of the same form: digits for digits, letters for letters of the same case and script."""
    hexadecimal = s.rlike("^(?=.*\\d)(?=.*[a-f])[0-9a-f]+$")
    low, cyr = "abcdefghijklmnopqrstuvwxyz", "абвгдежзиклмнопрстуфхцчшэюя"

    def one(c: Column, i: Column) -> Column:
        b = _byte(stream, i)
        return (
            F.when(hexadecimal, _pick("0123456789abcdef", b))
            .when(c.rlike("[0-9]"), _pick("0123456789", b))
            .when(c.rlike("[a-z]"), _pick(low, b))
            .when(c.rlike("[A-Z]"), _pick(low.upper(), b))
            .when(c.rlike(r"\p{IsCyrillic}") & (c == F.lower(c)), _pick(cyr, b))
            .when(c.rlike(r"\p{IsCyrillic}"), _pick(cyr.upper(), b))
            .when(c.rlike(r"[\x{370}-\x{FFFF}&&\p{L}]"), _foreign(c, b * 256 + _byte(stream, i + 97)))
            .when(c.rlike(r"\p{Lu}"), _pick(low.upper(), b))
            .when(c.rlike(r"\p{L}"), _pick(low, b))
            .otherwise(c)
        )

    return F.array_join(F.transform(F.split(s, ""), one), "")


def _luhn(digits: Column) -> Column:
    """The Luhn sum of a string of digits, mod 10."""

    def add(acc: Column, x: Column) -> Column:
        d = F.coalesce(x["c"].try_cast("int"), F.lit(0)) * F.when(F.pmod(x["i"], F.lit(2)) == 1, 2).otherwise(1)
        return acc + F.when(d > 9, d - 9).otherwise(d)

    chars = F.transform(F.reverse(F.split(digits, "")), lambda c, i: F.struct(c.alias("c"), i.alias("i")))
    return F.pmod(F.aggregate(chars, F.lit(0), add), F.lit(10))


def _mod97(s: Column) -> Column:
    """The number that digits and letters (A = 10) spell, mod 97."""
    step = lambda acc, c: F.when(c.rlike("[0-9]"), F.pmod(acc * 10 + F.coalesce(c.try_cast("int"), F.lit(0)), F.lit(97))).otherwise(F.pmod(acc * 100 + F.ascii(c) - 55, F.lit(97)))
    return F.aggregate(F.split(s, ""), F.lit(0), step)


def with_surrogates(units: DataFrame, attempt: int, key: str) -> DataFrame:
    """Adds ``s``, the surrogate of each unit (kind, norm) at an attempt, in the form of its norm."""
    kind, norm, plain, stream = (F.col(c) for c in ("kind", "norm", "plain", "stream"))
    more, grown = F.lit("x" * (attempt // 4)), max(0, (attempt - GROW) // 4 + 1)
    domain, local = F.substring_index(norm, "@", -1), F.substring_index(norm, "@", 1)
    longer = F.when(kind == "email", F.concat(local, more)).when(kind.isin("secret", "name"), F.concat(norm, more)).otherwise(F.concat(norm, F.lit("0" * grown)))
    df = units.withColumn("stream", _stream(key, kind, norm, F.lit(str(attempt)))).withColumn("plain", _like(longer, stream))
    df = df.withColumn("top", F.regexp_extract(domain, r"\.[^.]*$", 0)).withColumn("domain", F.when(kind == "email", domain)).withColumn("hosts", _stream(key, F.lit("domain"), F.col("domain")))
    host = F.substring(F.col("domain"), F.lit(1), F.length("domain") - F.length("top"))
    df = df.withColumn("host", F.when(kind == "email", _like(host, F.col("hosts"))))
    ip = F.concat_ws(".", *[(F.pmod(_byte(stream, F.lit(i)), F.lit(254)) + 1).cast("string") for i in range(4 + grown)])
    phone = F.concat(F.substring(norm, 1, 1), _pick("23456789", _byte(stream, F.lit(200))), F.substring(plain, F.lit(3), F.length(plain)))
    df = df.withColumn("body", F.when(kind == "card", F.concat(F.substring(norm, 1, 1), F.substring(plain, F.lit(2), F.length(plain) - 2))))
    check = F.pmod(10 - _luhn(F.concat(F.col("body"), F.lit("0"))), F.lit(10)).cast("string")
    card = F.concat(F.col("body"), F.when(_luhn(norm) == 0, check).otherwise(F.substring(plain, -1, 1)))
    land, rest = F.substring(norm, 1, 2), F.substring(plain, F.lit(5), F.length(plain))
    valid = _mod97(F.concat(F.substring(norm, F.lit(5), F.length(norm)), F.substring(norm, 1, 4))) == 1
    iban = F.concat(land, F.when(valid, F.lpad((98 - _mod97(F.concat(rest, land, F.lit("00")))).cast("string"), 2, "0")).otherwise(F.substring(plain, 3, 2)), rest)
    ipv6 = F.array_join(F.transform(F.split(norm, ""), lambda c, i: F.when(c == ":", c).otherwise(_pick("0123456789abcdef", _byte(stream, i)))), "")
    ipv6 = F.concat(ipv6, F.lit(":0" * grown))

    def surname(script: str) -> Column:
        parts = [F.element_at(F.array(*map(F.lit, SYLLABLES[script])), F.pmod(_byte(stream, F.lit(i)), F.lit(16)) + 1) for i in range(4)]
        return F.concat(*parts, F.lit(SYLLABLES[script][0][1] * (attempt // 4)))

    name = F.when(norm.rlike(r"\p{IsCyrillic}"), surname("cyrillic")).when(norm.rlike(r"\p{IsLatin}"), surname("latin")).otherwise(plain)
    made = F.when(kind == "email", F.concat(plain, F.lit("@"), F.col("host"), F.col("top"))).when(kind == "ip", ip).when(kind == "ipv6", ipv6).when(kind == "phone", phone).when(kind == "card", card).when(kind == "iban", iban).when(kind == "name", name).otherwise(plain)
    return df.select(*units.columns, made.alias("s"))


def _given_map(key: str) -> Column:
    """Given name -> given name of the same script and gender: one cycle in an order set by the key."""
    pairs = []
    for names in GIVEN.values():
        order = sorted(names, key=lambda n: hashlib.sha256(f"{key}\x1f{n}".encode()).digest())
        pairs += list(zip(order, order[1:] + order[:1]))
    return F.create_map(*[F.lit(x) for p in pairs for x in p])


def _dress(m: Column, core: Column) -> Column:
    """The digits or letters of ``core``, in the places that the mention has for them."""

    def step(acc: Column, c: Column) -> Column:
        place = c.rlike(r"[\p{L}\d]")
        return F.struct(F.concat(acc["out"], F.when(place, F.substring(core, acc["i"], F.lit(1))).otherwise(c)).alias("out"), (acc["i"] + F.when(place, 1).otherwise(0)).alias("i"))

    last = lambda acc: F.concat(acc["out"], F.substring(core, acc["i"], F.length(core)))  # noqa: E731 # more than there are places for
    return F.aggregate(F.split(m, ""), F.struct(F.lit("").alias("out"), F.lit(1).alias("i")), step, last)


# ---- the operator


def distinct_surrogates(units: DataFrame, key: str) -> DataFrame:
    """(kind, norm, s) of distinct units (kind, norm): no two share a surrogate, and none is a unit of the corpus."""
    taken, pending = None, units
    real = units.select("kind", F.col("norm").alias("s"))
    for attempt in range(MAX_ATTEMPTS):
        free = with_surrogates(pending, attempt, key).join(real, ["kind", "s"], "left_anti")
        if taken is not None:
            free = free.join(taken.select("kind", "s"), ["kind", "s"], "left_anti")
        won = cut(free.groupBy("kind", "s").agg(F.min("norm").alias("norm")))
        taken = won if taken is None else taken.unionByName(won)
        pending = cut(pending.join(won, ["kind", "norm"], "left_anti"))
        if pending.isEmpty():
            return taken
    raise ValueError("surrogates could not be kept apart")


def replacements(found: DataFrame, key: str) -> DataFrame:
    """(m, r): each distinct mention and what replaces it."""
    parts = found.select("m").distinct().withColumn("kind", kind_of(F.col("m"))).withColumn("lead", _lead(F.col("kind"), F.col("m")))
    parts = parts.withColumn("rest", F.substring(F.col("m"), F.length("lead") + 1, F.length("m")))
    words = F.when(F.col("kind") == "person", F.split("rest", " ")).otherwise(F.array("rest"))
    parts = parts.select("m", "kind", "lead", F.posexplode(words).alias("i", "w"))
    parts = parts.withColumn("given", F.when(F.col("kind") == "person", F.try_element_at(_given_map(key), F.col("w"))))
    parts = parts.withColumn("norm", F.when(F.col("kind") == "person", F.lower("w")).otherwise(_norm(F.col("kind"), F.col("w"))))
    parts = cut(parts.withColumn("kind", F.when(F.col("kind") == "person", "name").otherwise(F.col("kind"))))
    units = cut(parts.where("given IS NULL").select("kind", "norm").distinct())
    w, kind, made = F.col("w"), F.col("kind"), F.col("s")
    upper = w.rlike(r"\p{Lu}") & (w == F.upper(w))
    piece = F.coalesce("given", F.when((kind == "name") & ~upper, F.initcap(made)).when(kind.isin("phone", "ssn", "card", "iban"), _dress(w, made)).when(upper & kind.isin("email", "name", "ipv6"), F.upper(made)).otherwise(made))
    ready = parts.join(distinct_surrogates(units, key), ["kind", "norm"], "left").select("m", "lead", "i", piece.alias("piece"))
    ordered = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "piece"))), lambda x: x["piece"]), " ")
    return cut(ready.groupBy("m").agg(F.concat(F.first("lead"), ordered).alias("r")))


def replace_pii(docs: DataFrame, key: str, count: str | None = "n_entities") -> DataFrame:
    """The documents with their mentions replaced, and the column ``count``, the number of mentions (None: no such column; one of the input's is replaced)."""
    keyed = docs.select(F.struct("*").alias("row"), F.coalesce("doc_id", F.lit(0)).cast("long").alias("doc"), F.xxhash64("text").alias("hash"))  # one name, so that no column clashes
    found = cut(keyed.select("doc", "hash", F.posexplode(mentions(F.col("row.text"))).alias("i", "m")))
    ready = spread_join(found.distinct(), replacements(found, key), "m")
    ready = ready.groupBy("doc", "hash").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "r"))), lambda x: x["r"]).alias("new"))
    body, new = F.col("row.text"), F.col("new")
    text = F.array_join(F.zip_with(F.split(body, PATTERN, -1), new, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    columns = [F.when(new.isNotNull(), text).otherwise(body).alias("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns if c != count]
    return keyed.join(ready, ["doc", "hash"], "left").select(*columns, *([F.when(new.isNull(), 0).otherwise(F.size(new)).alias(count)] if count else []))
