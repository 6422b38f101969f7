"""Personal data by weak supervision: regex, gazetteer, context and make-up labelers vote on candidate spans.

Base spans (e-mail and IP addresses, card and phone numbers) come from fixed patterns with checks.  Candidates
for further spans come from wider patterns: secrets, national numbers, spelled-out e-mail addresses.  Labelers
vote yes, no or abstain on each candidate; expectation-maximisation over the counts of vote patterns estimates
every labeler's reliability for each kind, and a logistic span classifier is trained on the posteriors over
features of the span.  Candidates that it accepts are added.

Row work is DataFrame functions throughout; texts are read once.  The driver sees counts of vote and feature
patterns, of which there is a fixed number, and gives back a table of accepted patterns as an expression.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from conjunx.llm.common import cut, pick, table

KINDS = ("email", "ip", "card", "phone")
ADDED = ("secret", "number", "address")
#: Characters before a candidate that context labelers see.
CONTEXT = 40
#: Spans whose places are summed in one go; longer lists are summed block by block.
BLOCK = 256

# The base patterns.  Java's possessive quantifiers and the look-behind (a match cannot start inside
# a run that an earlier start would have matched, unless the last match ends there) keep them linear in the text.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What each candidate pattern needs in a text, so that most texts are not searched.
CANDIDATES = {
    "secret": (r"[0-9]", r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{20,}+"),
    "number": (r"[0-9]{2}", r"(?<![A-Za-z0-9+.])\(?[0-9][0-9().\x20/-]{7,30}[0-9](?![0-9A-Za-z])"),
    "address": (r"(?i)[\x20\[(]at[\x20\])]", r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?(?:\[at\]|\(at\)|\x20at\x20)\x20?[A-Za-z0-9-]{1,63}+(?:\x20?(?:\[dot\]|\(dot\)|\x20dot\x20|\.)\x20?[A-Za-z0-9-]{1,63}+)++"),
}

# Gazetteers and context words.
KEY_PREFIXES = r"^(?:AKIA|ASIA|ghp_|gho_|github_pat_|glpat-|sk_live_|sk_test_|pk_live_|xox[abp]-|AIza|eyJ|SG\.|npm_|pypi-)"
DIAL_PREFIXES = r"^\(?0(?:0|1|2|3|4|5|6|7|8|9)|^\(?[2-9][0-9]{2}\)?[\x20./-]"
DOMAINS = r"(?i)(?:gmail|googlemail|yahoo|hotmail|outlook|icloud|proton|aol|gmx|web|mail|example)|(?:com|org|net|edu|gov|de|fr|es|uk|io)$"
SECRET_WORDS = r"(?i)(?:token|secret|passw(?:or)?d|pwd|api.?key|access.?key|key|auth|bearer|credential)s?[^A-Za-z0-9]{0,5}$"
NUMBER_WORDS = r"(?i)(?:tel|telephone|phone|call|mobile|cell|fax|whatsapp|ssn|social security|passport|account|acct|iban|teléfono|téléphone|telefon|handy)[^A-Za-z0-9]{0,5}$"
ADDRESS_WORDS = r"(?i)(?:e-?mail|mail|contact|write to|reach|address|correo|courriel)[^A-Za-z0-9]{0,8}$"
OTHER_WORDS = r"(?i)(?:commit|sha-?[0-9]*|hash|checksum|md5|uuid|version|v|isbn|issn|doi|page|pp|order|invoice|figure|table|section|chapter|meet|arrive|look|stay|live|be|is|was)[^A-Za-z0-9]{0,5}$"


def _running(lens: Column) -> Column:
    """Sums of what comes before each element, for short arrays."""
    start = F.struct(F.lit(0).alias("t"), F.array().cast("array<int>").alias("out"))
    return F.aggregate(lens, start, lambda a, x: F.struct((a["t"] + x).alias("t"), F.concat(a["out"], F.array(a["t"])).alias("out")), lambda a: a["out"])


def _sums_before(lens: Column) -> Column:
    """Sums of what comes before each element: within blocks, and over the blocks' sums."""
    last = F.floor((F.size(lens) - 1) / BLOCK).cast("int")
    blocks = F.sequence(F.lit(0), last)
    part = lambda k: F.slice(lens, k * BLOCK + 1, F.lit(BLOCK))
    sums = F.transform(blocks, lambda k: F.aggregate(part(k), F.lit(0), lambda a, x: a + x))
    return F.when(F.size(lens) <= BLOCK, _running(lens)).otherwise(F.flatten(F.zip_with(blocks, _running(sums), lambda k, b: F.transform(_running(part(k)), lambda y: y + b))))


def _matches(df: DataFrame, pattern: str, needs: Column, to: str) -> DataFrame:
    """``df`` with column ``to``: an array of (start, stop, value, before) of the pattern's matches in text."""
    none = F.array().cast("array<string>")
    df = df.withColumns({"_m": F.when(needs, F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).otherwise(none)})
    df = df.withColumns({"_g": F.when(F.size("_m") > 0, F.split("text", pattern, -1)).otherwise(none)})
    df = df.withColumns({"_g": F.slice("_g", 1, F.size("_m"))})
    df = df.withColumns({"_l": F.zip_with("_g", "_m", lambda g, m: F.length(g) + F.length(m))})
    df = df.withColumns({"_s": F.when(F.size("_l") > 0, _sums_before(F.col("_l"))).otherwise(F.array().cast("array<int>"))})
    joined = F.zip_with(F.zip_with("_s", "_g", lambda s, g: F.struct((s + F.length(g)).alias("start"), F.substring(g, F.greatest(F.length(g) - CONTEXT + 1, F.lit(1)), F.lit(CONTEXT)).alias("before"))), "_m", lambda p, m: F.struct(p["start"].alias("start"), (p["start"] + F.length(m)).alias("stop"), m.alias("value"), p["before"].alias("before")))
    return df.withColumns({to: joined}).drop("_m", "_g", "_l", "_s")


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _passes(kind: str, value: Column) -> Column:
    if kind == "ip":
        bare = lambda p: F.coalesce(F.nullif(F.regexp_replace(p, "^0+", ""), F.lit("")), F.lit("0"))
        return F.forall(F.split(value, r"\."), lambda p: F.coalesce(bare(p).try_cast("int"), F.lit(999)) <= 255)
    if kind == "card":
        return F.length(_digits(value)).between(13, 19) & F.call_function("luhn_check", _digits(value))
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    return F.lit(True)


def _vote(yes: Column, no: Column | None = None) -> Column:
    out = F.when(yes, 1)
    return (out.when(no, -1) if no is not None else out).otherwise(0)


def _votes(kind: str, value: Column, before: Column) -> list[Column]:
    """What each labeler says: shape, gazetteer, context, make-up."""
    other, digits = before.rlike(OTHER_WORDS), _digits(value)
    variety = F.size(F.array_distinct(F.split(digits, "")))
    if kind == "secret":
        shape = _vote(value.rlike(r"^[0-9a-fA-F]{32,64}$|^[A-Za-z0-9]{24,}$"), value.rlike(r"^(?:[a-z]+[-_])+[a-z0-9]+$"))
        return [shape, _vote(value.rlike(KEY_PREFIXES)), _vote(before.rlike(SECRET_WORDS), other), _vote(F.length(digits).between(F.length(value) * 0.15, F.length(value) * 0.85), F.length(digits) < 3)]
    if kind == "number":
        shape = _vote(value.rlike(r"^\(?[0-9]{3}\)?[\x20.-][0-9]{3,4}[\x20.-][0-9]{4}$|^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), value.rlike(r"^[0-9]{1,4}[-./][0-9]{1,2}[-./][0-9]{1,4}|^[0-9]+(?:\.[0-9]+)+$") | ~F.length(digits).between(9, 12))
        return [shape, _vote(value.rlike(DIAL_PREFIXES), value.rlike("^[0-9]+$")), _vote(before.rlike(NUMBER_WORDS), other), _vote(variety >= 5, variety <= 3)]
    shape = _vote(value.rlike(r"(?i)(?:\[at\]|\(at\)).*(?:\[dot\]|\(dot\)|\.)|\x20at\x20.*\x20dot\x20"), value.rlike(r"(?i)\x20at\x20[^.]*\.\x20"))
    return [shape, _vote(value.rlike(DOMAINS)), _vote(before.rlike(ADDRESS_WORDS), other), _vote(value.rlike(r"^[^\x20]*[0-9._]"), ~value.rlike(r"(?i)dot|\["))]


def _features(kind: str, value: Column, before: Column) -> list[Column]:
    """What the span classifier sees, besides the kind: small numbers."""
    length = F.when(F.length(value) < 12, 0).when(F.length(value) < 24, 1).when(F.length(value) < 36, 2).otherwise(3)
    share = F.floor(F.length(_digits(value)) * 4 / F.length(value)).cast("int")
    words = {"secret": SECRET_WORDS, "number": NUMBER_WORDS, "address": ADDRESS_WORDS}[kind]
    near = F.when(before.rlike(words), 2).when(before.rlike(OTHER_WORDS), 0).otherwise(1)
    ahead = F.when(before.rlike(r"[=:]\s*[\"']?$"), 2).when(before.rlike(r"[A-Za-z]\s*$"), 1).otherwise(0)
    return [length, share, near, ahead]


def _kept(k: int, kind: str) -> Column:
    """The matches of a base kind that pass its check."""
    return F.transform(F.filter(kind, lambda s: _passes(kind, s["value"])), lambda s: F.struct(F.lit(k).alias("kind"), s["start"].alias("start"), s["stop"].alias("stop")))


def _overlaps(kind: str, c: Column) -> Column:
    """Whether a span of the base ``kind``, which are apart and in order, overlaps ``c``: found by halving, so that many spans
    in a text do not make for as many comparisons of each candidate."""
    n = F.size(kind)

    def halved(a, _):
        middle = F.floor((a["low"] + a["high"]) / 2).cast("int")
        before = F.element_at(F.col(kind), middle + 1)["start"] < c["stop"]
        low, high = F.when(before, middle + 1).otherwise(a["low"]), F.when(before, a["high"]).otherwise(middle)
        return F.when(a["low"] < a["high"], F.struct(low.alias("low"), high.alias("high"))).otherwise(a)

    last = F.aggregate(F.sequence(F.lit(0), F.length(F.bin(n.cast("long")))), F.struct(F.lit(0).alias("low"), n.alias("high")), halved, lambda a: a["low"])
    return F.coalesce(F.try_element_at(F.col(kind), F.nullif(last, F.lit(0)))["stop"] > c["start"], F.lit(False))


def _seen(k: int, kind: str) -> Column:
    """The candidates of a kind with their votes and features."""

    def one(s: Column) -> Column:
        value, before = s["value"], s["before"]
        return F.struct(F.lit(k).alias("kind"), s["start"].alias("start"), s["stop"].alias("stop"), F.array(*_votes(kind, value, before)).alias("votes"), F.array(*_features(kind, value, before)).alias("features"))

    return F.transform(kind, one)


def spans(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, base (arrays of kind, start, stop), found (base and accepted spans), places in code points, stop
    exclusive; base kinds in the order of KINDS, then ADDED, each by start.

    A null or empty text has none.  Rows are judged each by itself but for the reliabilities, which all rows'
    candidates give; without candidates none are added.  Candidates that overlap base spans are left out.
    """
    return _spans(pick(docs, doc_id=doc_id, text=text), "doc_id")


def _spans(df: DataFrame, *carried: str) -> DataFrame:
    """The columns ``carried``, base and found of each row of ``df``, by its column text."""
    df = df.withColumn("text", F.coalesce(F.col("text").cast("string"), F.lit("")))
    digit = F.col("text").rlike("[0-9]")
    needs = {"email": F.contains("text", F.lit("@")), "phone": F.contains("text", F.lit("+"))}
    for k, kind in enumerate(KINDS):
        df = _matches(df, BASE[kind], needs.get(kind, digit), kind)
        df = df.withColumn(kind, _kept(k, kind))
    for k, kind in enumerate(ADDED, len(KINDS)):
        need, pattern = CANDIDATES[kind]
        df = _matches(df, pattern, F.col("text").rlike(need), kind)
        if kind == "secret":
            df = df.withColumn(kind, F.filter(kind, lambda s: s["value"].rlike("[0-9]") & s["value"].rlike("[A-Za-z]")))
        df = df.withColumn(kind, _seen(k, kind))
    df = df.withColumn("candidates", F.concat(*ADDED))
    for kind in KINDS:
        free = F.filter("candidates", lambda c: ~_overlaps(kind, c))  # noqa: B023
        df = df.withColumn("candidates", F.when((F.size(kind) > 0) & (F.size("candidates") > 0), free).otherwise(F.col("candidates")))
    df = cut(df.select(*carried, F.concat(*KINDS).alias("base"), "candidates"))
    counted = df.where(F.size("candidates") > 0).select(F.explode("candidates").alias("c")).groupBy("c.kind", "c.votes", "c.features").count()
    accepted = classify([(r.kind, tuple(r.votes), tuple(r.features), r["count"]) for r in counted.toLocalIterator()])
    if not accepted:
        added = F.array().cast("array<struct<kind:int,start:int,stop:int>>")
    else:
        name = lambda kind, features: F.concat_ws(",", kind.cast("string"), F.array_join(features.cast("array<string>"), ","))
        good = [",".join(map(str, (kind, *features))) for kind, features in accepted]
        added = F.transform(F.filter("candidates", lambda c: name(c["kind"], c["features"]).isin(good)), lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["stop"].alias("stop")))
    return df.select(*carried, "base", F.concat("base", added).alias("found"))


def reliabilities(counts: list[tuple[tuple[int, ...], int]], rounds: int = 50) -> tuple[float, list[list[list[float]]], dict[tuple[int, ...], float]]:
    """Expectation-maximisation over vote patterns with their counts: the share of true spans, for each labeler
    the chances of (no, abstain, yes) for false and for true spans, and each pattern's posterior."""
    labelers = range(len(counts[0][0]))
    share, total = 0.5, sum(n for _, n in counts)
    chances = [[[0.3, 0.6, 0.1], [0.1, 0.6, 0.3]] for _ in labelers]  # better than chance, to begin with
    posterior: dict[tuple[int, ...], float] = {}
    for _ in range(rounds):
        for votes, _n in counts:
            odds = math.log(share / (1 - share)) + sum(math.log(chances[k][1][votes[k] + 1] / chances[k][0][votes[k] + 1]) for k in labelers)
            posterior[votes] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
        share = min(0.99, max(0.01, sum(n * posterior[v] for v, n in counts) / total))
        for k in labelers:
            for truth in (0, 1):
                weight = [1.0, 1.0, 1.0]  # a smoothing observation of each vote
                for v, n in counts:
                    weight[v[k] + 1] += n * (posterior[v] if truth else 1 - posterior[v])
                chances[k][truth] = [x / sum(weight) for x in weight]
    return share, chances, posterior


def classify(counts: list[tuple[int, tuple[int, ...], tuple[int, ...], int]], rounds: int = 400) -> list[tuple[int, tuple[int, ...]]]:
    """(kind, features) of the spans that the classifier accepts, from (kind, votes, features, count)."""
    soft: dict[tuple[int, tuple[int, ...]], list[float]] = {}
    for kind in sorted({c[0] for c in counts}):
        patterns: dict[tuple[int, ...], int] = {}
        for k, votes, _, n in counts:
            if k == kind:
                patterns[votes] = patterns.get(votes, 0) + n
        _, _, posterior = reliabilities(sorted(patterns.items()))
        for k, votes, features, n in counts:
            if k == kind:
                at = soft.setdefault((kind, features), [0.0, 0.0])
                at[0] += n
                at[1] += n * posterior[votes]
    rows = [(key, n, y / n) for key, (n, y) in sorted(soft.items())]
    named = {key: [f"{key[0]}", *(f"{key[0]}:{i}:{v}" for i, v in enumerate(key[1]))] for key, _, _ in rows}
    weights = dict.fromkeys((x for names in named.values() for x in names), 0.0)
    squares, total = dict.fromkeys(weights, 1e-8), sum(n for _, n, _ in rows) or 1
    guess = lambda key: 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(weights[x] for x in named[key])))))
    for _ in range(rounds):  # logistic regression on the posteriors, each pattern weighted by its count
        slope = {x: 1e-4 * w for x, w in weights.items()}
        for key, n, y in rows:
            error = (guess(key) - y) * n / total
            for x in named[key]:
                slope[x] += error
        for x, g in slope.items():
            squares[x] += g * g
            weights[x] -= 0.5 * g / squares[x] ** 0.5
    return [key for key, _, _ in rows if guess(key) >= 0.5]


def _text_of(array: str) -> Column:
    names = F.array(*(F.lit(k) for k in (*KINDS, *ADDED)))
    return F.array_join(F.transform(array, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def redact(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with every span of a text replaced by its kind in angle brackets, overlapping ones by the first's.

    Each row is cut at the spans of its own text, whatever its id; a row carries its columns along."""
    own = docs.columns
    plain = docs.toDF(*(f"c{k}" for k in range(len(own))))
    body = f"c{own.index(text)}"
    found = _spans(plain.withColumn("text", F.col(body)), *plain.columns)
    names = F.array(*(F.lit(f"<{k.upper()}>") for k in (*KINDS, *ADDED)))
    ordered = F.array_sort(F.transform("found", lambda s: F.struct(s["start"], s["stop"], s["kind"])))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(a, s):
        fresh = s["start"] >= a["at"]
        piece = F.array(F.substring(F.col(body), a["at"] + 1, s["start"] - a["at"]), F.element_at(names, s["kind"] + 1))
        return F.struct(F.greatest(a["at"], s["stop"]).alias("at"), F.when(fresh, F.concat(a["out"], piece)).otherwise(a["out"]).alias("out"))

    new = F.aggregate(ordered, start, step, lambda a: F.concat(F.array_join(a["out"], ""), F.substring(F.col(body), a["at"] + 1, F.length(body))))
    return found.withColumn(body, F.when(F.size("found") > 0, new).otherwise(F.col(body))).select(*plain.columns).toDF(*own)


def op3_pii(spark, sf_dir: str) -> DataFrame:
    """Per document: base spans of each kind, their digest, and all spans."""
    found = spans(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select("doc_id", *(count(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)), F.sha2(_text_of("base").cast("binary"), 256).alias("base_sha256"), _text_of("found").alias("spans"))
