"""Personal data by weak supervision: labelers vote on candidate spans, their reliabilities are estimated by
expectation-maximisation, and a span classifier is trained on the result.  DataFrame functions only."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import landed

KINDS = ("email", "ip", "card", "phone", "secret", "name")
BASE_KINDS = KINDS[:4]

# Candidate patterns, the base ones in forms that read each character a bounded number of times: a match starts at the
# first character of a run or right after the match before, which is where the leftmost match starts.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "secret": r"(?<![A-Za-z0-9_+/-])(?=[A-Za-z_+/-]*+[0-9])[A-Za-z0-9_+/-]{20,}+",
    "name": r"(?<!\p{L})\p{Lu}\p{Ll}++\x20\p{Lu}\p{Ll}++(?!\p{L})",
}
# What a text must contain to be searched for a kind; cheaper than the pattern.
NEEDED = {
    "email": lambda t: t.contains("@"),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]"),
    "card": lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){12}"),
    "phone": lambda t: t.contains("+"),
    "secret": lambda t: t.rlike(r"[A-Za-z0-9_+/-]{20}"),
    "name": lambda t: t.rlike(PATTERNS["name"]),
}
# A number chain or phone this short or long can be no candidate; the base rule drops it as well.
IP = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.|$)){4}$"

# Word lists of the gazetteer and context labelers (fixed values).
TOP_DOMAINS = "com org net edu gov mil int info io co ai app dev uk us ca au nz ie de at ch fr es it pt nl be lu dk se no fi pl cz ru ua tr gr il in cn jp kr br mx ar za"
CALLING_CODES = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 52 54 55 60 61 62 63 64 65 66 81 82 84 86 90 91 92 98 351 352 353 358 380 420 972"
RESERVED_NETS = r"^(?:0|10|127|255|169\.254|192\.168|172\.(?:1[6-9]|2[0-9]|3[01]))\."
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|6011|65|35)"
KEY_PREFIXES = r"^(?:sk_|pk_|ghp_|gho_|AKIA|ASIA|xox[abp]-|AIza|eyJ)"
GIVEN_NAMES = (
    "James Mary John Patricia Robert Jennifer Michael Linda William Elizabeth David Barbara Richard Susan Joseph Jessica "
    "Thomas Sarah Charles Karen Daniel Lisa Matthew Nancy Anthony Betty Mark Sandra Paul Emma Anna Peter Hans Klaus Jean "
    "Pierre Marie Claire Louis Carlos Juan Ana Luis Sofia Pedro Lucia Marco Giulia Ivan Olga Wei Li Yuki Kenji Ahmed Fatima")
CUES = {
    "email": r"(?:e-?mail|contact|write|reach|courriel|correo|kontakt)[^\n]{0,20}$",
    "ip": r"(?:\bip\b|address|server|host|from|adresse)[^\n]{0,15}$",
    "card": r"(?:card|visa|credit|debit|payment|karte|carte|tarjeta)[^\n]{0,20}$",
    "phone": r"(?:phone|tel|call|mobile|cell|fax|whatsapp|telefon|appel)[^\n]{0,20}$",
    "secret": r"(?:token|secret|password|passwd|api.?key|access.?key|bearer)[\s\"'=:]{0,8}$",
    "name": r"(?:name is|i am|signed|mr\.?|mrs\.?|ms\.?|dr\.?|prof\.?|dear|by)\s*$",
}
COUNTER_CUES = {
    "email": r"(?:example|format)[^\n]{0,10}$",
    "ip": r"(?:version|release|section|chapter|v)[\s.:]{0,3}$",
    "card": r"(?:order|invoice|isbn|tracking|serial|part|item|no\.|#)[^\n]{0,10}$",
    "phone": r"(?:score|range|plus)[^\n]{0,5}$",
    "secret": r"(?:sha|md5|commit|checksum|hash|/)[^\n]{0,8}$",
    "name": r"(?:the|of|in|at)\s*$",
}

VOTES = ("regex", "gazetteer", "context", "form")
FEATURES = ("length", "digits")
NO, YES, ABSTAIN = 0, 1, 2
ROUNDS = 12
SMOOTH = 1.0
BLOCK = 64


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def starts_of(steps: Column) -> Column:
    """For an array of lengths, the sum in front of each; by blocks, so that long arrays stay cheap."""
    def total(part: Column) -> Column:
        return F.aggregate(part, F.lit(0), lambda a, x: a + x)

    blocks = F.when(F.size(steps) > 0, F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / BLOCK).cast("int"))).otherwise(
        F.array().cast("array<int>"))
    sums = F.transform(blocks, lambda b: total(F.slice(steps, b * BLOCK + 1, F.lit(BLOCK))))
    fronts = F.aggregate(
        sums, F.array(F.lit(0)), lambda made, x: F.concat(made, F.array(F.element_at(made, -1) + x)))
    return let(fronts, lambda front: F.transform(steps, lambda _, i: F.get(front, F.floor(i / BLOCK).cast("int")) + total(
        F.slice(steps, F.floor(i / BLOCK).cast("int") * BLOCK + 1, i % BLOCK))))


def found(text: Column, kind: str) -> Column:
    """Leftmost non-overlapping matches with ``start``, ``m`` and some text on both sides."""
    pattern = PATTERNS[kind]

    def placed(s: Column) -> Column:
        gaps, matches = s["gaps"], s["m"]
        steps = F.zip_with(F.slice(gaps, F.lit(1), F.size(matches)), matches, lambda g, m: F.length(g) + F.length(m))
        return let(starts_of(steps), lambda front: F.transform(matches, lambda m, i: F.struct(
            (F.get(front, i) + F.length(F.get(gaps, i))).alias("start"), m.alias("m"),
            F.right(F.get(gaps, i), F.lit(40)).alias("left"), F.left(F.get(gaps, i + 1), F.lit(1)).alias("right"))))

    none = F.array().cast("array<struct<start:int,m:string,left:string,right:string>>")
    both = F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"))
    return F.when(NEEDED[kind](text), let(both, placed)).otherwise(none)


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(number: Column) -> Column:
    each = F.transform(F.split(F.reverse(number), ""), lambda d, i: d.cast("int") * (1 + i % 2))
    return F.aggregate(each, F.lit(0), lambda a, d: a + d - F.when(d > 9, 9).otherwise(0)) % 10 == 0


def strict(kind: str, m: Column) -> Column:
    """Whether a match counts as base."""
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return m.rlike(IP)
    if kind == "card":
        return F.when(F.length(digits(m)).between(13, 19), luhn(digits(m))).otherwise(False)
    if kind == "phone":
        return F.length(digits(m)).between(9, 15)
    return F.lit(False)


def words(text: str) -> str:
    return "(?:" + "|".join(text.split()) + ")"


def vote(yes: Column, no: Column) -> Column:
    return F.when(yes, YES).when(no, NO).otherwise(ABSTAIN)


def labels(kind: str, c: Column, base: Column) -> dict[str, Column]:
    """The labelers' votes on one candidate."""
    m, never = c["m"], F.lit(False)
    if kind == "secret":
        hexadecimal = m.rlike(r"^(?:[0-9a-f]{32,}|[0-9A-F]{32,})$")
        by_regex = vote(hexadecimal, ~hexadecimal & ~m.rlike(r"^(?=.*[a-z])(?=.*[A-Z])"))
    elif kind == "name":
        by_regex = F.lit(ABSTAIN)
    else:
        by_regex = vote(base, ~base)
    known = {
        "email": m.rlike(rf"\.{words(TOP_DOMAINS)}$"), "ip": ~m.rlike(RESERVED_NETS), "card": digits(m).rlike(ISSUERS),
        "phone": m.rlike(rf"^\+{words(CALLING_CODES)}"), "secret": m.rlike(KEY_PREFIXES), "name": m.rlike(rf"^{words(GIVEN_NAMES)} "),
    }[kind]
    by_list = vote(known, never if kind == "secret" else ~known)
    near = F.lower(c["left"])
    by_context = vote(near.rlike(CUES[kind]), near.rlike(COUNTER_CUES[kind]))
    glued = F.right(c["left"], F.lit(1)).rlike(r"[\p{L}\p{N}]") | c["right"].rlike(r"[\p{L}\p{N}]")
    return dict(zip(VOTES, (by_regex, by_list, by_context, vote(~glued, glued))))


def features(m: Column) -> dict[str, Column]:
    """What the classifier sees besides the votes, in four steps each."""
    share = F.length(digits(m)) / F.length(m)
    size = F.length(m)
    return {
        "length": F.when(size < 12, 0).when(size < 18, 1).when(size < 32, 2).otherwise(3),
        "digits": F.when(share < 0.1, 0).when(share < 0.5, 1).when(share < 0.9, 2).otherwise(3),
    }


def candidates(text: Column) -> Column:
    """All candidates of a text, kind by kind and in order: kind, start, end, base, votes, features."""
    def described(number: int, kind: str) -> Column:
        def one(c: Column) -> Column:
            return let(strict(kind, c["m"]), lambda base: F.struct(
                F.lit(number).alias("kind"), c["start"].alias("start"), (c["start"] + F.length(c["m"])).alias("end"), base.alias("base"),
                *[v.cast("int").alias(n) for n, v in (labels(kind, c, base) | features(c["m"])).items()]))

        spans = found(text, kind)
        if kind == "card":
            spans = F.filter(spans, lambda c: F.length(digits(c["m"])).between(13, 19))
        return F.transform(spans, one)

    return F.flatten(F.array(*[described(k, kind) for k, kind in enumerate(KINDS)]))


def looked_up(table: dict[tuple[int, int], float], kind: Column, value: Column, width: int) -> Column:
    """``table[kind, value]`` as an expression."""
    flat = [table[k, v] for k in range(len(KINDS)) for v in range(width)]
    return F.get(F.array(*[F.lit(float(x)) for x in flat]), kind * width + value)


def weighted_sums(counts: DataFrame, weight: Column, columns: tuple[str, ...], width: int) -> dict:
    """{(column, class): {(kind, value): weight}} and {(class): {kind: weight}}, a few numbers made by one aggregate."""
    sums = []
    for side, part in ((1, weight), (0, 1 - weight)):
        mass = F.col("n") * part
        sums.append(F.sum(mass).alias(f"all_{side}"))
        sums += [F.sum(F.when(F.col(c) == v, mass).otherwise(0.0)).alias(f"{c}_{side}_{v}") for c in columns for v in range(width)]
    rows = {r["kind"]: r for r in counts.groupBy("kind").agg(*sums).collect()}  # one row a kind

    def get(kind: int, name: str) -> float:
        return float(rows[kind][name]) if kind in rows else 0.0

    kinds = range(len(KINDS))
    out = {(c, side): {(k, v): get(k, f"{c}_{side}_{v}") for k in kinds for v in range(width)} for c in columns for side in (0, 1)}
    out["all"] = {(k, side): get(k, f"all_{side}") for k in kinds for side in (0, 1)}
    return out


Score = Callable[[Callable[[str], Column]], Column]


def log_odds(counts: DataFrame, weight: Column, columns: tuple[str, ...], width: int) -> Score:
    """Log-odds of being personal data, by smoothed rates of each column's values under the given class weights.

    The result is a function: given how to get a column, it builds the expression.
    """
    sums = weighted_sums(counts, weight, columns, width)
    kinds = range(len(KINDS))
    prior = {(k, 0): math.log((sums["all"][k, 1] + SMOOTH) / (sums["all"][k, 0] + SMOOTH)) for k in kinds}
    tables = {}
    for c in columns:
        rates = {
            side: {(k, v): (sums[c, side][k, v] + SMOOTH) / (sums["all"][k, side] + SMOOTH * width)
                   for k in kinds for v in range(width)} for side in (0, 1)}
        tables[c] = {at: math.log(rates[1][at] / rates[0][at]) for at in rates[1]}

    def score(get: Callable[[str], Column]) -> Column:
        total = looked_up(prior, get("kind"), F.lit(0), 1)
        for c in columns:
            total = total + looked_up(tables[c], get("kind"), get(c), width)
        return total

    return score


def classifier(spans: DataFrame, rounds: int = ROUNDS) -> Score:
    """The final span classifier: log-odds over the columns of ``candidates``.

    ``spans`` has one row per candidate.  Only their counts by pattern (at most 6 kinds, 3 to the 4 votes, 4 to the 2
    features) leave the tasks.  Expectation-maximisation starts from the majority of the votes and estimates for
    each kind how often personal data and other spans get each vote; the classifier, votes and features together, is
    then fitted to the last posteriors.
    """
    counts = landed(spans.groupBy("kind", *VOTES, *FEATURES).agg(F.count("*").alias("n")).coalesce(1), "patterns")
    yes = sum((F.when(F.col(v) == YES, 1).otherwise(0) for v in VOTES), F.lit(0))
    cast = sum((F.when(F.col(v) != ABSTAIN, 1).otherwise(0) for v in VOTES), F.lit(0))
    weight = (yes + 0.5) / (cast + 1)
    for _ in range(rounds):
        weight = 1 / (1 + F.exp(-log_odds(counts, weight, VOTES, 3)(F.col)))
    return log_odds(counts, weight, VOTES + FEATURES, 4)


def with_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without ``text``, plus ``spans``: the personal data of every whole text.

    A span has ``kind``, ``start`` and ``end`` (code points), ``base`` for those of the base patterns, which always
    stay, and ``score``, the classifier's log-odds; other candidates stay where it is above 0.  Spans of different kinds may
    overlap.  A null text is empty; repeated rows and ties each keep their row; a column ``spans`` is replaced; without
    candidates there are no spans.
    """
    others = [c for c in docs.columns if c not in (text, "spans")]
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    table = landed(docs.select(*[F.col(f"`{c}`") for c in others], candidates(body).alias("spans")), "candidates")
    score = classifier(table.select(F.inline("spans")))
    names = F.array(*[F.lit(k) for k in KINDS])
    chosen = F.filter(
        F.transform("spans", lambda s: F.struct(
            F.get(names, s["kind"]).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["base"].alias("base"),
            score(lambda c: s[c]).alias("score"))),
        lambda s: s["base"] | (s["score"] > 0))
    return table.select(*[F.col(f"`{c}`") for c in others], chosen.alias("spans"))


def digest(found: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Counts of base spans, the hash of their places, and all spans as text."""
    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    base = F.filter("spans", lambda s: s["base"])
    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")

    counts = [count(kind) for kind in BASE_KINDS]
    return found.select(doc_id, *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
