"""Personal data by weak supervision. Built-in functions only.

1. ``candidates``: the base kinds (email, ip, card, phone) by their patterns, and looser candidates:
   matches that fail their kind's check, telephone numbers without a plus, social security numbers, IBANs.
2. Labelers vote on each candidate, yes, no or abstaining: a regex and checksum labeler, a gazetteer
   labeler (top-level domains, calling codes, issuer digits, countries, reserved networks) and a
   context labeler (cue words in front).
3. ``estimate``: expectation-maximisation over the counts of vote patterns (a bounded table, whatever
   the input) gives each labeler's reliability and the probability of each pattern.
4. ``train``: a span classifier (naive Bayes over shape and context features) is fitted to those
   probabilities by one aggregation. Looser candidates that it accepts and that lie outside base
   spans are added; base spans stay.

The patterns are those of the base rules with possessive quantifiers and a look-behind, which match
the same spans without backtracking, so that long runs of characters take linear time.

Defined results: a null text is empty; an empty text has no spans; spans of equal start are ordered
by kind as listed; repeated rows count as often as they occur; an empty table gives no rows; kept
columns stand under their own names. Positions are code points, ends exclusive.
"""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import let
from ..runtime import cut_lineage

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "ssn", "iban")
CONTEXT_CHARS = 32
BLOCK = 128

# fixed values: patterns of the base rules, looser patterns, lists and cue words
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
LOOSE_PHONE = r"(?<![0-9+.-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
IP_CHECK = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})(?:\.|$)){4}$"
RESERVED = r"^0*(?:0|127|255|22[4-9]|23[0-9]|24[0-9]|25[0-5])\."
DOMAINS = "com org net edu gov mil int info biz io ai app dev co me uk de fr es it nl eu ch at be pt pl se no dk fi ru cn jp kr in br mx ar ca au nz us".split()
CALLING = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 54 55 56 57 60 61 62 63 64 65 66 81 82 84 86 90 91 351 352 353 358 380 420".split()
COUNTRIES = "AT BE BG CH CZ DE DK EE ES FI FR GB GR HR HU IE IT LT LU LV NL NO PL PT RO SE SI SK".split()
CUES = {"email": r"mail|contact|write|schreib|écri|correo", "ip": r"\bip\b|host|server|addr|client|login",
        "card": r"card|visa|master|amex|credit|karte|carte|tarjeta|pay", "phone": r"phone|tel|call|mobil|fax|cell|ruf",
        "ssn": r"ssn|social|security", "iban": r"iban|bank|konto|account|compte|cuenta"}
AGAINST = r"version|isbn|page|order|sku|build|release|figure|serial|\bid\b|\bv$"

SPAN = "array<struct<start:bigint,end:bigint,value:string>>"


def _blocks(items: Column) -> Column:
    """An array in blocks of ``BLOCK`` entries, so that no step copies or visits all of a long one."""
    last = F.greatest(F.ceil(F.size(items) / BLOCK).cast("int") - 1, F.lit(0))
    return F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(items, k * BLOCK + 1, BLOCK))


def matches(text: Column, pattern: str) -> Column:
    """All matches, left to right, without overlap: (start, end, value).

    Starts are running sums of lengths: within blocks first, then over the blocks.
    """
    between, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    steps = F.zip_with(between, found, lambda b, v: F.struct(F.length(b).cast("bigint").alias("gap"), v.alias("value")))
    zero = F.lit(0).cast("bigint")
    start = F.struct(zero.alias("at"), F.array().cast(SPAN).alias("out"))

    def step(a: Column, s: Column) -> Column:
        first = a["at"] + s["gap"]
        last = first + F.length(s["value"])
        span = F.struct(first.alias("start"), last.alias("end"), s["value"].alias("value"))
        return F.when(s["value"].isNull(), a).otherwise(
            F.struct(last.cast("bigint").alias("at"), F.array_append(a["out"], span).cast(SPAN).alias("out")))

    def total(a: Column, block: Column) -> Column:
        return F.struct((a["at"] + block["at"]).alias("at"), F.array_append(a["out"], a["at"]).alias("out"))

    def placed(blocks: Column) -> Column:
        offsets = F.aggregate(blocks, F.struct(zero.alias("at"), F.array().cast("array<bigint>").alias("out")), total)["out"]
        return F.flatten(F.zip_with(blocks, offsets, lambda block, offset: F.transform(block["out"], lambda s: F.struct(
            (s["start"] + offset).alias("start"), (s["end"] + offset).alias("end"), s["value"].alias("value")))))

    return let(let(steps, lambda every: F.transform(_blocks(every), lambda block: F.aggregate(block, start, step))), placed)


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    number = F.reverse(digits(value))

    def add(total: Column, k: Column) -> Column:
        d = F.substring(number, k, F.lit(1)).cast("int")
        return total + F.when(k % 2 == 0, d * 2 - F.when(d > 4, 9).otherwise(0)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(number)), F.lit(0), add) % 10 == 0


def passes(kind: str, value: Column) -> Column:
    """The check of a base kind."""
    n = F.length(digits(value))
    return {"email": F.lit(True), "ip": value.rlike(IP_CHECK), "phone": n.between(10, 15),
            "card": F.when(n.between(14, 19), luhn(value)).otherwise(False)}[kind]


def _gazetteer(kind: str, value: Column) -> Column:
    def listed(values: list[str]) -> Column:
        return F.array(*map(F.lit, values))

    number = digits(value)
    if kind == "email":
        return F.array_contains(listed(DOMAINS), F.lower(F.element_at(F.split(value, r"\."), -1)))
    if kind == "ip":
        return ~value.rlike(RESERVED)
    if kind == "card":
        return number.rlike("^[3-6]")
    if kind == "phone":
        codes = listed(CALLING)
        with_plus = F.exists(F.transform(F.array(*map(F.lit, (1, 2, 3))), lambda k: F.array_contains(codes, F.left(number, k))),
                             lambda x: x)
        return F.when(value.startswith("+"), with_plus).otherwise(number.rlike("^[2-9]"))
    if kind == "ssn":
        return ~number.rlike("^(?:000|666|9)")
    return F.array_contains(listed(COUNTRIES), F.left(value, F.lit(2)))


def _vote(yes: Column) -> Column:
    return F.when(yes, 1).otherwise(0)


def _voted(text: Column, kind: str, spans: Column, strict: bool) -> Column:
    """Spans as candidates with their votes and features."""
    def candidate(s: Column, piece: Column, base: Column) -> Column:
        at = (s["start"] - base).cast("int")
        before = F.lower(F.substring(piece, F.greatest(at - CONTEXT_CHARS + 1, F.lit(1)), F.least(at, F.lit(CONTEXT_CHARS))))
        after = F.substring(piece, (s["end"] - base + 1).cast("int"), F.lit(1))
        return let(before, lambda b: let(after, lambda a: judged(s, b, a)))

    def judged(s: Column, before: Column, after: Column) -> Column:
        value = s["value"]
        good = passes(kind, value) if strict else F.lit(False)
        context = F.when(before.rlike(CUES[kind]), 1).when(before.rlike(AGAINST), 0).otherwise(-1)
        ends = F.when(after == "", "end").when(after.rlike(r"\s"), "space").when(after.rlike(r"\w"), "word").otherwise("mark")
        starts = F.when(before == "", "end").when(before.rlike(r"\s$"), "space").when(before.rlike(r"\w$"), "word").otherwise("mark")
        shape = F.array(
            F.concat(F.lit(f"{kind} length "), F.least(F.length(value) / 4, F.lit(10)).cast("int").cast("string")),
            F.concat(F.lit("before "), starts), F.concat(F.lit("after "), ends),
            F.concat(F.lit(f"{kind} separators "), F.least(F.length(value) - F.length(digits(value)), F.lit(8)).cast("string")),
            F.concat(F.lit("cue "), context.cast("string")))
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(kind).alias("kind"), good.alias("base"),
                        (_vote(good) if strict else F.lit(-1)).alias("regex"), _vote(_gazetteer(kind, value)).alias("gazetteer"),
                        context.alias("context"), shape.alias("features"))

    def of_block(block: Column) -> Column:
        # a stretch of the text around a block of spans: positions in a whole long text are slow to find
        base = F.greatest(F.element_at(block, 1)["start"] - CONTEXT_CHARS, F.lit(0).cast("bigint"))
        piece = F.substring(text, (base + 1).cast("int"), (F.element_at(block, -1)["end"] - base + 1).cast("int"))
        return let(base, lambda at: let(piece, lambda p: F.transform(block, lambda s: candidate(s, p, at))))

    return let(spans, lambda every: F.flatten(F.transform(F.filter(_blocks(every), lambda b: F.size(b) > 0), lambda block: of_block(block))))


def candidates(text: Column) -> Column:
    """All candidates of a text with votes and features; cheap tests come first."""
    def when(test: Column, kind: str, pattern: str, strict: bool = True) -> Column:
        return _voted(text, kind, F.when(test, matches(text, pattern)).otherwise(F.array().cast(SPAN)), strict)

    return F.concat(
        when(text.contains("@"), "email", EMAIL),
        when(text.rlike(r"[0-9]\.[0-9]++\.[0-9]"), "ip", IP),
        # shorter runs of digits are no candidates; the pattern itself takes whole runs
        F.filter(when(text.rlike(r"[0-9](?:[\x20-]?[0-9]){12}"), "card", CARD), lambda c: c["end"] - c["start"] >= 13),
        when(text.rlike(r"\+[0-9]"), "phone", PHONE),
        when(text.rlike(r"[0-9]{3}[ .-][0-9]{4}"), "phone", LOOSE_PHONE, False),
        when(text.rlike(r"[0-9]-[0-9]{2}-[0-9]{4}"), "ssn", SSN, False),
        when(text.rlike(r"[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4}"), "iban", IBAN, False))


def scan(docs: DataFrame, keep: list[str] = ("doc_id",)) -> DataFrame:
    """(``keep`` columns, _candidates), written once."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return cut_lineage(docs.select(*[F.col(f"`{k}`") for k in keep], candidates(text).alias("_candidates")))


Pattern = tuple[str, int, int, int]


def expectation_maximisation(counts: dict[Pattern, int], rounds: int = 60) -> tuple[dict[Pattern, float], list[dict]]:
    """Probability of each vote pattern, and for each labeler P(vote | truth), by Dawid and Skene's method."""
    def start(pattern: Pattern) -> float:  # the share of yes among the votes; the checksum's counts twice
        votes = [v for v in (pattern[1], *pattern[1:]) if v >= 0]
        return 0.5 + 0.4 * (sum(votes) / len(votes) - 0.5) * 2 if votes else 0.5

    truth = {p: start(p) for p in counts}
    labelers: list[dict] = []
    for _ in range(rounds):
        labelers = [defaultdict(lambda: 1.0) for _ in range(3)]
        prior = defaultdict(lambda: [1.0, 1.0])
        for p, n in counts.items():
            for y, share in ((1, truth[p]), (0, 1 - truth[p])):
                prior[p[0]][y] += n * share
                for j, v in enumerate(p[1:]):
                    labelers[j][v, y] += n * share
        sums = [{y: sum(t[v, y] for v in (-1, 0, 1)) for y in (0, 1)} for t in labelers]
        for p in counts:
            odds = [math.log(prior[p[0]][y]) + sum(math.log(t[v, y] / s[y]) for t, s, v in zip(labelers, sums, p[1:]))
                    for y in (0, 1)]
            truth[p] = 1 / (1 + math.exp(max(-50.0, min(50.0, odds[0] - odds[1]))))
    rates = [{(v, y): t[v, y] / sum(t[u, y] for u in (-1, 0, 1)) for v in (-1, 0, 1) for y in (0, 1)} for t in labelers]
    return truth, rates


def estimate(scanned: DataFrame) -> dict[Pattern, float]:
    """Probabilities of the vote patterns of a scan; at most 27 patterns of a kind reach the driver."""
    each = scanned.select(F.explode("_candidates").alias("c"))
    rows = each.groupBy("c.kind", "c.regex", "c.gazetteer", "c.context").agg(F.count("*").alias("n")).collect()
    counts = {(r["kind"], r["regex"], r["gazetteer"], r["context"]): r["n"] for r in rows}
    return expectation_maximisation(counts)[0] if counts else {}


def _lookup(table: dict, key: Column, default: float) -> Column:
    if not table:
        return F.lit(default)
    pairs = [F.lit(x) for k, v in sorted(table.items()) for x in (k, float(v))]
    return F.coalesce(F.element_at(F.create_map(*pairs), key), F.lit(default))


def _pattern(c: Column) -> Column:
    return F.concat_ws(" ", c["kind"], *[c[v].cast("string") for v in ("regex", "gazetteer", "context")])


def train(scanned: DataFrame, truth: dict[Pattern, float]) -> tuple[float, dict[str, float]]:
    """Intercept and log-odds of each feature, from the candidates weighted by their probabilities."""
    table = {" ".join(map(str, p)): t for p, t in truth.items()}
    each = scanned.select(F.explode("_candidates").alias("c"))
    weighted = each.select(_lookup(table, _pattern(F.col("c")), 0.5).alias("p"), F.explode("c.features").alias("feature"))
    rows = weighted.groupBy("feature").agg(F.sum("p").alias("yes"), F.sum(1 - F.col("p")).alias("no")).collect()
    total = each.select(_lookup(table, _pattern(F.col("c")), 0.5).alias("p")).agg(
        F.sum("p").alias("yes"), F.sum(1 - F.col("p")).alias("no")).first()
    yes, no = (total["yes"] or 0) + 1, (total["no"] or 0) + 1
    weights = {r["feature"]: math.log((r["yes"] + 1) / (yes + 1)) - math.log((r["no"] + 1) / (no + 1)) for r in rows}
    return math.log(yes / no), weights


def find(docs: DataFrame, keep: list[str] = ("doc_id",)) -> DataFrame:
    """(``keep`` columns, spans): array of (start, order, end, kind, base, probability), by start, then kind."""
    scanned = scan(docs, keep)
    truth = estimate(scanned)
    intercept, weights = train(scanned, truth)
    table = {" ".join(map(str, p)): t for p, t in truth.items()}
    order = F.array(*map(F.lit, KINDS))

    def judged(c: Column) -> Column:
        evidence = F.aggregate(c["features"], F.lit(float(intercept)), lambda a, f: a + _lookup(weights, f, 0.0))
        p = 1 / (1 + F.exp(-evidence))
        return F.struct(c["start"].alias("start"), F.array_position(order, c["kind"]).cast("int").alias("order"),
                        c["end"].alias("end"), c["kind"].alias("kind"), c["base"].alias("base"),
                        # the classifier's and the labelers' odds together
                        ((p + _lookup(table, _pattern(c), 0.5)) / 2).alias("probability"))

    rows = scanned.withColumn("_judged", F.transform("_candidates", judged))
    base = F.filter("_judged", lambda c: c["base"])

    def reach(block: Column) -> Column:
        return F.struct(F.array_min(F.transform(block, lambda b: b["start"])).alias("start"),
                        F.array_max(F.transform(block, lambda b: b["end"])).alias("end"), block.alias("spans"))

    def meets(c: Column):
        return lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])

    def added(blocks: Column) -> Column:
        return F.filter("_judged", lambda c: ~c["base"] & (c["probability"] >= 0.5) & ~F.exists(
            blocks, lambda block: meets(c)(block) & F.exists(block["spans"], meets(c))))

    # sorted by their starts, few blocks of base spans reach a candidate
    blocks = let(F.array_sort(base), lambda spans: F.transform(_blocks(spans), lambda block: let(block, reach)))
    found = let(blocks, lambda b: F.array_sort(F.concat(base, added(b))))
    return rows.withColumn("spans", found).drop("_candidates", "_judged")
