"""Secret scan with corpus-wide ownership frequency.

1. ``scan`` finds candidates in whole texts: assignments, access keys and long hex strings (the base
   kinds), and other long random-looking tokens (kind ``token``). Texts leave as digests only: a
   candidate carries a hash of its value, never the value.
2. ``ownership`` counts, for each hash, in how many distinct repositories and with how many distinct
   owners it occurs; pairs are folded before the second count, so a value that a third of all rows
   share is no hot spot.
3. ``flag`` joins the counts back: a value with ``COPIED_OWNERS`` owners or more is a widely copied
   example; one with fewer that looks random is a live credential. A ``token`` is a finding only if
   it is live, or if the same value was found as a base kind elsewhere and is not widely copied.

Looking random is judged by alphabet and length: hex strings of 24 characters or more and access keys do
unless they repeat very few characters; other values need a letter, a digit and an entropy that random
characters of their alphabet reach at that length. So random values without any digit are not found.

Spans count code points, end exclusive, and cover the whole match. Letters of the assignment's key
words match in either case (ASCII only).

Defined results: a null text is empty; null owners and repositories count as one owner and one
repository; repeated rows are scanned each, and add nothing to the counts; an empty table gives no
rows; columns of ``docs`` other than the named ones are kept under their own names.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from ..runtime import cut_lineage
from .common import raw_texts

KINDS = ("assign", "access", "hex", "token")
COPIED_OWNERS = 3
TOKEN_CHARS = 20
TOKEN_BITS = 3.5  # most that is asked of the entropy of a value's characters, in bits
SLACK_BITS = 0.8  # a random value has hardly ever less than its alphabet's mean at its length by this
FEW_CHARS = 6  # distinct characters that random hex strings and access keys have
MASK = "[secret]"

_ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I)
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_HEX = re.compile(rb"[0-9a-f]+")
_ANY_HEX = re.compile(rb"[0-9a-f]+|[0-9A-F]+")
_TOKEN = re.compile(rb"[A-Za-z0-9+/_=-]{%d,}" % TOKEN_CHARS)
# cheap exact filters: a text without these holds no match of the kind
_KEYS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
_RUN24, _RUN20 = b"1" * 24, b"1" * TOKEN_CHARS
_HEX_MAP = bytes(49 if chr(c) in "0123456789abcdef" else 48 for c in range(256))
_TOKEN_MAP = bytes(49 if c < 128 and (chr(c).isalnum() or chr(c) in "+/_=-") else 48 for c in range(256))

SPANS = "array<struct<start:bigint,end:bigint,kind:string,hash:string,random:boolean>>"


@lru_cache(1 << 12)
def _least_bits(length: int, alphabet: int) -> float:
    """Least entropy of a value: below what characters drawn at random from the alphabet have in the mean."""
    p, mean, chance = 1 / alphabet, 0.0, (1 - 1 / alphabet) ** length
    for k in range(1, min(length, 128) + 1):  # k times the same character; a random value has no longer share
        chance *= (length - k + 1) / k * p / (1 - p)
        mean -= alphabet * chance * k / length * math.log2(k / length)
    return min(TOKEN_BITS, 0.8 * math.log2(max(2, length)), mean - SLACK_BITS)


def _random(value: bytes) -> bool:
    """Looks drawn at random, judged by alphabet and length.

    Long hex strings and access keys pass unless they repeat very few characters. Other values have
    letters and digits, and characters of high entropy for their length and alphabet.
    """
    if _ACCESS.fullmatch(value) and len(value) >= 20:
        return len(set(value[4:])) >= FEW_CHARS
    digit, letter = any(48 <= c <= 57 for c in value), any(c > 57 for c in value)
    if not digit or not letter:
        return False
    is_hex = _ANY_HEX.fullmatch(value) is not None
    if is_hex and len(value) >= 24:
        return len(set(value)) >= FEW_CHARS
    counts = Counter(value)
    bits = -sum(n / len(value) * math.log2(n / len(value)) for n in counts.values())
    one_case = value in (value.lower(), value.upper())
    alphabet = 16 if is_hex else 64 if not value.isalnum() else 36 if one_case else 62
    return bits >= _least_bits(min(len(value), 1 << 10), alphabet)


def candidates(raw: bytes) -> list[tuple[int, int, str, str, bool]]:
    """(start, end, kind, hash, looks random) in bytes; base kinds and tokens outside them."""
    found = []
    lower = raw.lower()
    if any(k in lower for k in _KEYS):
        found += [(m.start(), m.end(), "assign", m[2]) for m in _ASSIGN.finditer(raw) if len(m[2]) >= 6]
    if b"AKIA" in raw:
        found += [(m.start(), m.end(), "access", m[0]) for m in _ACCESS.finditer(raw) if len(m[0]) >= 20]
    if _RUN20 in (marked := raw.translate(_TOKEN_MAP)):
        if _RUN24 in raw.translate(_HEX_MAP):
            found += _long_runs(raw, raw.translate(_HEX_MAP))
        at = marked.find(_RUN20)
        base = [(s, e) for s, e, _, _ in found]
        while at >= 0:
            stop = marked.find(b"0", at)
            stop = len(raw) if stop < 0 else stop
            value = raw[at:stop]
            if _random(value) and not any(s < stop and at < e for s, e in base):
                found.append((at, stop, "token", value))
            at = marked.find(_RUN20, stop)
    return [(s, e, k, hashlib.sha256(v).hexdigest()[:32], _random(v)) for s, e, k, v in found]


def _long_runs(raw: bytes, marked: bytes) -> list[tuple[int, int, str, bytes]]:
    out, at = [], marked.find(_RUN24)
    while at >= 0:  # a run starts where its first 24 characters start
        stop = marked.find(b"0", at)
        stop = len(raw) if stop < 0 else stop
        out.append((at, stop, "hex", raw[at:stop]))
        at = marked.find(_RUN24, stop)
    return out


def _points(raw: bytes, spans: list) -> list:
    """Byte offsets to code points."""
    if not spans or raw.isascii():
        return spans
    at, count, place = 0, 0, {}
    for offset in sorted({o for s in spans for o in s[:2]}):
        count += len(raw[at:offset].decode("utf-8", "replace"))
        at = offset
        place[offset] = count
    return [(place[s], place[e], *rest) for s, e, *rest in spans]


def scan(docs: DataFrame, owner: str = "source", repository: str = "source", keep: list[str] = ("doc_id",),
         text: bool = False) -> DataFrame:
    """(``keep`` columns, owner, repository, row, candidates), written once; ``text`` keeps the text too.

    ``row`` numbers the rows of the written table.
    """
    kinds = {n: F.col(n).cast("string") for n in {owner, repository}}
    order = {k: i for i, k in enumerate(KINDS)}
    fields = [("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("hash", pa.string()), ("random", pa.bool_())]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for raw in raw_texts(batch.column("_text")):
                spans = _points(raw, sorted(candidates(raw), key=lambda s: (s[0], order[s[2]])))
                rows.append([dict(zip([f for f, _ in fields], s)) for s in spans])
            columns = batch.columns if text else batch.columns[1:]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(rows, pa.list_(pa.struct(fields)))],
                                             names=[*batch.schema.names[0 if text else 1:], "_spans"])

    source = docs.select(F.col("text").cast("string").alias("_text"), *[F.col(f"`{k}`") for k in keep],
                         kinds[owner].alias("_owner"), kinds[repository].alias("_repository"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[0 if text else 1:])
    return cut_lineage(source.mapInArrow(find, f"{schema}, _spans {SPANS}").withColumn("_row", F.monotonically_increasing_id()))


def ownership(scanned: DataFrame) -> DataFrame:
    """(hash, repositories, owners, base): distinct repositories and owners of each candidate value."""
    each = scanned.select("_owner", "_repository", F.explode("_spans").alias("s"))
    pairs = each.groupBy(F.col("s.hash").alias("hash"), "_owner", "_repository").agg(
        F.max(F.col("s.kind") != "token").alias("base"))
    by_owner = pairs.groupBy("hash", "_owner").agg(F.count("*").alias("repositories"), F.max("base").alias("base"))
    return by_owner.groupBy("hash").agg(F.sum("repositories").alias("repositories"), F.count("*").alias("owners"),
                                        F.max("base").alias("base"))


def flag(scanned: DataFrame, copied_owners: int = COPIED_OWNERS) -> DataFrame:
    """The scanned rows with ``findings``: (start, end, kind, owners, repositories, verdict), by start, then kind.

    Verdicts: ``example`` (widely copied), ``live`` (few owners, looks random), ``weak`` (neither).
    """
    each = scanned.select("_row", F.explode("_spans").alias("s")).select("_row", "s.*")
    counted = each.join(ownership(scanned), "hash")
    verdict = (F.when(F.col("owners") >= copied_owners, "example").when(F.col("random"), "live").otherwise("weak"))
    kept = counted.withColumn("verdict", verdict).filter("kind != 'token' or verdict = 'live' or (base and verdict != 'example')")
    order = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    findings = kept.groupBy("_row").agg(F.array_sort(F.collect_list(F.struct(
        "start", order.alias("order"), "end", "kind", "owners", "repositories", "verdict"))).alias("findings"))
    return (scanned.join(findings, "_row", "left")
            .withColumn("findings", F.coalesce("findings", F.array().cast(findings.schema["findings"].dataType))))


def mask(docs: DataFrame, owner: str = "source", repository: str = "source", copied_owners: int = COPIED_OWNERS) -> DataFrame:
    """The documents with their live credentials masked; widely copied examples stay.

    Only texts with findings are changed (and ``n_chars``, where there is such a column); columns and
    their order stay.
    """
    packed = docs.select(F.col("text").cast("string").alias("text"), F.col(owner).cast("string").alias("own"),
                         F.col(repository).cast("string").alias("repo"), F.struct("*").alias("body"))
    scanned = scan(packed, "own", "repo", ["body"])
    # only texts with candidates meet the counts; the others pass by
    flagged = flag(scanned.filter(F.size("_spans") > 0), copied_owners)
    live = F.transform(F.filter("findings", lambda f: f["verdict"] == "live"), lambda f: F.struct(f["start"], f["end"]))
    found = flagged.select("body", live.alias("live"))

    def hide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            body = batch.column("body")
            columns = {f.name: pc.struct_field(body, i) for i, f in enumerate(body.type)}
            spans = batch.column("live").to_pylist()
            text = [masked(t, s) if s else t for t, s in zip(columns["text"].to_pylist(), spans)]
            columns["text"] = pa.array(text, columns["text"].type)
            if "n_chars" in columns:
                kept = columns["n_chars"].to_pylist()
                columns["n_chars"] = pa.array([len(t) if s else n for t, s, n in zip(text, spans, kept)], columns["n_chars"].type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    changed = found.mapInArrow(hide, docs.schema)
    untouched = scanned.filter(F.size("_spans") == 0).select(*[F.col(f"body.`{c}`").alias(c) for c in docs.columns])
    return untouched.unionByName(changed)


def masked(text: str, spans: list[dict]) -> str:
    """The text with spans replaced, in order; of one that begins inside another only the rest goes."""
    out, at = [], 0
    for span in spans:
        if span["end"] <= at:
            continue
        if span["start"] >= at:
            out += [text[at:span["start"]], MASK]
        at = span["end"]
    return "".join([*out, text[at:]])
