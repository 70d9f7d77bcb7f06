import math
import random
import re
import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from shelfmark.llm import kneser_ney as kn, merkle, pii, quality, secret_scan
from shelfmark.llm.queries import QUERIES


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def test_kneser_ney_against_counts_in_memory(spark, docs, odd, none):
    corpus = docs.select("doc_id", "text").limit(120).unionByName(
        odd.selectExpr("doc_id + 100000 AS doc_id", "text").filter("doc_id is null or doc_id != 100009")).cache()
    indexed = kn.index(corpus, 200_000)
    model = kn.fit(indexed, 200_000)
    assert model.shards > 1
    rows = [(r.doc_id, re.findall(r"[^\x20\x09-\x0D]+", lower(r.text or "")) + [0]) for r in corpus.collect()]
    held = {i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in rows}
    train = [t for i, t in rows if not held[i]]
    count = Counter(w for t in train for w in t)
    n, v = sum(count.values()), len(count)
    pairs = Counter(p for t in train for p in zip([1] + t, t))
    total, after, left = Counter(), defaultdict(lambda: [0, 0, 0]), Counter()
    for (a, b), c in pairs.items():
        total[a] += c
        after[a][min(c, 3) - 1] += 1
        left[b] += 1
    high, low = (kn.discounts([sum(c == k for c in x.values()) for k in (1, 2, 3, 4)]) for x in (pairs, left))
    rest = sum(low[min(c, 3) - 1] for c in left.values()) / len(pairs)

    def p(a, b):
        word = max(left[b] - (low[min(left[b], 3) - 1] if left[b] else 0), 0) / len(pairs) + rest / (v + 1)
        if not total[a]:
            return word
        c = pairs[a, b]
        return (max(c - (high[min(c, 3) - 1] if c else 0), 0) + sum(d * m for d, m in zip(high, after[a])) * word) / total[a]

    assert abs(sum(p("the", w) for w in count) + p("the", "unseen word") - 1) < 1e-9
    got = {r.doc_id: r for r in kn.score(indexed, model).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        assert (got[i].held_out, got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (held[i], len(t), sum(w in count for w in t), n)
        assert math.isclose(got[i].base_score, sum(math.log10((count[w] + .5) / (n + .5 * (v + 1))) for w in t), rel_tol=1e-9)
        assert math.isclose(got[i].score, sum(math.log10(p(a, b)) for a, b in zip([1] + t, t)), rel_tol=1e-5)
    empty = kn.index(none)
    assert kn.score(empty, kn.fit(empty)).count() == 0


def test_quality_on_held_out_documents(spark):
    folder = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    rows = QUERIES["op7_compression_classifier"](spark, folder).filter("held_out").join(labels, "doc_id").collect()
    right = sum((r.predicted == 1) == (r.quality == 1) for r in rows) / len(rows)
    assert right >= 0.9 and all(0 <= r.score <= 1 for r in rows)


def test_quality_of_odd_rows(spark, odd, none):
    labelled = spark.createDataFrame([(f"some good words number {k}", 1) for k in range(40)] + [("bad " * k, 0) for k in range(40)]
                                     + [(None, 1), ("x", None), ("y", 7)], "text string, quality int")
    for model in (quality.fit(labelled), quality.fit(labelled.limit(0))):
        rows = quality.score(odd, model).collect()
        assert len(rows) == odd.count() and all(0 <= r.score <= 1 and r._text == "clash" for r in rows)
    assert quality.keep_good(odd, quality.fit(labelled), 0.0).columns == odd.columns
    assert quality.keep_good(none, quality.fit(labelled), 0.3).count() == 0


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_spans(text):
    out = []
    for order, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            luhn = sum(int(c) if i % 2 == 0 else int(c) * 2 - (9 if int(c) > 4 else 0) for i, c in enumerate(d[::-1])) % 10 == 0
            if {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m[0].split(".")),
                    "card": 14 <= len(d) <= 19 and luhn, "phone": 10 <= len(d) <= 15}[kind]:
                out.append((m.start(), order + 1, m.end(), kind))
    return sorted(out)


def test_pii_base_spans_against_python(spark, odd, none):
    rng = random.Random(1)
    parts = ["a", "b.c", "@", "é", "1", "22", "255", "256", ".", " ", "-", "+", "(", ")", "0004", "_", "%", "x@y.z", "\n", "tel ",
             "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 555-1234", "10.0.0.1", "555-123-4567", "123-45-6789"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(40))) for _ in range(400)]
    texts += ["", None, "1" * 5000, "a" * 20000 + "@", "a.b@" + ".".join(["x"] * 5000), "1 " * 5000, "+" + "1" * 9000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for r in pii.find(docs).collect():
        assert [(s.start, s.order, s.end, s.kind) for s in r.spans if s.base] == base_spans(texts[r.doc_id] or "")
        base = [s for s in r.spans if s.base]
        assert not any(b.start < s.end and s.start < b.end for s in r.spans if not s.base for b in base)
    assert pii.find(odd).count() == odd.count() and pii.find(none).count() == 0


def test_expectation_maximisation_finds_the_reliable_labelers():
    rng, counts = random.Random(4), Counter()
    for _ in range(5000):
        truth = rng.random() < 0.6
        counts["phone", *(int(truth) if rng.random() < rate else int(not truth) for rate in (0.95, 0.9, 0.6))] += 1
    probability, rates = pii.expectation_maximisation(counts)
    assert probability["phone", 1, 1, 0] > 0.9 > 0.1 > probability["phone", 0, 0, 1]
    assert rates[0][1, 1] > rates[1][1, 1] - 0.05 > rates[2][1, 1]


SECRETS = {"assign": r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
           "access": r"AKIA[A-Z0-9]+", "hex": r"[0-9a-f]+"}


def test_secret_spans_against_python(spark):
    rng = random.Random(6)
    parts = ["password", "PassWD", "api_key", "apikey", "token", "ſecret", "é", "=", ":", " ", '"', "'", "abc.def", "12345", "123456",
             "AKIA", "ABCDEFGHIJ", "0123456789", "deadbeefdeadbeef", "cafe", "/+", "\n", "G"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(30))) for _ in range(600)] + ["", None]
    docs = spark.createDataFrame([(i, t, f"s{i % 9}") for i, t in enumerate(texts)], "doc_id bigint, text string, source string")
    for r in secret_scan.flag(secret_scan.scan(docs)).collect():
        want = []
        for order, (kind, pattern) in enumerate(SECRETS.items()):
            for m in re.finditer(pattern, texts[r.doc_id] or "", re.ASCII | (re.I if kind == "assign" else 0)):
                size = len(m[2]) if kind == "assign" else len(m[0])
                if size >= {"assign": 6, "access": 20, "hex": 24}[kind]:
                    want.append((m.start(), order, m.end(), kind))
        assert [(f.start, f.end, f.kind) for f in r.findings if f.kind != "token"] == [(s, e, k) for s, _, e, k in sorted(want)]


def test_ownership_parts_copied_and_live(spark, odd, none):
    key, live = "9f8e7d6c5b4a39281706f5e4d3c2b1a0ffeeddcc", "Zx81kQpLm3Tr55vBnW02"
    rows = [(i, f'é password="{key}" {"x" * i}', f"owner{i % 4}", 60) for i in range(40)] + [(99, f"see {live} and token={live}", "o", 48)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, n_chars bigint")
    found = {r.doc_id: r.findings for r in secret_scan.flag(secret_scan.scan(docs)).collect()}
    assert {f.verdict for i in range(40) for f in found[i]} == {"example"} and found[0][0].owners == 4
    assert [(f.kind, f.verdict) for f in found[99]] == [("token", "live"), ("assign", "live")]
    masked = {r.doc_id: r for r in secret_scan.mask(docs).collect()}
    assert masked[3].text == rows[3][1] and masked[99].text == "see [secret] and [secret]" and masked[99].n_chars == 25
    odd_rows = secret_scan.mask(odd)
    assert odd_rows.columns == odd.columns and odd_rows.count() == odd.count()
    assert odd_rows.filter("text like '[secret]%'").first().findings == "clash"
    assert secret_scan.mask(none).count() == 0


def test_merkle_trees(spark, odd, none):
    text = "One. Two words.\nThird line\n\nSection two. " + "long " * 40
    pairs = spark.createDataFrame([(text, text), (text, text.replace("Third", "3rd")), (text, text + "\n\nnew"), ("", None)],
                                  "a string, b string")
    rows = pairs.select(merkle.edits(merkle.tree(F.col("a")), merkle.tree(F.col("b"))).alias("e"),
                        (merkle.root(F.col("a")) == merkle.root(F.col("b"))).alias("same"),
                        merkle.likeness(merkle.leaves(F.col("a")), merkle.leaves(F.col("b"))).alias("near")).collect()
    assert [[tuple(x) for x in r.e] for r in rows] == [[], [(0, 1)], [(2, 0)], []]
    assert [r.same for r in rows] == [True, False, False, True] and rows[0].near == 1 and 0.5 < rows[1].near < 1
    assert merkle.fingerprint(odd).count() == odd.count()
    plain = odd.filter("doc_id != 9").select("doc_id", "text")
    ordered = [r.text or "" for r in plain.orderBy("doc_id").collect()]
    for bucket_bytes in (1, 1 << 25):
        got = merkle.with_next(plain, bucket_bytes).orderBy("doc_id").collect()
        assert [(r.text, r.next_text) for r in got] == list(zip(ordered, ordered[1:] + ordered[:1]))
    assert merkle.with_next(odd).count() == odd.count() and merkle.with_next(none).count() == 0
