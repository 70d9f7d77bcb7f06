"""The registered queries of the operators in this folder, and their SQL where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..runtime import cut_lineage, scratch_path
from . import (alignment, centroids, concat_cut, decontaminate, edit_counts, kneser_ney, merkle, packing, pii, quality,
               secret_scan, simhash, token_files)

Query = Callable[[SparkSession, str], DataFrame]
QUALITY_THRESHOLD = 0.3
QUALITY_FOLDS = 5
CENTROIDS, CENTROID_ROUNDS, DIMS = 8, 10, 64


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def id_remainder(folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``."""
    return F.pmod(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")), F.lit(folds))


def joined_spans(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _count(spans: Column, value: str, field: str = "kind") -> Column:
    return F.size(F.filter(spans, lambda s: s[field] == value)).cast("bigint")


def op1_simhash_vp_trees(spark: SparkSession, folder: str) -> DataFrame:
    grouped = simhash.group(table(spark, folder, "documents"))
    return grouped.select("doc_id", simhash.hex_fingerprint("fp").alias("fingerprint"), "component_id")


def op2_suffix_array_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = decontaminate.judge(decontaminate.find_matches(docs, table(spark, folder, "benchmark")))
    longest = F.coalesce(F.array_max(F.transform("matches", lambda m: m["n_words"])), F.lit(0)).cast("bigint")
    return found.select("doc_id", "n_words", F.col("n_hit").cast("bigint").alias("n_hit"), "n_items", "items_sha256",
                        "contaminated", longest.alias("longest_match"))


def op3_secret_ownership(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").withColumn("repository", F.concat_ws("/", "source", "lang"))
    flagged = secret_scan.flag(secret_scan.scan(docs, owner="source", repository="repository"))
    base = F.filter("findings", lambda f: f["kind"] != "token")
    verdicts = [_count(F.col("findings"), v, "verdict").alias(f"n_{v}") for v in ("live", "example", "weak")]
    return flagged.select("doc_id", *[_count(base, k).alias(f"n_{k}") for k in ("assign", "access", "hex")],
                          F.sha2(joined_spans(base), 256).alias("base_sha256"),
                          joined_spans(F.col("findings")).alias("spans"), *verdicts)


def op4_kneser_ney(spark: SparkSession, folder: str) -> DataFrame:
    indexed = kneser_ney.index(table(spark, folder, "documents"))
    return kneser_ney.score(indexed, kneser_ney.fit(indexed))


def op5_merkle_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    pairs = merkle.with_next(table(spark, folder, "documents"))
    both = pairs.withColumn("edited", merkle.half_replaced(F.col("text"), F.col("next_text")))
    hashed = both.select(
        "doc_id", F.length("text").cast("bigint").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        merkle.root(F.col("text")).alias("fingerprint"), merkle.root(F.col("edited")).alias("edited_fingerprint"),
        *[merkle.leaves(F.col(c)).alias(f"_{c}") for c in ("text", "edited", "next_text")])
    return hashed.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
                         merkle.likeness(F.col("_text"), F.col("_edited")).alias("near_edited"),
                         merkle.likeness(F.col("_text"), F.col("_next_text")).alias("near_next"))


def op6_token_id_files(spark: SparkSession, folder: str) -> DataFrame:
    manifest = token_files.write(table(spark, folder, "documents"), scratch_path(spark, "token-ids"))
    return token_files.read_documents(manifest)


def op7_compression_classifier(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    scored = quality.score(docs, quality_model(spark, docs, folder))
    return scored.select("doc_id", F.coalesce(id_remainder(QUALITY_FOLDS) == 0, F.lit(False)).alias("held_out"), "score",
                         (F.col("score") >= QUALITY_THRESHOLD).cast("int").alias("predicted"))


def quality_model(spark: SparkSession, docs: DataFrame, folder: str) -> quality.Model:
    """Fitted to the labels of documents outside the held-out fold."""
    labels = table(spark, folder, "labels").filter(id_remainder(QUALITY_FOLDS) != 0)
    labelled, prior = quality.draw(docs, labels)
    return quality.fit(labelled, prior=prior)


def op8_pii_weak_supervision(spark: SparkSession, folder: str) -> DataFrame:
    found = pii.find(table(spark, folder, "documents"))
    base = F.filter("spans", lambda s: s["base"])
    return found.select("doc_id", *[_count(base, k).alias(f"n_{k}") for k in pii.BASE],
                        F.sha2(joined_spans(base), 256).alias("base_sha256"), joined_spans(F.col("spans")).alias("spans"))


def op9_edit_aware_counts(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "source")
    edited = edit_counts.count_edits(edit_counts.sample_edits(docs))
    return edited.select("doc_id", F.col("n_before").alias("n_tokens"), F.col("n_tokens").alias("n_tokens_edited"),
                         F.col("n_encoded").alias("n_runs_encoded"), F.size("leaf_chars").cast("bigint").alias("n_leaves"))


def op10_large_item_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"))


def op11_pair_bitmaps(spark: SparkSession, folder: str) -> DataFrame:
    scored, _ = alignment.align(table(spark, folder, "documents"))
    return scored


def op12_rotated_centroids(spark: SparkSession, folder: str) -> DataFrame:
    key = F.sha2(F.concat(F.lit("3:"), F.col("vec_id").cast("string")), 256)
    assigned, found = centroids.cluster(table(spark, folder, "embeddings"), CENTROIDS, CENTROID_ROUNDS, DIMS, key)
    return centroids.with_totals(cut_lineage(assigned), found).select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op13_concatenate_and_cut(spark: SparkSession, folder: str) -> DataFrame:
    packed = concat_cut.pack(table(spark, folder, "documents"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


QUERIES: dict[str, Query] = {f.__name__: f for f in (
    op1_simhash_vp_trees, op2_suffix_array_decontamination, op3_secret_ownership, op4_kneser_ney, op5_merkle_fingerprints,
    op6_token_id_files, op7_compression_classifier, op8_pii_weak_supervision, op9_edit_aware_counts, op10_large_item_packing,
    op11_pair_bitmaps, op12_rotated_centroids, op13_concatenate_and_cut)}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "regexp_extract_all(" + _LOWER.format("coalesce(text, '')") + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_LEAF = "substr(sha256({}), 1, 32)"


def _leaves_sql(text: str) -> str:
    runs = (f"list_transform(range(0, len(string_split(q, ' ')), {merkle.RUN}), lambda k: "
            + _LEAF.format(f"array_to_string(string_split(q, ' ')[k + 1:k + {merkle.RUN}], ' ')") + ")")
    sentences = f"flatten(list_transform(string_split({text}, chr(10)), lambda p: string_split(p, '. ')))"
    return f"list_distinct(flatten(list_transform({sentences}, lambda q: {runs})))"


def _root_sql(text: str) -> str:
    section = _LEAF.format("array_to_string(list_transform(string_split(s, chr(10)), lambda p: " + _LEAF.format("p") + "), chr(10))")
    return _LEAF.format(f"array_to_string(list_transform(string_split({text}, chr(10) || chr(10)), lambda s: {section}), chr(10) || chr(10))")


def _centroids_sql() -> str:
    """The rounds of op12 one after another."""
    gap = "list_sum(list_transform(range(1, 65), lambda i: (v.q[i] - c.q[i]) * (v.q[i] - c.q[i])))"
    steps = [f"""WITH v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id,
       list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
     FROM embeddings WHERE len(embedding) = {DIMS}
       AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIMS}),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS c, q FROM v
     WHERE vec_id IS NOT NULL ORDER BY sha256('3:' || vec_id) LIMIT {CENTROIDS})"""]
    for k in range(CENTROID_ROUNDS + 1):
        steps.append(f"""a{k} AS MATERIALIZED (SELECT v.r, arg_min(c.c, ({gap}, c.c)) AS c, min({gap}) AS d FROM v, c{k} c GROUP BY v.r)""")
        if k < CENTROID_ROUNDS:
            steps.append(f"""c{k + 1} AS MATERIALIZED (SELECT o.c, coalesce(n.q, o.q) AS q FROM c{k} o LEFT JOIN (
       SELECT c, list(m ORDER BY i) AS q FROM (SELECT a.c, i, CAST(floor(sum(v.q[i]) / count(*)) AS BIGINT) AS m
         FROM a{k} a JOIN v USING (r), range(1, {DIMS + 1}) t(i) GROUP BY a.c, i) s GROUP BY c) n USING (c))""")
    last = f"a{CENTROID_ROUNDS}"
    return ",\n".join(steps) + f"""
SELECT v.vec_id, CAST(a.c AS INTEGER) AS cluster, CAST(a.d AS BIGINT) AS distance,
       CAST(sum(a.d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(a.d) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(c.q, ',')) AS centroid_sha256
FROM v JOIN {last} a USING (r) JOIN c{CENTROID_ROUNDS} c ON c.c = a.c"""


SQL: dict[str, str] = {
    "op12_rotated_centroids": _centroids_sql(),
    "op2_suffix_array_decontamination": f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, w, least(len(w), 13) AS k FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) t WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS g
            FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM b) t),
sizes AS (SELECT DISTINCT k FROM windows),
places AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS g
           FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, sizes WHERE len(w) >= k) t),
found AS (SELECT doc_id, item_id, i, k FROM places JOIN windows USING (k, g)),
hit AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(range(i, i + k)) AS p FROM found) t GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n, string_agg(x, ',' ORDER BY x) AS names
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM found) t GROUP BY doc_id),
steps AS (SELECT doc_id, item_id, i, k, j FROM found JOIN (SELECT item_id, k, array_to_string(w[j:j + k - 1], ' ') AS g, j
            FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS j FROM b) t) q USING (item_id, k)
          JOIN places p USING (doc_id, k, i) WHERE p.g = q.g),
matches AS (SELECT doc_id, max(i) - min(i) + max(k) AS n
            FROM (SELECT doc_id, item_id, i, k, i - j AS diagonal,
                         i - row_number() OVER (PARTITION BY doc_id, item_id, i - j ORDER BY i) AS island FROM steps) t
            GROUP BY doc_id, item_id, diagonal, island),
longest AS (SELECT doc_id, max(n) AS n FROM matches GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(hit.n, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(items.n, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
       coalesce(hit.n, 0) > 0 AND 20 * coalesce(hit.n, 0) >= len(w) AS contaminated,
       CAST(coalesce(longest.n, 0) AS BIGINT) AS longest_match
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id) LEFT JOIN longest USING (doc_id)""",
    "op5_merkle_fingerprints": f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS a FROM documents),
n AS (SELECT doc_id, a, coalesce(lead(a) OVER (ORDER BY doc_id), first_value(a) OVER (ORDER BY doc_id)) AS b FROM t),
e AS (SELECT doc_id, a, b, CAST(length(a) AS BIGINT) AS n,
             substr(a, 1, length(a) - length(a) // 2) || substr(b, 1, length(a) // 2) AS x FROM n),
l AS (SELECT doc_id, n, sha256(x) AS edited_sha256, {_root_sql("a")} AS fingerprint, {_root_sql("x")} AS edited_fingerprint,
             {_leaves_sql("a")} AS la, {_leaves_sql("x")} AS lx, {_leaves_sql("b")} AS lb FROM e)
SELECT doc_id, n AS n_chars, edited_sha256, fingerprint, edited_fingerprint,
       len(list_intersect(la, lx)) / CAST(len(la) + len(lx) - len(list_intersect(la, lx)) AS DOUBLE) AS near_edited,
       len(list_intersect(la, lb)) / CAST(len(la) + len(lb) - len(list_intersect(la, lb)) AS DOUBLE) AS near_next
FROM l""",
}
