from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clusters as CL, neighbours as N, vectors as V
from .registry import query

RAW_SQL = """raw AS (SELECT vec_id, list_transform(embedding, lambda x: CASE WHEN vec_id % 11 = 0 THEN 0.0::DOUBLE
  ELSE x::DOUBLE * (vec_id % 7 + 1) END) AS v FROM embeddings)"""


def _vectors(t):
    return t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")


def _long(df, key):
    return (df.select(key, F.posexplode("vec").alias("pos", "value"))
            .select(key, F.col("pos").cast("bigint").alias("pos"), (F.round("value", 6) + F.lit(0.0)).alias("value")))


@query("l2_normalize", f"""WITH {RAW_SQL}, n AS (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS l FROM raw)
  SELECT vec_id, unnest(range(len(v))) AS pos, unnest(list_transform(v, lambda x: round(CASE WHEN l > 0 THEN x / l ELSE x END, 6) + 0.0)) AS value FROM n""")
def l2_normalize(t):
    scaled = t.embeddings.select("vec_id", F.transform("embedding", lambda x: F.when(
        F.col("vec_id") % 11 == 0, F.lit(0.0)).otherwise(x.cast("double") * (F.col("vec_id") % 7 + 1))).alias("vec"))
    return _long(V.l2_normalize(scaled), "vec_id")


MEANS_SQL = """wide AS (SELECT label, unnest(range(len(embedding))) AS pos, unnest(embedding)::DOUBLE AS x FROM embeddings),
means AS (SELECT label, pos, avg(x) AS m FROM wide GROUP BY label, pos),
centroids AS (SELECT label AS cluster, list(m ORDER BY pos) AS c FROM means GROUP BY label)"""


def _label_means(t):
    return V.kmeans_update(_vectors(t).select(F.col("label").alias("cluster"), "vec"))


@query("kmeans_update", f"WITH {MEANS_SQL} SELECT label AS cluster, pos, round(m, 6) + 0.0 AS value FROM means")
def kmeans_update(t):
    return _long(_label_means(t), "cluster")


@query("kmeans_assign", f"""WITH {MEANS_SQL}, d AS (SELECT vec_id AS id, cluster,
    list_distance(embedding::DOUBLE[], c) AS dist FROM embeddings, centroids)
  SELECT id, cluster, round(dist, 6) AS distance FROM d QUALIFY row_number() OVER (PARTITION BY id ORDER BY round(dist, 12), cluster) = 1""")
def kmeans_assign(t):
    return V.kmeans_assign(_vectors(t), _label_means(t)).select("id", "cluster", F.round("distance", 6).alias("distance"))


@query("topk_inner_product", """WITH p AS (SELECT q.vec_id AS query_id, b.vec_id AS id,
    round(list_dot_product(q.embedding::DOUBLE[], b.embedding::DOUBLE[]), 12) AS s FROM embeddings q, embeddings b)
  SELECT query_id, id, round(s, 6) AS score, row_number() OVER w AS rank FROM p
  WINDOW w AS (PARTITION BY query_id ORDER BY s DESC, id) QUALIFY row_number() OVER w <= 3""")
def topk_inner_product(t):
    vectors = _vectors(t)
    found = V.topk_ip(vectors.select(F.col("id").alias("query_id"), "vec"), vectors)
    return found.select("query_id", "id", F.round("score", 6).alias("score"), "rank")


DBSCAN_EPS, DBSCAN_POINTS = 0.7, 3


def _points_with_copies(t):
    vectors = _vectors(t)
    copies = vectors.filter("label < 5").withColumn("id", F.col("id") + 1000000)
    return vectors.unionByName(copies).select("id", "vec")


@query("dbscan_labels", f"""WITH RECURSIVE pts AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings
    UNION ALL SELECT vec_id + 1000000, embedding::DOUBLE[] FROM embeddings WHERE label < 5),
  near AS (SELECT a.id AS a, b.id AS b FROM pts a, pts b WHERE list_cosine_distance(a.v, b.v) <= {DBSCAN_EPS} + 1e-12),
  core AS (SELECT a AS id FROM near GROUP BY a HAVING count(*) >= {DBSCAN_POINTS}),
  link AS (SELECT a, b FROM near WHERE a IN (SELECT id FROM core) AND b IN (SELECT id FROM core)),
  reach AS (SELECT id AS a, id AS b FROM core UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
  comp AS (SELECT a AS id, min(b) AS root FROM reach GROUP BY a),
  num AS (SELECT id, dense_rank() OVER (ORDER BY root) - 1 AS n FROM comp),
  edge AS (SELECT a AS id, min(n) AS n FROM near JOIN num ON near.b = num.id WHERE a NOT IN (SELECT id FROM core) GROUP BY a)
  SELECT p.id, CASE WHEN coalesce(num.n, edge.n) IS NULL THEN 'misc'
    ELSE concat('cluster_', CAST(coalesce(num.n, edge.n) AS VARCHAR)) END AS cluster
  FROM pts p LEFT JOIN num ON p.id = num.id LEFT JOIN edge ON p.id = edge.id""")
def dbscan_labels(t):
    return N.dbscan(_points_with_copies(t), DBSCAN_EPS, DBSCAN_POINTS)


@query("kmeans_labels")
def kmeans_labels(t):
    return CL.kmeans_labels(_vectors(t).select("id", "vec"), auto=False)


@query("elbow_curve")
def elbow_curve(t):
    return CL.elbow_curve(_vectors(t).select("id", "vec"))


# curves of eleven points, k = 2..12, over all customers
@query("elbow_pick", """WITH curve AS (SELECT c_custkey // 11 AS grp, c_custkey % 11 + 2 AS k, c_acctbal::DOUBLE AS inertia FROM customer),
  bends AS (SELECT *, lead(inertia) OVER w - 2 * inertia + lag(inertia) OVER w AS bend, count(*) OVER (PARTITION BY grp) AS n
    FROM curve WINDOW w AS (PARTITION BY grp ORDER BY k))
  SELECT grp, k FROM bends WHERE bend IS NOT NULL OR n < 3
  QUALIFY row_number() OVER (PARTITION BY grp ORDER BY bend DESC NULLS LAST, k) = 1""")
def elbow_pick(t):
    curve = t.customer.select(F.floor(F.col("c_custkey") / 11).alias("grp"), (F.col("c_custkey") % 11 + 2).alias("k"),
                              F.col("c_acctbal").cast("double").alias("inertia"))
    return CL.elbow_pick(curve, ["grp"])


@query("embed_text", """SELECT doc_id, CAST(384 AS INTEGER) AS dims, CASE WHEN regexp_matches(text, '[\\p{L}\\p{N}_]') THEN 1.0::DOUBLE
  ELSE 0.0::DOUBLE END AS length FROM documents""")
def embed_text(t):
    """Length of each vector and its number of entries: one row per document."""
    embedded = V.embed_text(t.documents.select("doc_id", "text"))
    length = F.aggregate("vec", F.lit(0.0), lambda acc, x: acc + x * x)
    return embedded.select("doc_id", F.size("vec").alias("dims"), F.round(F.sqrt(length), 6).alias("length"))


@query("cluster")
def cluster(t):
    return CL.cluster(_vectors(t).select("id", "vec"), "kmeans")
