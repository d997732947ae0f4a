"""Vector queries, hybrid retrieval and fusion."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from mnemospark.functions import scores as S
from mnemospark.functions import vector as V
from mnemospark.operators import vectors as O
from mnemospark.plans.registry import query
from mnemospark.sources import storage
from mnemospark.sources import tables as T
from mnemospark.sources.tables import ctes


def rows():
    return F.count(F.lit(1))
VEC = ctes("vectors") + ", q AS (SELECT v AS q FROM vectors WHERE id = 0), c AS (SELECT id, label, list_cosine_similarity(v, q) AS s FROM vectors, q)"


def _query(spark, sf, ident: int = 0) -> list[float]:
    return T.vectors(spark, sf).where(F.col("id") == ident).first().v


def _scored(spark, sf):
    q = F.array(*[F.lit(float(x)) for x in _query(spark, sf)])
    return T.vectors(spark, sf).select("id", "label", V.cosine("v", q).alias("s"))


@query("s03_vector_search", VEC + " SELECT id, round(s, 6) AS score FROM c WHERE s >= 0.0 ORDER BY s DESC, id LIMIT 10")
def vector_search(spark, sf):
    return O.nearest(T.vectors(spark, sf), _query(spark, sf), 10, 0.0).select("id", S.rounded("score").alias("score"))


@query("v01_cosine", VEC + " SELECT id, round(s, 6) AS score FROM c")
def cosine(spark, sf):
    return _scored(spark, sf).select("id", S.rounded("s").alias("score"))


@query("v02_shadow_vector", ctes("vectors") + "SELECT id, round(-v[1], 6) AS first, round(-v[64], 6) AS last FROM vectors")
def shadow_vector(spark, sf):
    n = V.negate("v")
    return T.vectors(spark, sf).select("id", S.rounded(n[0]).alias("first"), S.rounded(n[63]).alias("last"))


@query("v03_contradicting", VEC + " SELECT id, round(-s, 6) AS score FROM c WHERE -s >= 0.05 AND id NOT IN (0, 1) ORDER BY -s DESC, id LIMIT 10")
def contradicting(spark, sf):
    hits = O.nearest(T.vectors(spark, sf), [-x for x in _query(spark, sf)], 20, 0.05, exclude=[0, 1])
    return hits.orderBy(F.desc("score"), "id").limit(10).select("id", S.rounded("score").alias("score"))


@query("v04_supporting", VEC + " SELECT id, round(s, 6) AS score FROM c WHERE s >= 0.2 ORDER BY s DESC, id LIMIT 20")
def supporting(spark, sf):
    return O.nearest(T.vectors(spark, sf), _query(spark, sf), 20, 0.2).select("id", S.rounded("score").alias("score"))


@query("v05_evidence", VEC + " SELECT label, round(sum(s * (label + 1) / 10.0), 6) AS weight, round(avg((label + 1) / 10.0), 6) AS mean FROM c WHERE s > 0 GROUP BY label")
def evidence(spark, sf):
    l = (F.col("label") + 1) / 10.0
    return _scored(spark, sf).where("s > 0").groupBy("label").agg(S.rounded(F.sum(F.col("s") * l)).alias("weight"), S.rounded(F.avg(l)).alias("mean"))


@query("v06_credibility", ctes("feedback") + ", g AS (SELECT source, count(*) AS n, sum(success) AS s FROM feedback GROUP BY source), w AS (SELECT source, n, s, s * 1.0 / n AS p FROM g) SELECT source, round((s + 0.5) / (n + 1), 6) AS credibility, round(greatest(0.0, (p + 3.8416 / (2 * n)) / (1 + 3.8416 / n) - 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4.0 * n * n)) / (1 + 3.8416 / n)), 6) AS low, round(least(1.0, (p + 3.8416 / (2 * n)) / (1 + 3.8416 / n) + 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4.0 * n * n)) / (1 + 3.8416 / n)), 6) AS high FROM w")
def credibility(spark, sf):
    g = T.feedback(spark, sf).groupBy("source").agg(rows().alias("n"), F.sum("success").alias("s"))
    low, high = S.wilson("s", "n")
    return g.select("source", S.rounded((F.col("s") + 0.5) / (F.col("n") + 1)).alias("credibility"), S.rounded(low).alias("low"), S.rounded(high).alias("high"))


TERMS = ("the", "tion", "haedtion", "erin")
BM25 = """, t AS (SELECT doc_id, unnest(list_filter(string_split_regex(lower(text), '\\s+'), lambda x: x <> '')) AS w FROM documents), l AS (SELECT doc_id, count(*) AS len FROM t GROUP BY 1), a AS (SELECT avg(len) AS avg_len, count(*) AS n FROM l),
tf AS (SELECT doc_id, w, count(*) AS tf FROM t WHERE w IN ('the', 'tion', 'haedtion', 'erin') GROUP BY 1, 2), df AS (SELECT w, count(*) AS df FROM tf GROUP BY 1),
bm AS (SELECT tf.doc_id AS id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / avg_len))) AS s FROM tf JOIN df USING (w) JOIN l USING (doc_id), a GROUP BY 1)"""


def bm25(docs, terms, k1: float = 1.5, b: float = 0.75):
    """docs(id, text) -> (id, s) of documents with a hit: Okapi BM25 of the query terms, without a shuffle.

    Null texts and texts without words are no documents of the statistics;
    repeated ids are each a document; repeated terms count once.
    """
    terms = list(dict.fromkeys(terms))
    low = docs.select("id", F.lower("text").alias("low"))
    whole = r"(?<!\S)(?:" + "|".join(f"\\Q{t}\\E" for t in terms) + r")(?!\S)"
    counted = low.select("id", F.regexp_count("low", F.lit(r"\S+")).alias("len"), F.regexp_extract_all("low", F.lit(whole), F.lit(0)).alias("hits"))
    times = [(F.size("hits") - F.size(F.array_remove("hits", t))).alias(f"t{i}") for i, t in enumerate(terms)]
    counted = storage.staged(counted.select("id", "len", *times), "terms").where("len > 0")  # the texts are read once
    n, mean, *df = counted.agg(rows(), F.avg("len"), *[F.count_if(F.col(f"t{i}") > 0) for i in range(len(terms))]).first()  # one row
    total = F.lit(0.0)
    for i, d in enumerate(df):
        tf = F.col(f"t{i}")
        total = total + math.log(1 + (n - d + 0.5) / (d + 0.5)) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("len") / (mean or 1.0)))
    return counted.where(F.greatest(*[F.col(f"t{i}") for i in range(len(terms))], F.lit(0)) > 0).select("id", total.alias("s"))


@query("t04_bm25", "WITH x AS (SELECT 1)" + BM25 + " SELECT id, round(s, 6) AS score FROM bm")
def bm25_scores(spark, sf):
    d = T.base(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    return bm25(d, TERMS).select("id", S.rounded("s").alias("score"))


HYBRID = VEC + BM25 + ", d AS (SELECT id, row_number() OVER (ORDER BY round(s, 9) DESC, id) AS rank FROM c QUALIFY rank <= 20), p AS (SELECT id, row_number() OVER (ORDER BY round(s, 9) DESC, id) AS rank FROM bm QUALIFY rank <= 20), r AS (SELECT id, rank FROM d UNION ALL SELECT id, rank FROM p)"


def _ranked(df, k):
    """The k best rows of (id, s) with their rank: a top-k first, so the single-partition window sees k rows.

    Scores are rounded to nine digits, so that equal ones tie whatever the order of their sums.
    """
    from pyspark.sql import Window

    top = df.select("id", S.rounded("s", 9).alias("s")).orderBy(F.desc("s"), "id").limit(k)
    return top.select("id", F.row_number().over(Window.orderBy(F.desc("s"), "id")).alias("rank"))


@query("v07_hybrid_search", HYBRID + " SELECT id, round(sum(1.0 / (60 + rank)), 6) AS score, count(*) / 2.0::DOUBLE AS diversity FROM r GROUP BY id ORDER BY sum(1.0 / (60 + rank)) DESC, id LIMIT 10")
def hybrid_search(spark, sf):
    docs = T.base(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    dense = _ranked(_scored(spark, sf).select("id", "s"), 20)
    sparse = _ranked(bm25(docs, TERMS), 20)
    return O.fused({"dense": dense, "sparse": sparse}, 10).select("id", S.rounded("score").alias("score"), "diversity")


KNN = ctes("vectors") + ", k AS (SELECT a.id AS query, b.id AS id, list_cosine_similarity(a.v, b.v) AS s FROM vectors a JOIN vectors b ON a.id <> b.id WHERE a.id % 20 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY s DESC, id) AS rank FROM k)"


@query("v08_knn", KNN + " SELECT query, id, round(s, 6) AS score, rank FROM r WHERE rank <= 5")
def knn(spark, sf):
    v = T.vectors(spark, sf)
    return O.knn(v, v.where("id % 20 = 0"), 5).select("query", "id", S.rounded("score").alias("score"), F.col("rank").cast("long").alias("rank"))


@query("v09_knn_graph", KNN.replace(" WHERE a.id % 20 = 0", "") + " SELECT DISTINCT least(query, id) AS a, greatest(query, id) AS b FROM r WHERE rank <= 5 AND s >= 0.1")
def knn_graph(spark, sf):
    """The graph of all vectors' nearest, each of them a query."""
    v = T.vectors(spark, sf)
    k = O.knn(v, v, 5, 0.1)
    return k.select(F.least("query", "id").alias("a"), F.greatest("query", "id").alias("b")).distinct()


@query("v09_knn_graph_descent", ctes("vectors") + "SELECT count(*) AS queries, true AS reached FROM vectors WHERE id % 20 = 0")
def knn_graph_descent(spark, sf, k: int = 5, least_recall: float = 0.9):
    """The graph of all vectors' neighbours by descent, measured against brute force on every twentieth; exact where descent falls short."""
    v = T.vectors(spark, sf)
    _, n, found = O.measured_graph(v, v.where("id % 20 = 0"), k, least_recall, small=0)
    return spark.createDataFrame([(n, found >= least_recall)], "queries long, reached boolean")


@query("v10_weighted_recall", VEC + ", e AS (SELECT doc_id AS id, (doc_id * 37 % 101) / 100.0 AS importance FROM documents WHERE contains(lower(text), 'haedtion')), t AS (SELECT id, s FROM c ORDER BY s DESC, id LIMIT 50) SELECT coalesce(t.id, e.id) AS id, round(coalesce(0.7 * s, 0) + coalesce(0.3 * importance, 0), 6) AS score FROM t FULL JOIN e ON t.id = e.id ORDER BY coalesce(0.7 * s, 0) + coalesce(0.3 * importance, 0) DESC, coalesce(t.id, e.id) LIMIT 10")
def weighted_recall(spark, sf):
    dense = _scored(spark, sf).select("id", "s").orderBy(F.desc("s"), "id").limit(50)
    text = T.entities(spark, sf).where(F.contains(F.lower("content"), F.lit("haedtion"))).select("id", "importance")
    s = F.coalesce(F.col("s") * 0.7, F.lit(0.0)) + F.coalesce(F.col("importance") * 0.3, F.lit(0.0))
    return dense.join(text, "id", "full_outer").select("id", s.alias("x")).orderBy(F.desc("x"), "id").limit(10).select("id", S.rounded("x").alias("score"))


@query("v11_recall_by_age", VEC + " SELECT id, round(0.6 * s + 0.2 * exp(-(id % 90) / 30.0) + 0.2 * least(label / 10.0, 1.0), 6) AS score FROM c WHERE 0.6 * s + 0.2 * exp(-(id % 90) / 30.0) + 0.2 * least(label / 10.0, 1.0) >= 0.3")
def recall_by_age(spark, sf):
    x = F.col("s") * 0.6 + F.exp(-(F.col("id") % 90) / 30.0) * 0.2 + F.least(F.col("label") / 10.0, F.lit(1.0)) * 0.2
    return _scored(spark, sf).where(x >= 0.3).select("id", S.rounded(x).alias("score"))


@query("v12_kmeans")
def kmeans(spark, sf):
    return O.kmeans(T.vectors(spark, sf), 10).groupBy("cluster").agg(rows().alias("n"))


def _lloyd_sql(k: int = 10, rounds: int = 5) -> str:
    """Centres p(cluster, c) after some rounds, and what is nearest to each: z(id, cluster)."""
    out = ctes("vectors") + f", c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY id) - 1 AS cluster, v AS c FROM vectors ORDER BY id LIMIT {k})"
    for i in range(rounds + 1):
        out += f", z{i} AS MATERIALIZED (SELECT id, v, cluster FROM vectors, c{i} QUALIFY row_number() OVER (PARTITION BY id ORDER BY round(list_distance(v, c) + 0, 9), cluster) = 1)"
        if i < rounds:
            out += f", s{i} AS (SELECT cluster, list(x ORDER BY i) AS c FROM (SELECT cluster, i, avg(v[i]) AS x FROM (SELECT cluster, v, unnest(range(1, len(v) + 1)) AS i FROM z{i}) GROUP BY 1, 2) GROUP BY 1), c{i + 1} AS MATERIALIZED (SELECT c{i}.cluster AS cluster, coalesce(s{i}.c, c{i}.c) AS c FROM c{i} LEFT JOIN s{i} USING (cluster))"
    return out + f", p AS (SELECT * FROM c{rounds}), z AS (SELECT id, cluster, (id * 37 % 101) / 100.0 AS quality FROM z{rounds}), k AS (SELECT cluster, count(*) AS n, sum(quality) AS total_weight, avg(quality) AS avg_quality FROM z GROUP BY 1 HAVING count(*) >= 5 AND avg(quality) >= 0.3)"


def _prototypes(spark, sf):
    return O.Prototypes(T.vectors(spark, sf).select("id", "v", (F.col("id") * 37 % 101 / 100.0).alias("quality")), 10)


@query("v14_label_clusters", _lloyd_sql() + " SELECT cluster, n, round(total_weight, 6) AS total_weight, round(avg_quality, 6) AS avg_quality FROM k")
def extract_patterns(spark, sf):
    """Clusters of five vectors and more whose mean quality is 0.3 and more."""
    return _prototypes(spark, sf).patterns("quality").select("cluster", "n", S.rounded("total_weight").alias("total_weight"), S.rounded("avg_quality").alias("avg_quality"))


@query("v16_nearest_centroid", ctes("vectors") + ", e AS (SELECT label, i, avg(v[i]) AS x FROM (SELECT label, v, unnest(range(1, 65)) AS i FROM vectors) GROUP BY 1, 2), m AS (SELECT label, list(x ORDER BY i) AS m FROM e GROUP BY 1), d AS (SELECT id, m.label AS centroid, list_dot_product(v, m) AS s FROM vectors, m), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(s, 9) DESC, centroid) AS rn FROM d) SELECT id, centroid FROM r WHERE rn = 1")
def nearest_centroid(spark, sf):
    """Each vector's closest class centroid; the ten centroids are the broadcast side."""
    v = T.vectors(spark, sf)
    x = v.select("label", F.posexplode("v").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("x"))
    m = x.groupBy(F.col("label").alias("centroid")).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("m"))
    allm = m.agg(F.collect_list(F.struct("centroid", "m")).alias("c"))
    best = F.array_max(F.transform("c", lambda s: F.struct(F.round(V.dot("v", s["m"]), 9).alias("s"), (-s["centroid"]).alias("c"))))
    return v.crossJoin(F.broadcast(allm)).select("id", (-best["c"]).alias("centroid"))  # one row: the list of centroids


@query("v17_fuzzy_art")
def fuzzy_art(spark, sf):
    return O.art_categories(T.vectors(spark, sf), "label", vigilance=0.7).groupBy("label", "category").agg(rows().alias("n"))


@query("v18_art_classify")
def art_classify(spark, sf):
    """All vectors by a model trained on all, part by part: how many each category has, and how many match none."""
    v = T.vectors(spark, sf)
    return O.ArtModel(v, 0.75).classify(v).groupBy("category").agg(rows().alias("n"))


@query("v19_fuzzy_match", ctes("vectors") + ", p AS (SELECT id, list_transform(v, lambda x: abs(x)) AS x FROM vectors), w AS (SELECT x AS w FROM p WHERE id = 0) SELECT id, round(list_sum(list_transform(list_zip(x, w), lambda z: least(z[1], z[2]))) / list_sum(x), 6) AS match FROM p, w")
def fuzzy_match(spark, sf):
    w = F.array(*[F.lit(abs(float(x))) for x in _query(spark, sf)])
    x = F.transform("v", lambda y: F.abs(y))
    return T.vectors(spark, sf).select("id", S.rounded(V.fuzzy_match(x, w)).alias("match"))


@query("v20_rerank", VEC + ", t AS (SELECT id, s FROM c ORDER BY s DESC, id LIMIT 40), x AS (SELECT t.id AS id, s + 0.01 * len(regexp_extract_all(lower(text), 'tion')) / (1 + length(text) / 100.0) AS r FROM t JOIN documents ON doc_id = t.id) SELECT id, round(r, 6) AS score FROM x ORDER BY r DESC, id LIMIT 10")
def rerank(spark, sf):
    top = _scored(spark, sf).select("id", "s").orderBy(F.desc("s"), "id").limit(40)
    d = T.base(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    r = F.col("s") + F.regexp_count(F.lower("text"), F.lit("tion")) * 0.01 / (1 + F.length("text") / 100.0)
    return d.join(F.broadcast(top), "id").select("id", r.alias("r")).orderBy(F.desc("r"), "id").limit(10).select("id", S.rounded("r").alias("score"))


@query("v21_two_modalities", ctes("vectors") + ", q AS (SELECT v[1:32] AS a, v[33:64] AS b FROM vectors WHERE id = 0) SELECT id, round(0.6 * list_cosine_similarity(v[1:32], a) + 0.4 * list_cosine_similarity(v[33:64], b), 6) AS score FROM vectors, q")
def two_modalities(spark, sf):
    q = [float(x) for x in _query(spark, sf)]
    a, b = F.array(*map(F.lit, q[:32])), F.array(*map(F.lit, q[32:]))
    s = V.cosine(F.slice("v", 1, 32), a) * 0.6 + V.cosine(F.slice("v", 33, 32), b) * 0.4
    return T.vectors(spark, sf).select("id", S.rounded(s).alias("score"))


@query("v23_semantic_cache", VEC + " SELECT id, round(s, 6) AS score FROM c WHERE s >= 0.15 AND label * 5 < 24 AND id <> 0 ORDER BY s DESC, id LIMIT 1")
def semantic_cache(spark, sf):
    """The nearest cached query within its time to live: 24 hours, an entry being five hours old for each label."""
    hit = _scored(spark, sf).where("s >= 0.15 AND label * 5 < 24 AND id <> 0")
    return hit.orderBy(F.desc("s"), "id").limit(1).select("id", S.rounded("s").alias("score"))


_UNIT = "list_transform({0}, lambda x: (x - list_min({0})) / (list_max({0}) - list_min({0})))"


@query("v24_category_boost", _lloyd_sql() + f", q AS (SELECT v AS q FROM vectors WHERE id = 0), u AS (SELECT id, list_cosine_similarity(v, q) AS s, {_UNIT.format('v')} AS u FROM vectors, q), w AS (SELECT cluster, {_UNIT.format('c')} AS w FROM p JOIN k USING (cluster)), f AS (SELECT id, s, cluster, round(list_sum(list_transform(list_zip(u, w), lambda z: least(z[1], z[2]) + least(1 - z[1], 1 - z[2]))) / len(u), 9) AS match FROM u, w QUALIFY row_number() OVER (PARTITION BY id ORDER BY match DESC, cluster) = 1) SELECT id, cluster AS category, round(match, 6) AS match, round(CASE WHEN match >= 0.8 THEN least(1.0, s * 1.25) ELSE s END, 6) AS score FROM f")
def category_boost(spark, sf, least: float = 0.8):
    """Scores of what matches a learnt pattern well are raised; the usual least match of 0.6 would raise all of these vectors."""
    p = _prototypes(spark, sf)
    kept = [r.cluster for r in p.patterns("quality").select("cluster").collect()]  # ten at most
    q = F.array(*[F.lit(float(x)) for x in _query(spark, sf)])
    scored = T.vectors(spark, sf).select("id", "v", V.cosine("v", q).alias("score"))
    return p.boosted(scored, kept, 1.25, least).select("id", "category", S.rounded("match").alias("match"), S.rounded("score").alias("score"))


@query("v26_graph_enhanced", VEC + ", t AS (SELECT id, s FROM c ORDER BY s DESC, id LIMIT 20), g AS (SELECT l_suppkey % 500 AS id, least(1.0, count(*) / 1000.0) AS g FROM lineitem GROUP BY 1) SELECT t.id AS id, round(0.7 * s + 0.3 * coalesce(g, 0), 6) AS score FROM t LEFT JOIN g USING (id)")
def graph_enhanced(spark, sf):
    top = _scored(spark, sf).select("id", "s").orderBy(F.desc("s"), "id").limit(20)
    g = T.base(spark, sf, "lineitem").groupBy((F.col("l_suppkey") % 500).alias("id")).agg(F.least(F.lit(1.0), rows() / 1000.0).alias("g"))
    return top.join(g, "id", "left").select("id", S.rounded(F.col("s") * 0.7 + F.coalesce("g", F.lit(0.0)) * 0.3).alias("score"))


@query("w04_rank_fusion", HYBRID + " SELECT id, round(sum(1.0 / (60 + rank)), 6) AS score, count(*) / 2.0::DOUBLE AS diversity FROM r GROUP BY id ORDER BY sum(1.0 / (60 + rank)) DESC, id LIMIT 40")
def rank_fusion(spark, sf):
    docs = T.base(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    return O.fused({"dense": _ranked(_scored(spark, sf).select("id", "s"), 20), "sparse": _ranked(bm25(docs, TERMS), 20)}, 40).select("id", S.rounded("score").alias("score"), "diversity")


def _diverse_sql(k: int) -> str:
    out = VEC + ", t AS MATERIALIZED (SELECT c.id AS id, s, v FROM c JOIN vectors USING (id) ORDER BY s DESC, c.id LIMIT 50), m1 AS MATERIALIZED (SELECT id, v FROM t ORDER BY round(0.7 * s, 12) DESC, id LIMIT 1)"
    for i in range(2, k + 1):
        near = ", ".join(f"list_cosine_similarity(v, (SELECT v FROM m{j}))" for j in range(1, i))
        gone = " UNION ALL ".join(f"SELECT id FROM m{j}" for j in range(1, i))
        out += f", m{i} AS MATERIALIZED (SELECT id, v FROM t WHERE id NOT IN ({gone}) ORDER BY round(0.7 * s - 0.3 * greatest({near}), 12) DESC, id LIMIT 1)"
    return out + " " + " UNION ALL ".join(f"SELECT id, {i} AS place FROM m{i}" for i in range(1, k + 1))


@query("k08_diverse_selection", _diverse_sql(10))
def diverse_selection(spark, sf):
    top = _scored(spark, sf).select("id", F.col("s").alias("score")).orderBy(F.desc("score"), "id").limit(50)
    return O.diverse(top.join(T.vectors(spark, sf).select("id", "v"), "id"), 10)


@query("t40_novelty", KNN + ", f AS (SELECT query AS id, 1 - max(s) AS novelty, count(*) FILTER (s > 0.15) AS near FROM k GROUP BY query) SELECT id, round(CASE WHEN near > 3 THEN novelty / 2 ELSE novelty END, 6) AS novelty FROM f")
def novelty(spark, sf):
    """1 - largest similarity, halved with many similar neighbours; the four nearest of each query settle both."""
    v = T.vectors(spark, sf)
    k = O.knn(v, v.where("id % 20 = 0"), 4)
    near = F.count_if(F.col("score") > 0.15)
    n = 1 - F.max("score")
    return k.groupBy(F.col("query").alias("id")).agg(S.rounded(F.when(near > 3, n / 2).otherwise(n)).alias("novelty"))


@query("a42_compare_strategies", VEC + " SELECT CASE WHEN id % 2 = 0 THEN 'late' ELSE 'plain' END AS strategy, round(max(s), 6) AS best FROM c WHERE id <> 0 GROUP BY 1")
def compare_strategies(spark, sf):
    c = _scored(spark, sf).where("id <> 0")
    return c.groupBy(F.when(F.col("id") % 2 == 0, "late").otherwise("plain").alias("strategy")).agg(S.rounded(F.max("s")).alias("best"))


@query("w04_multi_query", VEC + ", q2 AS (SELECT v AS q FROM vectors WHERE id = 20), c2 AS (SELECT id, list_cosine_similarity(v, q) AS s FROM vectors, q2), r AS (SELECT id, row_number() OVER (ORDER BY round(s, 9) DESC, id) AS rank FROM c QUALIFY rank <= 10 UNION ALL SELECT id, row_number() OVER (ORDER BY round(s, 9) DESC, id) AS rank FROM c2 QUALIFY rank <= 10) SELECT id, round(sum(1.0 / (60 + rank)), 6) AS score FROM r GROUP BY id ORDER BY sum(1.0 / (60 + rank)) DESC, id LIMIT 15")
def multi_query(spark, sf):
    v = T.vectors(spark, sf)
    lists = {str(i): _ranked(O.nearest(v, _query(spark, sf, i), 10).withColumnRenamed("score", "s"), 10) for i in (0, 20)}
    return O.fused(lists, 15).select("id", S.rounded("score").alias("score"))
