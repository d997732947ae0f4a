"""Stores, codecs, links, conflicts and chunk retrieval of the memory engine."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from mnemospark.functions import scores as S
from mnemospark.functions import text as X
from mnemospark.functions import vector as V
from mnemospark.operators import chunking as C
from mnemospark.operators import cycles
from mnemospark.operators import graph as G
from mnemospark.operators import near_texts as N
from mnemospark.operators import vectors as O
from mnemospark.operators.topk import ranked
from mnemospark.plans.registry import query
from mnemospark.sources import storage
from mnemospark.sources import tables as T
from mnemospark.sources.tables import ctes


def rows():
    return F.count(F.lit(1))


def _folder(spark) -> str:
    return storage.new_path(spark, "files")


@query("s04_traverse", ctes("causal_links", recursive=True) + ", u AS (SELECT cause_id AS a, effect_id AS b FROM causal_links WHERE strength >= 0.6 UNION SELECT effect_id, cause_id FROM causal_links WHERE strength >= 0.6), r(id, distance) AS (SELECT 5::BIGINT, 0 UNION SELECT b, distance + 1 FROM r JOIN u ON a = id WHERE distance < 2), m AS (SELECT id, min(distance) AS distance FROM r GROUP BY id) SELECT id, distance FROM m WHERE distance > 0 ORDER BY distance, id LIMIT 20")
def traverse(spark, sf):
    e = T.causal_links(spark, sf).where("strength >= 0.6").select(F.col("cause_id").alias("a"), F.col("effect_id").alias("b"))
    r = G.reach(G.both_ways(e), spark.createDataFrame([(5,)], "seed long"), 2)
    return r.where("depth > 0").select("id", F.col("depth").alias("distance")).orderBy("distance", "id").limit(20)


@query("s05_key_scan", ctes("actions") + "SELECT context, max(executed_at) AS last, count(*) AS writes FROM actions WHERE context LIKE 'k1%' GROUP BY 1 ORDER BY writes DESC, context LIMIT 50")
def key_scan(spark, sf):
    a = T.actions(spark, sf).where(F.startswith("context", F.lit("k1")))
    return a.groupBy("context").agg(F.max("executed_at").alias("last"), rows().alias("writes")).orderBy(F.desc("writes"), "context").limit(50)


@query("s09_metrics_log", ctes("actions") + "SELECT action_type, count(*) AS n, round(avg(CASE WHEN success_score >= 0.5 THEN 1.0 ELSE 0.0 END), 6) AS promotion_rate FROM actions GROUP BY 1")
def metrics_log(spark, sf):
    """Metrics appended as JSON lines, read back with an explicit schema and summed up."""
    path = _folder(spark)
    storage.append_json_lines(T.actions(spark, sf).select("action_id", "action_type", "success_score"), path)
    log = storage.read_json_lines(spark, path, "action_id long, action_type string, success_score double")
    return log.groupBy("action_type").agg(rows().alias("n"), S.rounded(F.avg(F.when(F.col("success_score") >= 0.5, 1.0).otherwise(0.0))).alias("promotion_rate"))


@query("s11_import_agent", ctes("entities") + ", x AS (SELECT * FROM entities ORDER BY created_at DESC, id LIMIT 100) SELECT CASE WHEN id % 3 = 0 THEN 'skipped' ELSE 'imported' END AS status, count(*) AS n FROM x GROUP BY 1")
def import_agent(spark, sf):
    """Exports the newest entities, gzipped, and imports them where the name is unknown."""
    e = T.entities(spark, sf).select("id", "name", "entity_type", "tier", "created_at")
    path = _folder(spark)
    storage.export_agent(e, path, most=100)
    got = storage.import_agent(spark, path, "id long, name string, entity_type string, tier string", e.where("id % 3 = 0").select("name"))
    return got.groupBy("status").agg(rows().alias("n"))


@query("s13_payload_codec", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, 'json' AS kind FROM events WHERE props LIKE '{%' UNION ALL SELECT event_id, NULL, 'text' FROM events WHERE props NOT LIKE '{%'")
def payload_codec(spark, sf):
    """Payloads are JSON where they parse, else text."""
    e = T.base(spark, sf, "events").withColumn("p", F.from_json("props", "k long"))
    return e.select("event_id", "p.k", F.when(F.startswith("props", F.lit("{")), "json").otherwise("text").alias("kind"))


@query("s19_sparse_vectors", "WITH w AS (SELECT conv_id, unnest(list_filter(string_split_regex(lower(text), '\\s+'), lambda x: x <> '')) AS w FROM conversations), t AS (SELECT conv_id, CAST('0x' || substr(md5(w), 1, 4) AS INTEGER) AS i, count(*) AS tf FROM w GROUP BY 1, 2) SELECT conv_id, count(*) AS dimensions, CAST(sum(tf) AS BIGINT) AS terms, CAST(sum(i * tf) AS BIGINT) AS checksum FROM t GROUP BY 1")
def sparse_vectors(spark, sf):
    i = F.conv(F.substring(F.md5("w"), 1, 4), 16, 10).cast("long")
    w = T.base(spark, sf, "conversations").select("conv_id", F.explode(X.words("text")).alias("w"))
    t = w.groupBy("conv_id", i.alias("i")).agg(rows().alias("tf"))
    return t.groupBy("conv_id").agg(rows().alias("dimensions"), F.sum("tf").alias("terms"), F.sum(F.col("i") * F.col("tf")).alias("checksum"))


@query("s22_hash_embedding", "WITH w AS (SELECT conv_id, turn, unnest(list_filter(string_split_regex(lower(text), '\\s+'), lambda x: x <> '')) AS w FROM conversations), t AS (SELECT conv_id, turn, CAST('0x' || substr(md5(w), 1, 4) AS INTEGER) % 16 AS d, sum(CASE WHEN CAST('0x' || substr(md5(w), 5, 2) AS INTEGER) < 128 THEN 1 ELSE -1 END) AS v FROM w GROUP BY 1, 2, 3), n AS (SELECT conv_id, turn, sqrt(sum(v * v)) AS n FROM t GROUP BY 1, 2) SELECT conv_id, turn, CAST(d AS BIGINT) AS d, round(v / n, 6) AS value FROM t JOIN n USING (conv_id, turn) WHERE v <> 0")
def hash_embedding(spark, sf, dimensions: int = 16):
    """A deterministic offline embedder: signed feature hashing of words, normalised."""
    d = F.conv(F.substring(F.md5("w"), 1, 4), 16, 10).cast("long") % dimensions
    sign = F.when(F.conv(F.substring(F.md5("w"), 5, 2), 16, 10).cast("long") < 128, 1).otherwise(-1)
    w = T.base(spark, sf, "conversations").select("conv_id", "turn", F.explode(X.words("text")).alias("w"))
    t = w.groupBy("conv_id", "turn", d.alias("d")).agg(F.sum(sign).alias("v"))
    n = t.groupBy("conv_id", "turn").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("n"))
    return t.where("v <> 0").join(n, ["conv_id", "turn"]).select("conv_id", "turn", "d", S.rounded(F.col("v") / F.col("n")).alias("value"))


@query("m05_causal_upsert", ctes("causal_links", recursive=True) + ", e AS (SELECT * FROM causal_links WHERE strength >= 0.8), r(seed, id, depth) AS (SELECT DISTINCT (k * 7 + 3) % 100, (k * 7 + 3) % 100, 0 FROM actions UNION SELECT seed, effect_id, depth + 1 FROM r JOIN e ON cause_id = id WHERE depth < 10), w AS (SELECT DISTINCT seed, id FROM r), n AS (SELECT k AS a, (k * 7 + 3) % 100 AS b, round(max(success_score), 4) AS s FROM actions GROUP BY 1, 2), v AS (SELECT a, b, s, strength, evidence_count, id IS NOT NULL AS cyclic FROM n LEFT JOIN e ON e.cause_id = a AND e.effect_id = b LEFT JOIN w ON seed = b AND id = a) SELECT a, b, CASE WHEN a = b THEN 'self' WHEN cyclic THEN 'cycle' WHEN strength IS NULL THEN 'insert' ELSE 'update' END AS op, round(CASE WHEN a = b OR cyclic THEN NULL WHEN strength IS NULL THEN s ELSE (strength + s) / 2 END, 6) AS strength, CASE WHEN a = b OR cyclic THEN NULL ELSE coalesce(evidence_count, 0) + 1 END AS evidence_count FROM v")
def causal_upsert(spark, sf, depth: int = 10):
    """New causal links: self links and those that close a cycle of up to ten steps back are refused, known links averaged and their evidence counted."""
    e = T.causal_links(spark, sf).where("strength >= 0.8").select(F.col("cause_id").alias("a"), F.col("effect_id").alias("b"), "strength", "evidence_count")
    n = T.actions(spark, sf).groupBy(F.col("k").alias("a"), ((F.col("k") * 7 + 3) % 100).alias("b")).agg(S.rounded(F.max("success_score"), 4).alias("s"))
    j = n.join(e, ["a", "b"], "left").join(cycles.closing(e, n, depth), ["a", "b"], "left")
    op = F.when(F.col("a") == F.col("b"), "self").when(F.col("cyclic"), "cycle").when(F.col("strength").isNull(), "insert").otherwise("update")
    kept = ~op.isin("self", "cycle")
    new = F.when(F.col("strength").isNull(), F.col("s")).otherwise((F.col("strength") + F.col("s")) / 2)
    return j.select("a", "b", op.alias("op"), S.rounded(F.when(kept, new)).alias("strength"), F.when(kept, F.coalesce("evidence_count", F.lit(0)) + 1).alias("evidence_count"))


@query("m10_version_diff", ctes("versions") + ", p AS (SELECT entity_id, version, lag(data) OVER (PARTITION BY entity_id ORDER BY version) AS old, data AS new FROM versions), l AS (SELECT *, string_split(old, ':') AS o, string_split(new, ':') AS n FROM p WHERE old IS NOT NULL), h AS (SELECT entity_id, version, o[1] <> n[1] AS x, o[2] <> n[2] AS y, o, n FROM l) SELECT entity_id, version, CASE WHEN NOT x AND NOT y THEN '' WHEN x AND y THEN concat_ws(chr(10), '--- ', '+++ ', '@@ -1,2 +1,2 @@', '-' || o[1], '-' || o[2], '+' || n[1], '+' || n[2]) WHEN x THEN concat_ws(chr(10), '--- ', '+++ ', '@@ -1 +1 @@', '-' || o[1], '+' || n[1]) ELSE concat_ws(chr(10), '--- ', '+++ ', '@@ -2 +2 @@', '-' || o[2], '+' || n[2]) END AS diff FROM h")
def version_diff(spark, sf):
    """Unified diff of each version with the one before."""
    import difflib

    import pyarrow as pa

    w = Window.partitionBy("entity_id").orderBy("version")
    v = T.versions(spark, sf).select("entity_id", "version", F.lag("data").over(w).alias("old"), F.col("data").alias("new")).where("old IS NOT NULL")

    def run(batches):
        for b in batches:
            out = ["\n".join(difflib.unified_diff(o.split(":"), n.split(":"), lineterm="", n=0)) for o, n in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string())], names=["entity_id", "version", "diff"])

    return v.mapInArrow(run, "entity_id long, version long, diff string")


@query("m14_commit", ctes("versions") + "SELECT entity_id, max(version) + 1 AS version, 'checkpoint' AS message FROM versions GROUP BY 1")
def commit(spark, sf):
    return T.versions(spark, sf).groupBy("entity_id").agg((F.max("version") + 1).alias("version")).withColumn("message", F.lit("checkpoint"))


BANK = """, m AS (SELECT id, v, (id * 37 % 101) / 100.0 AS confidence, id % 7 AS uses, id % 90 AS age FROM vectors),
o AS (SELECT *, row_number() OVER (ORDER BY confidence DESC, id) AS i FROM m),
p AS (SELECT y.i AS i, list(x.i) AS partners FROM o x JOIN o y ON x.i < y.i WHERE list_cosine_similarity(x.v, y.v) > 0.3 GROUP BY 1),
r(i, kept, gives) AS (SELECT 0::BIGINT, []::BIGINT[], NULL::BIGINT UNION ALL SELECT i, CASE WHEN gives IS NULL THEN list_append(kept, i) ELSE kept END, gives FROM (SELECT r.i + 1 AS i, kept, list_min(list_intersect(kept, coalesce(partners, []))) AS gives FROM r LEFT JOIN p ON p.i = r.i + 1 WHERE r.i < (SELECT count(*) FROM o))),
s AS (SELECT o.*, gives, k.id AS kept_by FROM o JOIN r USING (i) LEFT JOIN o k ON k.i = r.gives),
l AS (SELECT id, row_number() OVER (ORDER BY confidence DESC, uses DESC, id) AS place FROM s WHERE gives IS NULL AND NOT (age > 60 AND uses < 2))
SELECT id, CASE WHEN gives IS NOT NULL THEN 'duplicate' WHEN age > 60 AND uses < 2 THEN 'unused' WHEN place > 100 THEN 'excess' ELSE 'kept' END AS verdict, kept_by FROM s LEFT JOIN l USING (id)"""


def _bank(spark, sf):
    """Memories with a confidence, uses and an age in days."""
    return T.vectors(spark, sf).select("id", "v", (F.col("id") * 37 % 101 / 100.0).alias("confidence"), (F.col("id") % 7).alias("uses"), (F.col("id") % 90).alias("age"))


@query("m17_bank_consolidation", ctes("vectors", recursive=True) + BANK)
def bank_consolidation(spark, sf, similar: float = 0.3, most: int = 100):
    """All memories compared with all: what gives way to a surer one, what is old and unused, what exceeds the bank's size."""
    return O.consolidated_bank(_bank(spark, sf), similar, 60, 2, most)


CLUSTERS = """, m AS (SELECT id, v, (id * 37 % 101) / 100.0 AS importance, id % 7 AS uses FROM vectors),
f AS (SELECT *, row_number() OVER (ORDER BY uses DESC, importance DESC, id) AS i FROM m WHERE uses >= 3),
n AS (SELECT f.i AS i, f.id AS anchor, m.id AS id, list_cosine_similarity(f.v, m.v) AS s FROM f JOIN m ON f.id <> m.id WHERE list_cosine_similarity(f.v, m.v) >= 0.35 QUALIFY row_number() OVER (PARTITION BY f.id ORDER BY s DESC, m.id) <= 10),
l AS (SELECT i, list(id) AS near FROM n GROUP BY i),
r(i, taken, anchor) AS (SELECT 0::BIGINT, []::BIGINT[], NULL::BIGINT UNION ALL SELECT r.i + 1, CASE WHEN list_contains(taken, f.id) THEN taken ELSE list_concat(taken, coalesce(near, [])) END, CASE WHEN list_contains(taken, f.id) THEN NULL ELSE f.id END FROM r JOIN f ON f.i = r.i + 1 LEFT JOIN l ON l.i = r.i + 1)
SELECT n.anchor AS anchor, count(*) AS members, round(avg(s), 6) AS avg_similarity, string_agg(CAST(n.id AS VARCHAR), ',' ORDER BY n.id) AS ids FROM n JOIN r ON r.anchor = n.anchor GROUP BY n.anchor"""


@query("m18_memory_clusters", ctes("vectors", recursive=True) + CLUSTERS)
def memory_clusters(spark, sf, least: float = 0.35, uses: int = 3):
    """Memories that are like a frequent one, the most used first; the given vectors have no pair as similar as the usual 0.8."""
    m = T.vectors(spark, sf).select("id", "v", (F.col("id") * 37 % 101 / 100.0).alias("importance"), (F.col("id") % 7).alias("uses"))
    c = O.clusters_around(m, m.where(F.col("uses") >= uses), least, 10, ["-uses", "-importance", "id"])
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("id")), lambda x: x.cast("string")), ",")  # ten at most
    return c.groupBy("anchor").agg(rows().alias("members"), S.rounded(F.avg("score")).alias("avg_similarity"), ids.alias("ids"))


@query("j09_conflicts")
def conflicts(spark, sf):
    """All near copies, wherever they differ and however short."""
    return N.conflicts(T.base(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text"))


@query("j12_lookup_hits", ctes("vectors") + ", q AS (SELECT v AS q FROM vectors WHERE id = 0), t AS (SELECT id, list_cosine_similarity(v, q) AS s FROM vectors, q ORDER BY 2 DESC, 1 LIMIT 10) SELECT id, source, lang, round(s, 6) AS score FROM t JOIN documents ON doc_id = id")
def lookup_hits(spark, sf):
    v = T.vectors(spark, sf)
    hits = O.nearest(v, v.where("id = 0").first().v, 10)
    d = T.base(spark, sf, "documents").select(F.col("doc_id").alias("id"), "source", "lang")
    return d.join(F.broadcast(hits), "id").select("id", "source", "lang", S.rounded("score").alias("score"))


@query("j14_trajectory_join", ctes("actions") + "SELECT c_mktsegment AS segment, count(*) AS n, round(avg(success_score), 6) AS mean FROM actions JOIN customer ON agent_id = c_custkey GROUP BY 1")
def trajectory_join(spark, sf):
    a, c = T.actions(spark, sf), T.base(spark, sf, "customer").select(F.col("c_custkey").alias("agent_id"), F.col("c_mktsegment").alias("segment"))
    return a.join(c, "agent_id").groupBy("segment").agg(rows().alias("n"), S.rounded(F.avg("success_score")).alias("mean"))


@query("t15_semantic_chunks")
def semantic_chunks(spark, sf):
    return C.semantic(T.base(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text"), 600, 0.05)


@query("t18_chunks_with_offsets")
def chunks_with_offsets(spark, sf):
    return C.located(T.base(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text"), 800, 2)


@query("t31_cache_key", ctes("actions") + "SELECT action_id, substr(sha256(context || '{\"t\":\"' || action_type || '\"}'), 1, 32) AS hash FROM actions")
def cache_key(spark, sf):
    return T.actions(spark, sf).select("action_id", F.substring(F.sha2(F.concat("context", F.to_json(F.struct(F.col("action_type").alias("t")))), 256), 1, 32).alias("hash"))


@query("t38_additive_relevance", ctes("entities") + "SELECT id, round(least(1.0, CASE WHEN contains(name, '7') THEN 0.5 ELSE 0 END + 0.15 * (CAST(contains(lower(content), 'the') AS INT) + CAST(contains(lower(content), 'tion') AS INT)) + CASE WHEN entity_type = 'src1' THEN 0.1 ELSE 0 END + CASE tier WHEN 'core' THEN 0.1 WHEN 'working' THEN 0.05 ELSE 0 END), 6) AS relevance FROM entities")
def additive_relevance(spark, sf):
    s = F.when(F.contains("name", F.lit("7")), 0.5).otherwise(0.0) + X.matches(F.lower("content"), ["the", "tion"]) * 0.15 + F.when(F.col("entity_type") == "src1", 0.1).otherwise(0.0) + F.when(F.col("tier") == "core", 0.1).when(F.col("tier") == "working", 0.05).otherwise(0.0)
    return T.entities(spark, sf).select("id", S.rounded(F.least(F.lit(1.0), s)).alias("relevance"))


def _centroids(spark, sf):
    v = T.vectors(spark, sf)
    x = v.select("label", F.posexplode("v").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("x"))
    m = F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda s: s["x"])
    n = v.groupBy("label").agg(rows().alias("n"))
    return x.groupBy("label").agg(m.alias("m")).join(n, "label")


CENTROIDS = ctes("vectors") + ", e AS (SELECT label, i, avg(v[i]) AS x FROM (SELECT label, v, unnest(range(1, 65)) AS i FROM vectors) GROUP BY 1, 2), m AS (SELECT label, list(x ORDER BY i) AS m FROM e GROUP BY 1)"


def _farthest_sql(k: int) -> str:
    out = ctes("vectors") + ", c1 AS (SELECT id, v FROM vectors ORDER BY id LIMIT 1)"
    for i in range(2, k + 1):
        near = ", ".join(f"list_distance(x.v, (SELECT v FROM c{j}))" for j in range(1, i))
        out += f", c{i} AS (SELECT id, v FROM (SELECT x.id, x.v, least({near}) AS d FROM vectors x) WHERE d > 0 ORDER BY round(d, 9) DESC, id LIMIT 1)"
    return out + " " + " UNION ALL ".join(f"SELECT {i} AS place, id FROM c{i}" for i in range(1, k + 1))


@query("v13_farthest_point", _farthest_sql(5))
def farthest_point(spark, sf, k: int = 5):
    """Deterministic seeding: each next seed is the vector farthest from those chosen; one scan a seed."""
    v = T.vectors(spark, sf)
    first = v.orderBy("id").first()
    chosen = [] if first is None else [(first.id, list(first.v))]
    while chosen and len(chosen) < k:
        near = F.least(*[F.lit(float("inf")), *[F.aggregate(F.zip_with("v", F.array(*map(F.lit, c)), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x) for _, c in chosen]])
        far = v.select("id", "v", near.alias("d")).orderBy(F.desc("d"), "id").first()
        if far.d == 0:
            break
        chosen.append((far.id, list(far.v)))
    return spark.createDataFrame([(i + 1, x) for i, (x, _) in enumerate(chosen)], "place int, id long")


@query("v15_merge_centroids", CENTROIDS + " SELECT a.label AS a, b.label AS b FROM m a JOIN m b ON a.label < b.label WHERE list_cosine_similarity(a.m, b.m) > 0.0")
def merge_centroids(spark, sf):
    """Pairs of class centroids that would be merged; there is one centroid a class."""
    m = _centroids(spark, sf).select("label", "m")
    every = m.agg(F.collect_list(F.struct("label", "m")).alias("c"))  # one row: the few classes
    x = m.crossJoin(F.broadcast(every)).select("label", "m", F.explode("c").alias("o")).where("label < o.label")
    return x.where(V.cosine("m", F.col("o.m")) > 0.0).select(F.col("label").alias("a"), F.col("o.label").alias("b"))


@query("v18_classify", CENTROIDS + ", d AS (SELECT id, m.label AS label, list_cosine_similarity(v, m) AS s, row_number() OVER (PARTITION BY id ORDER BY round(list_cosine_similarity(v, m), 9) DESC, m.label) AS rn FROM vectors, m) SELECT id, CASE WHEN s >= 0.3 THEN label END AS category FROM d WHERE rn = 1")
def classify(spark, sf, vigilance: float = 0.3):
    every = _centroids(spark, sf).agg(F.collect_list(F.struct("label", "m")).alias("c"))  # one row: the few classes
    best = F.array_max(F.transform("c", lambda s: F.struct(F.round(V.cosine("v", s["m"]) + 1e-10, 9).alias("s"), (-s["label"]).alias("c"))))
    b = T.vectors(spark, sf).crossJoin(F.broadcast(every)).select("id", best.alias("b"))
    return b.select("id", F.when(F.col("b.s") >= vigilance, -F.col("b.c")).alias("category"))


@query("v22_visual_clusters")
def visual_clusters(spark, sf):
    return O.kmeans(T.vectors(spark, sf), 5, seed=7).groupBy("cluster").agg(rows().alias("n"))


@query("v25_chunk_search", ctes("vectors") + ", q AS (SELECT v AS q FROM vectors WHERE id = 3), c AS (SELECT id, list_cosine_similarity(v, q) AS s FROM vectors, q) SELECT id, round(s, 6) AS score FROM c WHERE s >= 0.15 ORDER BY s DESC, id LIMIT 10")
def chunk_search(spark, sf):
    v = T.vectors(spark, sf)
    return O.nearest(v, v.where("id = 3").first().v, 10, 0.15).select("id", S.rounded("score").alias("score"))


def _asked(text: str, most: int = 10) -> list[str]:
    """The first keywords of a question."""
    words = (w.strip(X.STRIPPED) for w in text.lower().split())
    return [w for w in words if len(w) >= 3 and w not in X.STOPWORDS][:most]


QUESTION = "Which effects did doc_7 and doc_42 have, and what of haedtion?"


def _activation_sql(least: float, depth: int = 3) -> str:
    words = ", ".join(f"({i}, '{w}')" for i, w in enumerate(_asked(QUESTION)))
    out = ctes("associations", "entities") + f", q(no, w) AS (VALUES {words}), h AS (SELECT no, id FROM q JOIN entities ON contains(lower(name), w) OR contains(lower(entity_type), w) OR contains(lower(content), w) QUALIFY row_number() OVER (PARTITION BY no ORDER BY id) <= 5), e AS (SELECT a_id AS a, b_id AS b, strength FROM associations UNION ALL SELECT b_id, a_id, strength FROM associations), l0 AS (SELECT no, id AS seed, id, 1.0::DOUBLE / (SELECT count(*) FROM h) AS x FROM h)"
    for d in range(1, depth):
        seen = " UNION ALL ".join(f"SELECT no, seed, id FROM l{i}" for i in range(d))
        out += f", l{d} AS (SELECT no, seed, b AS id, max(x * strength * (1 - 0.3)) AS x FROM l{d - 1} JOIN e ON a = id WHERE x >= {least} AND x * strength * (1 - 0.3) >= {least} AND (no, seed, b) NOT IN ({seen}) GROUP BY 1, 2, 3)"
    return out + " SELECT id, round(least(1.0, sum(x)), 6) AS activation FROM (" + " UNION ALL ".join(f"SELECT id, x FROM l{d}" for d in range(depth)) + ") GROUP BY id"


def _keyword_activation(spark, sf, least: float, depth: int = 3, hits: int = 5):
    """Seeds are ``hits`` entities at most for each keyword of the question, in name, type or text; each spreads by itself."""
    e = T.entities(spark, sf)
    found = [F.when(X.matches(F.concat_ws("\n", F.lower("name"), F.lower("entity_type"), F.lower("content")), [w]) > 0, F.lit(i)) for i, w in enumerate(_asked(QUESTION))]
    each = e.select("id", F.explode(F.array_compact(F.array(*found))).alias("no"))
    seeds = ranked(each, ["no"], [F.col("id")], hits).select("no", "id").collect()  # hits for each keyword at most
    given = spark.createDataFrame([(k, r.id, 1.0 / len(seeds)) for k, r in enumerate(sorted(seeds))], "seed long, id long, activation double")
    a = T.associations(spark, sf)
    both = a.select(F.col("a_id").alias("a"), F.col("b_id").alias("b"), "strength").unionByName(a.select(F.col("b_id").alias("a"), F.col("a_id").alias("b"), "strength"))
    return G.spread(both, given, depth, 0.3, least).select("id", S.rounded("activation").alias("activation"))


@query("g15_keyword_activation", _activation_sql(0.2))
def keyword_activation(spark, sf):
    """Activation from what a question's keywords hit, handed on from 0.2."""
    return _keyword_activation(spark, sf, 0.2)


@query("g15_keyword_activation_far", _activation_sql(0.01))
def keyword_activation_far(spark, sf):
    """The same, handed on from 0.01, so that it reaches all of the surveyed depth."""
    return _keyword_activation(spark, sf, 0.01)


@query("g19_citation_cycle", ctes("causal_links", recursive=True) + ", e AS (SELECT cause_id AS a, effect_id AS b FROM causal_links WHERE strength >= 0.6), r(seed, id, depth) AS (SELECT DISTINCT a, b, 1 FROM e UNION SELECT seed, b, depth + 1 FROM r JOIN e ON a = id WHERE depth < 10) SELECT DISTINCT seed AS id FROM r WHERE seed = id")
def citation_cycle(spark, sf, depth: int = 10):
    """Nodes that reach themselves within ten citations."""
    e = T.causal_links(spark, sf).where("strength >= 0.6").select(F.col("cause_id").alias("a"), F.col("effect_id").alias("b"))
    return cycles.closing(e, e, depth - 1).where("cyclic").select(F.col("a").alias("id")).distinct()


@query("c04_multi_source_recall", ctes("entities", "feedback") + ", r AS (SELECT source, (sum(success) + 1) / (count(*) + 2) AS rel FROM feedback GROUP BY 1) SELECT id, round(importance * rel, 6) AS score FROM entities JOIN r ON entity_type = source WHERE tier = 'core' ORDER BY importance * rel DESC, id LIMIT 25")
def multi_source_recall(spark, sf):
    """Core entities ranked by importance and the reliability of their source."""
    r = T.feedback(spark, sf).groupBy(F.col("source").alias("entity_type")).agg(S.laplace(F.sum("success"), rows()).alias("rel"))
    e = T.entities(spark, sf).where("tier = 'core'").join(r, "entity_type").withColumn("x", F.col("importance") * F.col("rel"))
    return e.orderBy(F.desc("x"), "id").limit(25).select("id", S.rounded("x").alias("score"))
