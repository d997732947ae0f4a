"""Keyword retrieval, filters, top-k, set operations and version history."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from mnemospark.functions import scores as S
from mnemospark.operators import learning as L
from mnemospark.operators import filters as O
from mnemospark.operators import postings as P
from mnemospark.operators import topk as K
from mnemospark.plans.registry import query
from mnemospark.sources import tables as T
from mnemospark.sources.tables import ctes


def rows():
    return F.count(F.lit(1))


@query("s01_search_nodes", ctes("entities") + "SELECT id, name, access_count FROM entities WHERE name ILIKE '%doc\\_1%' ESCAPE '\\' OR entity_type ILIKE '%src7%' ORDER BY access_count DESC, id LIMIT 10")
def search_nodes(spark, sf):
    hits = T.entities(spark, sf)
    hits = hits.where(O.contains_text("name", "doc_1") | O.contains_text("entity_type", "SRC7"))
    return hits.orderBy(F.desc("access_count"), "id").limit(10).select("id", "name", "access_count")


@query("s14_checksum", ctes("entities") + "SELECT id, sha256(content) AS checksum, substr(sha256(content), 1, 16) AS short FROM entities")
def checksum(spark, sf):
    sha = F.sha2("content", 256)
    return T.entities(spark, sf).select("id", sha.alias("checksum"), F.substring(sha, 1, 16).alias("short"))


@query("s16_entity_documents", ctes("entities", "observations") + "SELECT id, string_agg(o.content, ' ' ORDER BY seq) AS joined FROM entities e LEFT JOIN observations o ON e.id = o.entity_id GROUP BY id")
def entity_documents(spark, sf):
    """Entities with their observations joined in order."""
    o = T.observations(spark, sf).groupBy("entity_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "content"))), lambda x: x["content"]), " ").alias("joined"))
    e = T.entities(spark, sf).select("id")
    return e.join(o, e.id == o.entity_id, "left").select("id", "joined")


@query("s17_migration", ctes("entities") + ", t AS (SELECT concat_ws(' | ', 'Name: ' || name, 'Type: ' || entity_type, 'Observations: ' || content) AS c, length(content) AS n FROM entities) SELECT CASE WHEN n < 200 THEN 'skipped' ELSE 'success' END AS status, count(*) AS rows, CAST(sum(length(c)) AS BIGINT) AS chars FROM t GROUP BY 1")
def migration(spark, sf, least: int = 200):
    text = F.concat_ws(" | ", F.concat(F.lit("Name: "), "name"), F.concat(F.lit("Type: "), "entity_type"), F.concat(F.lit("Observations: "), "content"))
    t = T.entities(spark, sf).select(F.when(F.length("content") < least, "skipped").otherwise("success").alias("status"), F.length(text).cast("long").alias("n"))
    return t.groupBy("status").agg(rows().alias("rows"), F.sum("n").alias("chars"))


@query("s20_resume_reindex", ctes("entities", "feedback") + "SELECT tier, count(*) AS todo FROM entities WHERE id NOT IN (SELECT doc_id FROM feedback) GROUP BY tier")
def resume_reindex(spark, sf):
    """What is left to index, by an anti join on the ids done."""
    e, done = T.entities(spark, sf), T.feedback(spark, sf)
    return e.join(done, e.id == done.doc_id, "left_anti").groupBy("tier").agg(rows().alias("todo"))


@query("s24_search_resource", ctes("entities") + "SELECT entity_type, count(*) AS n FROM entities WHERE lower(content) LIKE '%there%' AND tier = 'core' GROUP BY 1")
def search_resource(spark, sf, text: str = "there", tier: str = "core"):
    """A parameterised SQL text over a named view."""
    return spark.sql("SELECT entity_type, count(*) AS n FROM {e} WHERE contains(lower(content), :q) AND tier = :t GROUP BY 1", args={"q": text, "t": tier}, e=T.entities(spark, sf))


@query("s25_read_graph", ctes("relations") + "SELECT relation_type, count(*) AS n FROM relations JOIN supplier ON from_id = s_suppkey JOIN part ON to_id = p_partkey + 1000000000 GROUP BY 1")
def read_graph(spark, sf):
    r, s, p = T.relations(spark, sf), T.base(spark, sf, "supplier").select("s_suppkey"), T.base(spark, sf, "part").select("p_partkey")
    return r.join(s, r.from_id == s.s_suppkey).join(p, r.to_id == p.p_partkey + 1000000000).groupBy("relation_type").agg(rows().alias("n"))


@query("f01_confidence", ctes("relations") + "SELECT from_id, to_id, confidence FROM relations WHERE confidence >= 0.97")
def confidence(spark, sf):
    return O.min_confidence(T.relations(spark, sf), 0.97).select("from_id", "to_id", "confidence")


@query("f02_type", ctes("entities") + "SELECT id FROM entities WHERE entity_type = 'src3'")
def of_type(spark, sf):
    return O.conjunction(T.entities(spark, sf), entity_type="src3").select("id")


@query("f03_date_range", ctes("actions") + "SELECT action_id FROM actions WHERE executed_at BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-06'")
def date_range(spark, sf):
    import datetime as d

    return O.between(T.actions(spark, sf), "executed_at", d.datetime(2024, 1, 5), d.datetime(2024, 1, 6)).select("action_id")


@query("f04_extract_field", "SELECT lang FROM documents WHERE lang IS NOT NULL")
def extract_field(spark, sf):
    return O.extract(T.base(spark, sf, "documents"), "lang")


@query("f05_dynamic_filter", ctes("actions") + "SELECT action_id, success_score FROM actions WHERE success_score >= 0.4 AND success_score <= 0.9 AND action_type = 'purchase' ORDER BY success_score DESC, action_id LIMIT 50")
def dynamic_filter(spark, sf):
    a = O.conjunction(T.actions(spark, sf), success_score_min=0.4, success_score_max=0.9, action_type="purchase", k_min=None)
    return a.orderBy(F.desc("success_score"), "action_id").limit(50).select("action_id", "success_score")


@query("f06_neighbor_filter", ctes("relations") + "SELECT from_id, count(*) AS n FROM relations WHERE relation_type IN ('causes', 'leads_to') AND strength >= 0.5 AND valid_from >= TIMESTAMP '1993-01-01' GROUP BY 1")
def neighbor_filter(spark, sf):
    r = O.conjunction(T.relations(spark, sf), relation_type_in=["causes", "leads_to"], strength_min=0.5)
    return r.where("valid_from >= TIMESTAMP_NTZ'1993-01-01'").groupBy("from_id").agg(rows().alias("n"))


@query("f07_as_of", ctes("relations") + "SELECT from_id, to_id FROM relations WHERE valid_from <= TIMESTAMP '1995-06-17' AND (valid_until IS NULL OR valid_until > TIMESTAMP '1995-06-17')")
def as_of_filter(spark, sf):
    import datetime as d

    return O.valid_at(T.relations(spark, sf), d.datetime(1995, 6, 17)).select("from_id", "to_id")


@query("f08_search_observations", ctes("entities", "observations") + "SELECT id, name FROM entities e WHERE tier IN ('core', 'semantic') AND (lower(name) LIKE '%99%' OR EXISTS (SELECT 1 FROM observations o WHERE o.entity_id = e.id AND lower(o.content) LIKE '%thanedble%')) ORDER BY id LIMIT 20")
def search_observations(spark, sf):
    e = T.entities(spark, sf).where(F.col("tier").isin("core", "semantic"))
    o = T.observations(spark, sf).where(O.contains_text("content", "thanedble")).select(F.col("entity_id").alias("id")).distinct().withColumn("hit", F.lit(True))
    return e.join(o, "id", "left").where(F.col("hit") | O.contains_text("name", "99")).orderBy("id").limit(20).select("id", "name")


ASKED = ["thanedble", "HAEDTION", "erin ", "100%", "the", "no such words", "a_b", "zz"]


@query("f08_search_indexed", ctes("entities") + f"SELECT w AS pattern, id FROM entities JOIN (SELECT unnest({ASKED}) AS w) ON contains(lower(name || chr(10) || content), lower(w))")
def search_indexed(spark, sf):
    """Several patterns in names and texts, by an index of their trigrams."""
    e = T.entities(spark, sf).select("id", F.concat("name", F.lit("\n"), "content").alias("text"))
    return P.TrigramIndex(e).search(ASKED)


@query("f09_find_belief", ctes("beliefs") + "SELECT agent_id, statement, probability FROM beliefs WHERE statement ILIKE '%PUR%' ORDER BY probability DESC, agent_id LIMIT 10")
def find_belief(spark, sf):
    return T.beliefs(spark, sf).where(O.contains_text("statement", "PUR")).orderBy(F.desc("probability"), "agent_id").limit(10).select("agent_id", "statement", "probability")


@query("f10_similar_actions", ctes("actions") + "SELECT action_id, context FROM actions WHERE action_type = 'view' AND context ILIKE '%k1%' ORDER BY executed_at DESC, action_id LIMIT 10")
def similar_actions(spark, sf):
    return T.actions(spark, sf).where((F.col("action_type") == "view") & O.contains_text("context", "k1")).orderBy(F.desc("executed_at"), "action_id").limit(10).select("action_id", "context")


@query("f11_goals_for_member", "SELECT p_partkey FROM part WHERE p_size % 7 = 0 OR p_brand = 'Brand#1'")
def goals_for_member(spark, sf):
    assigned = F.when(F.col("p_size") % 7 == 0, F.array().cast("array<string>")).otherwise(F.array("p_brand"))
    return O.meant_for(T.base(spark, sf, "part").withColumn("assigned", assigned), "Brand#1", "assigned").select("p_partkey")


@query("f12_learnings", ctes("actions") + "SELECT action_id FROM actions WHERE k % 10 = 0 OR k = 33 ORDER BY executed_at DESC, action_id LIMIT 20")
def learnings(spark, sf):
    applies = F.when(F.col("k") % 10 == 0, F.array().cast("array<string>")).otherwise(F.array("context"))
    return O.meant_for(T.actions(spark, sf).withColumn("applies", applies), "k33", "applies").orderBy(F.desc("executed_at"), "action_id").limit(20).select("action_id")


@query("f13_confidence_rules", ctes("relations") + "SELECT from_id, to_id, concat_ws(',', CASE WHEN confidence < 0.94 THEN 'low_confidence' END, CASE WHEN strength > 0.9 THEN 'overconfident' END, CASE WHEN valid_until IS NULL THEN 'open' END) AS issues FROM relations")
def confidence_rules(spark, sf):
    found = O.issues({"low_confidence": F.col("confidence") < 0.94, "overconfident": F.col("strength") > 0.9, "open": F.col("valid_until").isNull()})
    return T.relations(spark, sf).select("from_id", "to_id", F.array_join(found, ",").alias("issues"))


@query("k01_top_n", ctes("relations") + "SELECT from_id, to_id, strength FROM relations ORDER BY strength DESC, from_id, to_id LIMIT 10")
def top_n(spark, sf):
    return T.relations(spark, sf).orderBy(F.desc("strength"), "from_id", "to_id").limit(10).select("from_id", "to_id", "strength")


@query("k02_deduplicate", "SELECT text_key, doc_id FROM (SELECT md5(text) AS text_key, min(doc_id) AS doc_id FROM documents GROUP BY 1)")
def deduplicate(spark, sf):
    """First row per key, by a pre-aggregated minimum."""
    return T.base(spark, sf, "documents").groupBy(F.md5("text").alias("text_key")).agg(F.min("doc_id").alias("doc_id"))


@query("k03_combine", ctes("entities") + ", a AS (SELECT id, name, importance FROM entities WHERE tier = 'core'), b AS (SELECT id, name, importance * 2 AS importance FROM entities WHERE id % 3 = 0) SELECT id, name, importance FROM a UNION ALL SELECT * FROM b WHERE name NOT IN (SELECT name FROM a)")
def combine(spark, sf):
    e = T.entities(spark, sf).select("id", "name", "importance", "tier")
    return K.combine([e.where("tier = 'core'").drop("tier"), e.where("id % 3 = 0").select("id", "name", (F.col("importance") * 2).alias("importance"))], "name").select("id", "name", "importance")


EXPANSION = ", q AS (SELECT unnest(['the', 'ing', 'tion']) AS q), h AS (SELECT id, q, len(regexp_extract_all(lower(content), q)) * 1.0 / length(content) AS s FROM entities, q WHERE contains(lower(content), q))"


@query("k04_query_expansion", ctes("entities") + EXPANSION + " SELECT id, round(max(s), 6) AS score, arg_max(q, s) AS best FROM h GROUP BY id ORDER BY max(s) DESC, id LIMIT 10")
def query_expansion(spark, sf, terms=("the", "ing", "tion")):
    """Hits of every expansion of a query; each entity keeps its best score."""
    low = T.entities(spark, sf).select("id", F.lower("content").alias("low"), F.length("content").alias("n"))
    gone = lambda t: F.octet_length("low") - F.octet_length(F.replace("low", F.lit(t), F.lit("")))
    found = [(gone(t) / float(len(t.encode())) / F.col("n")).alias("s") for t in terms]
    hits = [F.when(F.contains("low", F.lit(t)), F.struct(s, F.lit(t).alias("q"))) for s, t in zip(found, terms)]
    best = low.select("id", F.greatest(*hits, F.lit(None)).alias("b")).where("b IS NOT NULL")
    return best.orderBy(F.desc("b.s"), "id").limit(10).select("id", S.rounded("b.s").alias("score"), F.col("b.q").alias("best"))


@query("k05_hierarchical_search", ctes("entities", "observations") + ", h AS (SELECT id AS entity_id, 'summary' AS level, -1 AS idx, importance AS score FROM entities WHERE tier = 'core' UNION ALL SELECT entity_id, 'chunk', seq, length(content) / 1000.0 FROM observations) SELECT entity_id, level, idx, round(score, 6) AS score FROM h ORDER BY score DESC, entity_id, level, idx LIMIT 25")
def hierarchical_search(spark, sf):
    e = T.entities(spark, sf).where("tier = 'core'").select(F.col("id").alias("entity_id"), F.lit(-1).alias("idx"), F.col("importance").alias("score"))
    o = T.observations(spark, sf).select("entity_id", F.col("seq").alias("idx"), (F.length("content") / 1000.0).alias("score"))
    return K.over_levels({"summary": e, "chunk": o}, 25, "entity_id").withColumn("score", S.rounded("score"))


@query("k06_pending_by_priority", "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderstatus = 'O' ORDER BY CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 WHEN '3-MEDIUM' THEN 3 ELSE 4 END, o_orderdate, o_orderkey LIMIT 30")
def pending_by_priority(spark, sf):
    o = T.base(spark, sf, "orders").where("o_orderstatus = 'O'")
    return o.orderBy(K.by_priority("o_orderpriority", ["1-URGENT", "2-HIGH", "3-MEDIUM"]), "o_orderdate", "o_orderkey").limit(30).select("o_orderkey", "o_orderpriority")


@query("k07_forgetting_candidates", ctes("entities") + "SELECT id, round(0.4 * importance + least(0.3, 0.02 * access_count) + 0.2 * exp(-0.01 * id % 400), 6) AS retention FROM entities ORDER BY 0.4 * importance + least(0.3, 0.02 * access_count) + 0.2 * exp(-0.01 * id % 400), id LIMIT 20".replace("-0.01 * id % 400", "-0.01 * (id % 400)"))
def forgetting_candidates(spark, sf):
    e = T.entities(spark, sf).select("id", S.retention_score("importance", "access_count", F.col("id") % 400).alias("r"))
    return e.orderBy("r", "id").limit(20).select("id", S.rounded("r").alias("retention"))


@query("k09_two_stage_patterns", ctes("entities") + ", a AS (SELECT id, access_count, importance, lang FROM entities ORDER BY importance DESC, id LIMIT 100) SELECT id, round(CASE WHEN lang = 'en' THEN 0.6 ELSE 0.0 END + access_count / 100.0, 6) AS similarity FROM a ORDER BY CASE WHEN lang = 'en' THEN 0.6 ELSE 0.0 END + access_count / 100.0 DESC, id LIMIT 10")
def two_stage_patterns(spark, sf):
    s = F.when(F.col("lang") == "en", 0.6).otherwise(0.0) + F.col("access_count") / 100.0
    return K.two_stage(T.entities(spark, sf), "importance", 100, s, 10).select("id", S.rounded("score").alias("similarity"))


@query("k10_reusable_components", "SELECT p_partkey, round(0.4 * (CASE WHEN p_brand = 'Brand#2' THEN 0.5 ELSE 0 END + CASE WHEN p_size > 25 THEN 0.5 ELSE 0 END) + 0.6 * q, 6) AS score FROM (SELECT *, p_retailprice / 2000.0 AS q FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 60) ORDER BY 0.4 * (CASE WHEN p_brand = 'Brand#2' THEN 0.5 ELSE 0 END + CASE WHEN p_size > 25 THEN 0.5 ELSE 0 END) + 0.6 * q DESC, p_partkey LIMIT 15")
def reusable_components(spark, sf):
    s = (F.when(F.col("p_brand") == "Brand#2", 0.5).otherwise(0.0) + F.when(F.col("p_size") > 25, 0.5).otherwise(0.0)) * 0.4 + F.col("p_retailprice") / 2000.0 * 0.6
    return K.two_stage(T.base(spark, sf, "part"), "p_retailprice", 60, s, 15, "p_partkey").select("p_partkey", S.rounded("score").alias("score"))


@query("k11_learnings_for_action", ctes("actions") + ", t AS (SELECT action_id, action_type, context, success_score, executed_at FROM (SELECT *, row_number() OVER (PARTITION BY action_type ORDER BY executed_at DESC, action_id) AS rn FROM actions) WHERE rn <= 10), d AS (SELECT *, CASE WHEN success_score < 0.5 THEN 0 ELSE 1 END AS ok, row_number() OVER (PARTITION BY action_type, CASE WHEN success_score < 0.5 THEN CAST(action_id AS VARCHAR) ELSE context END ORDER BY executed_at DESC, action_id) AS dup FROM t) SELECT action_type, action_id FROM (SELECT *, row_number() OVER (PARTITION BY action_type ORDER BY ok, executed_at DESC, action_id) AS r FROM d WHERE dup = 1) WHERE r <= 5")
def learnings_for_action(spark, sf, k: int = 5):
    return K.learnings(T.actions(spark, sf), "action_type", "context", "executed_at", F.col("success_score") >= 0.5, k, "action_id")


@query("u02_outer_union_of_scores", ctes("associations", "causal_links") + ", a AS (SELECT a_id AS id, count(*) AS x FROM associations GROUP BY 1), b AS (SELECT effect_id AS id, count(*) AS y FROM causal_links GROUP BY 1) SELECT coalesce(a.id, b.id) AS id, coalesce(x, 0) AS out_degree, coalesce(y, 0) AS in_degree FROM a FULL JOIN b ON a.id = b.id")
def outer_union(spark, sf):
    a = T.associations(spark, sf).groupBy(F.col("a_id").alias("id")).agg(rows().alias("x"))
    b = T.causal_links(spark, sf).groupBy(F.col("effect_id").alias("id")).agg(rows().alias("y"))
    return a.join(b, "id", "full_outer").select("id", F.coalesce("x", F.lit(0)).alias("out_degree"), F.coalesce("y", F.lit(0)).alias("in_degree"))


@query("u03_common_tags", "SELECT p_brand, string_agg(t, ',' ORDER BY t) AS common FROM (SELECT p_brand, t FROM (SELECT p_brand, p_partkey, unnest(['s' || p_size % 2, 't' || length(p_type) % 3, 'all']) AS t FROM part) GROUP BY p_brand, t HAVING count(DISTINCT p_partkey) = (SELECT count(*) FROM part q WHERE q.p_brand = p_brand)) GROUP BY p_brand".replace("q.p_brand = p_brand", "q.p_brand = any_value(x.p_brand)").replace("AS t FROM part) GROUP", "AS t FROM part) x GROUP").replace("(SELECT count(*) FROM part q WHERE q.p_brand = any_value(x.p_brand))", "max(x.n)").replace("SELECT p_brand, p_partkey, unnest", "SELECT p_brand, p_partkey, count(*) OVER (PARTITION BY p_brand) AS n, unnest"))
def common_tags(spark, sf):
    """Tags that all rows of a group have: distributive counting instead of collecting sets."""
    tags = F.array(F.concat(F.lit("s"), (F.col("p_size") % 2).cast("string")), F.concat(F.lit("t"), (F.length("p_type") % 3).cast("string")), F.lit("all"))
    p = T.base(spark, sf, "part")
    total = p.groupBy("p_brand").agg(rows().alias("n"))
    each = p.select("p_brand", F.explode(tags).alias("t")).groupBy("p_brand", "t").agg(rows().alias("m"))
    return each.join(total, "p_brand").where("m = n").groupBy("p_brand").agg(F.array_join(F.sort_array(F.collect_list("t")), ",").alias("common"))


@query("u06_self_verify", ctes("actions") + ", t AS (SELECT *, lag(k % 7) OVER (PARTITION BY agent_id ORDER BY executed_at, action_id) AS p FROM actions) SELECT CASE WHEN success_score >= 0.7 AND p = k % 7 THEN 'verified' WHEN success_score >= 0.5 THEN 'plausible' WHEN success_score >= 0.2 THEN 'weak' ELSE 'rejected' END AS verdict, count(*) AS n FROM t GROUP BY 1")
def self_verify(spark, sf):
    w = Window.partitionBy("agent_id").orderBy("executed_at", "action_id")
    t = T.actions(spark, sf).withColumn("p", F.lag(F.col("k") % 7).over(w))
    s = F.col("success_score")
    verdict = F.when((s >= 0.7) & (F.col("p") == F.col("k") % 7), "verified").when(s >= 0.5, "plausible").when(s >= 0.2, "weak").otherwise("rejected")
    return t.groupBy(verdict.alias("verdict")).agg(rows().alias("n"))


# --- joins ---


@query("j01_neighbors", ctes("relations") + "SELECT from_id AS id, to_id AS neighbor, p_name AS name FROM relations JOIN part ON to_id = p_partkey + 1000000000 WHERE from_id = 7 UNION ALL SELECT to_id, from_id, s_name FROM relations JOIN supplier ON from_id = s_suppkey WHERE to_id = 1000000007")
def neighbors(spark, sf):
    r = T.relations(spark, sf)
    p, s = T.base(spark, sf, "part"), T.base(spark, sf, "supplier")
    out = r.where("from_id = 7").join(p, r.to_id == p.p_partkey + 1000000000).select(F.col("from_id").cast("long").alias("id"), F.col("to_id").alias("neighbor"), F.col("p_name").alias("name"))
    inn = r.where("to_id = 1000000007").join(s, r.from_id == s.s_suppkey).select(F.col("to_id").alias("id"), F.col("from_id").cast("long").alias("neighbor"), F.col("s_name").alias("name"))
    return out.unionByName(inn)


@query("j02_associations", ctes("associations") + "SELECT id, other, strength FROM (SELECT a_id AS id, b_id AS other, strength FROM associations UNION ALL SELECT b_id, a_id, strength FROM associations) WHERE strength >= 0.3")
def associations_of(spark, sf):
    a = T.associations(spark, sf).where("strength >= 0.3")
    ends = F.array(F.struct(F.col("a_id").alias("id"), F.col("b_id").alias("other")), F.struct(F.col("b_id").alias("id"), F.col("a_id").alias("other")))
    return a.select(F.explode(ends).alias("e"), "strength").select("e.id", "e.other", "strength")


@query("j03_emotion_join", ctes("entities", "feedback") + "SELECT id, name, success, toxic FROM entities JOIN feedback ON id = doc_id WHERE toxic = 1")
def emotion_join(spark, sf):
    e, f = T.entities(spark, sf), T.feedback(spark, sf).where("toxic = 1")
    return e.join(f, e.id == f.doc_id).select("id", "name", "success", "toxic")


@query("j04_anti_join", "SELECT c_custkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderpriority = '1-URGENT' AND o_orderstatus = 'O' WHERE o_orderkey IS NULL")
def anti_join(spark, sf):
    c, o = T.base(spark, sf, "customer"), T.base(spark, sf, "orders").where("o_orderpriority = '1-URGENT' AND o_orderstatus = 'O'")
    return c.join(o, c.c_custkey == o.o_custkey, "left_anti").select("c_custkey")


@query("j05_stale_or_missing", "SELECT c_custkey, m AS last_order FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderdate) AS m FROM orders GROUP BY 1) ON c_custkey = o_custkey WHERE m IS NULL OR m < TIMESTAMP '1997-06-01'")
def stale_or_missing(spark, sf):
    c = T.base(spark, sf, "customer")
    m = T.base(spark, sf, "orders").groupBy("o_custkey").agg(F.max("o_orderdate").alias("last_order"))
    return c.join(m, c.c_custkey == m.o_custkey, "left").where("last_order IS NULL OR last_order < TIMESTAMP_NTZ'1997-06-01'").select("c_custkey", "last_order")


@query("j06_intersections", ctes("entities", "vectors") + "SELECT e.id AS id, round(importance * label / 10.0, 6) AS score FROM entities e JOIN vectors v ON e.id = v.id ORDER BY importance * label / 10.0 DESC, e.id LIMIT 50")
def intersections(spark, sf):
    e, v = T.entities(spark, sf).select("id", "importance"), T.vectors(spark, sf).select("id", "label")
    j = e.join(v, "id").withColumn("s", F.col("importance") * F.col("label") / 10.0)
    return j.orderBy(F.desc("s"), "id").limit(50).select("id", S.rounded("s").alias("score"))


@query("j07_left_join", ctes("actions", "beliefs") + "SELECT a.action_id, b.probability FROM actions a LEFT JOIN beliefs b ON a.agent_id = b.agent_id AND a.action_type = b.statement AND b.probability >= 0.5")
def left_join(spark, sf):
    b = T.beliefs(spark, sf).where("probability >= 0.5").select("agent_id", F.col("statement").alias("action_type"), "probability")
    return T.actions(spark, sf).join(b, ["agent_id", "action_type"], "left").select("action_id", "probability")


@query("j08_belief_divergence", ctes("beliefs") + ", c AS (SELECT statement, avg(probability) AS q FROM beliefs GROUP BY 1) SELECT agent_id, c.statement AS statement, round(abs(probability - q), 6) AS divergence, CASE WHEN abs(probability - q) >= 0.5 THEN 'high' ELSE 'medium' END AS severity FROM beliefs b JOIN c ON b.statement ILIKE '%' || substr(c.statement, 1, 50) || '%' WHERE abs(probability - q) >= 0.1")
def belief_divergence(spark, sf, least: float = 0.1):
    """Agents whose belief differs from the shared one.

    The containment test runs between distinct statements only; their pairs
    meet the beliefs by equality.
    """
    b = T.beliefs(spark, sf)
    c = b.groupBy("statement").agg(F.avg("probability").alias("q"))
    own = b.select(F.col("statement").alias("own")).distinct()
    pairs = own.join(c, F.contains(F.lower("own"), F.lower(F.substring("statement", 1, 50))))
    d = F.abs(F.col("probability") - F.col("q"))
    j = b.select("agent_id", F.col("statement").alias("own"), "probability").join(pairs, "own").where(d >= least)
    return j.select("agent_id", "statement", S.rounded(d).alias("divergence"), F.when(d >= 0.5, "high").otherwise("medium").alias("severity"))


@query("j10_audit", "SELECT n_name, count(*) AS suppliers FROM nation JOIN supplier ON n_nationkey = s_nationkey WHERE s_name <> '' GROUP BY 1")
def audit(spark, sf):
    n, s = T.base(spark, sf, "nation"), T.base(spark, sf, "supplier")
    return n.join(s, n.n_nationkey == s.s_nationkey).where("s_name <> ''").groupBy("n_name").agg(rows().alias("suppliers"))


@query("j11_left_join_on_filter", "SELECT c_mktsegment, count(o_orderkey) AS orders, round(avg(o_totalprice), 4) AS avg_price FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderdate >= TIMESTAMP '1998-01-01' GROUP BY 1")
def left_join_on_filter(spark, sf):
    c, o = T.base(spark, sf, "customer"), T.base(spark, sf, "orders").where("o_orderdate >= TIMESTAMP_NTZ'1998-01-01'")
    return c.join(o, c.c_custkey == o.o_custkey, "left").groupBy("c_mktsegment").agg(F.count("o_orderkey").alias("orders"), S.rounded(F.avg("o_totalprice"), 4).alias("avg_price"))


@query("j13_semi_join", ctes("entities", "feedback") + "SELECT id FROM entities WHERE id IN (SELECT doc_id FROM feedback WHERE success = 0)")
def semi_join(spark, sf):
    e, f = T.entities(spark, sf), T.feedback(spark, sf).where("success = 0")
    return e.join(f, e.id == f.doc_id, "left_semi").select("id")


# --- mutation semantics over append-only tables ---


UPSERT = """, old AS (SELECT e.name AS name, entity_type, access_count, 1 + id % 3 AS version, count(o.seq) AS notes FROM entities e LEFT JOIN observations o ON o.entity_id = e.id GROUP BY ALL),
given AS (SELECT 'doc_' || id AS name, 'first' AS kind, 0 AS place, 2 AS notes FROM entities WHERE id % 5 = 0 UNION ALL SELECT 'doc_' || id, 'second', 1, 1 FROM entities WHERE id % 10 = 0 UNION ALL SELECT 'new_' || id, 'first', 0, 3 FROM entities WHERE id % 50 = 0 UNION ALL SELECT 'new_' || id, 'second', 1, 0 FROM entities WHERE id % 100 = 0 UNION ALL SELECT NULL, 'none', 0, 1 FROM entities WHERE id = 0),
n AS (SELECT name, count(*) AS times, arg_max(kind, place) AS kind, sum(notes) AS notes FROM given WHERE name IS NOT NULL GROUP BY name)
SELECT coalesce(o.name, n.name) AS name, coalesce(kind, entity_type) AS entity_type, CASE WHEN o.name IS NULL THEN times - 1 ELSE access_count + coalesce(times, 0) END AS access_count,
  CASE WHEN o.name IS NULL THEN times ELSE version + coalesce(times, 0) END AS current_version, CAST(coalesce(o.notes, 0) + coalesce(n.notes, 0) AS BIGINT) AS observations,
  CASE WHEN o.name IS NULL THEN 'insert' WHEN n.name IS NULL THEN 'keep' ELSE 'update' END AS op
FROM old o FULL JOIN n ON o.name = n.name"""


@query("m01_upsert", ctes("entities", "observations") + UPSERT)
def upsert(spark, sf):
    """A batch of entities by name, some given twice: each further time counts an access and a version, and adds its observations."""
    e = T.entities(spark, sf)
    notes = F.when(F.col("content").isNull(), 0).otherwise(F.size(F.split("content", "\n")))  # an observation a line
    old = e.select("name", "entity_type", "access_count", (1 + F.col("id") % 3).alias("current_version"), notes.cast("long").alias("observations"))
    batch = lambda every, prefix, kind, at, n: e.where(F.col("id") % every == 0).select(F.concat(F.lit(prefix), F.col("id").cast("string")).alias("name"), F.lit(kind).alias("entity_type"), F.lit(at).alias("at"), F.lit(n).alias("observations"))
    given = batch(5, "doc_", "first", 0, 2)
    for more in (batch(10, "doc_", "second", 1, 1), batch(50, "new_", "first", 0, 3), batch(100, "new_", "second", 1, 0)):
        given = given.unionByName(more)
    return K.upserted(old, given)


@query("m02_access_counter", ctes("actions") + "SELECT k AS entity_id, count(*) AS accesses, max(executed_at) AS last FROM actions GROUP BY 1")
def access_counter(spark, sf):
    return T.actions(spark, sf).groupBy(F.col("k").alias("entity_id")).agg(rows().alias("accesses"), F.max("executed_at").alias("last"))


@query("m03_block_versions", ctes("versions") + "SELECT entity_id, version, data, version = max(version) OVER (PARTITION BY entity_id) AS is_current FROM versions")
def block_versions(spark, sf):
    v = T.versions(spark, sf)
    last = F.max("version").over(Window.partitionBy("entity_id"))
    return v.select("entity_id", "version", "data", (F.col("version") == last).alias("is_current"))


@query("m04_association_fold", ctes("actions") + ", s AS (SELECT agent_id, k, list(round(success_score, 4) ORDER BY executed_at, action_id) AS l FROM actions GROUP BY 1, 2) SELECT agent_id, k, round(list_reduce(l, lambda a, x: (a + x) / 2), 6) AS strength, len(l) AS n FROM s")
def association_fold(spark, sf):
    """The fold of every pair (agent_id, k), as a sorted stream."""
    a = T.actions(spark, sf).select(F.to_json(F.struct("agent_id", "k")).alias("pair"), "executed_at", "action_id", S.rounded("success_score", 4).alias("s"))
    f = L.folded(a, "pair", ["executed_at", "action_id"], ["s"], lambda: (0, None), lambda s, x: (s[0] + 1, x if s[1] is None else (s[1] + x) / 2), "n long, strength double", lambda s: s)
    return f.withColumn("p", F.from_json("pair", "agent_id long, k long")).select("p.agent_id", "p.k", S.rounded("strength").alias("strength"), "n")


@query("m06_reinforce", ctes("associations") + "SELECT a_id, b_id, round(least(1.0, strength + 0.1 * co_activation_count), 6) AS strength FROM associations")
def reinforce(spark, sf):
    return T.associations(spark, sf).select("a_id", "b_id", S.rounded(S.boosted("strength", F.col("co_activation_count") * 0.1)).alias("strength"))


@query("m07_working_memory", ctes("actions") + ", t AS (SELECT *, executed_at + INTERVAL 48 HOUR AS expires_at, (SELECT max(executed_at) FROM actions) AS now FROM actions) SELECT action_id, context, k % 5 AS priority FROM t WHERE expires_at >= now ORDER BY k % 5 DESC, executed_at DESC, action_id LIMIT 50")
def working_memory(spark, sf, hours: int = 48):
    a = T.actions(spark, sf)
    now = T.as_of(a, "executed_at")
    live = a.where(F.col("executed_at") + F.make_dt_interval(hours=F.lit(hours)) >= F.lit(now)).withColumn("priority", F.col("k") % 5)
    return live.orderBy(F.desc("priority"), F.desc("executed_at"), "action_id").limit(50).select("action_id", "context", "priority")


@query("m08_last_write_wins", ctes("actions") + "SELECT context, action_id, success_score FROM (SELECT *, row_number() OVER (PARTITION BY context ORDER BY executed_at DESC, action_id DESC) AS rn FROM actions) WHERE rn = 1")
def last_write_wins(spark, sf):
    last = F.max_by(F.struct("action_id", "success_score"), F.struct("executed_at", "action_id"))
    return T.actions(spark, sf).groupBy("context").agg(last.alias("l")).select("context", "l.action_id", "l.success_score")


@query("m09_versions_diff", ctes("versions") + "SELECT entity_id, version, lag(data) OVER w AS before, data AS after, data IS DISTINCT FROM lag(data) OVER w AS changed FROM versions WINDOW w AS (PARTITION BY entity_id ORDER BY version)")
def versions_diff(spark, sf):
    w = Window.partitionBy("entity_id").orderBy("version")
    before = F.lag("data").over(w)
    return T.versions(spark, sf).select("entity_id", "version", before.alias("before"), F.col("data").alias("after"), (~F.col("data").eqNullSafe(before)).alias("changed"))


@query("m11_revert", ctes("versions") + "SELECT entity_id, version, data FROM versions UNION ALL SELECT v.entity_id, m.n + 1, v.data FROM versions v JOIN (SELECT entity_id, max(version) AS n FROM versions GROUP BY 1) m ON v.entity_id = m.entity_id WHERE v.version = 2")
def revert(spark, sf, to: int = 2):
    v = T.versions(spark, sf).select("entity_id", "version", "data")
    head = v.groupBy("entity_id").agg(F.max("version").alias("n"))
    return v.unionByName(v.where(F.col("version") == to).join(head, "entity_id").select("entity_id", (F.col("n") + 1).alias("version"), "data"))


@query("m12_branch", ctes("versions") + "SELECT entity_id, 'main' AS branch, version, data FROM versions UNION ALL SELECT entity_id, 'draft', 1, data FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY version DESC) AS rn FROM versions) WHERE rn = 1")
def branch(spark, sf):
    v = T.versions(spark, sf)
    head = v.groupBy("entity_id").agg(F.max_by("data", "version").alias("data"))
    main = v.select("entity_id", F.lit("main").alias("branch"), "version", "data")
    return main.unionByName(head.select("entity_id", F.lit("draft").alias("branch"), F.lit(1).cast("long").alias("version"), "data"))


@query("m13_history", ctes("versions") + "SELECT version, data, created_at FROM versions WHERE entity_id = 10 ORDER BY version DESC LIMIT 10")
def history(spark, sf, entity: int = 10):
    return T.versions(spark, sf).where(F.col("entity_id") == entity).orderBy(F.desc("version")).limit(10).select("version", "data", "created_at")


@query("m15_append_block", "WITH RECURSIVE t AS (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations), r(conv_id, i, block, applied, refused) AS (SELECT conv_id, i, text, 0::BIGINT, 0::BIGINT FROM t WHERE i = 1 UNION ALL SELECT conv_id, i, CASE WHEN fits THEN block || chr(10) || text ELSE block END, applied + CASE WHEN fits THEN 1 ELSE 0 END, refused + CASE WHEN fits THEN 0 ELSE 1 END FROM (SELECT r.conv_id, t.i, block, text, applied, refused, r.conv_id % 10 <> 0 AND length(block) + 1 + length(text) <= 2000 AS fits FROM r JOIN t ON t.conv_id = r.conv_id AND t.i = r.i + 1)) SELECT conv_id, applied, refused, length(block) AS chars, sha256(block) AS digest FROM r QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1")
def append_block(spark, sf, limit: int = 2000):
    """The edit log of each conversation's block: it begins with the first turn, and each other turn is appended where it fits; every tenth block is read-only."""
    t = T.base(spark, sf, "conversations").withColumn("fixed", F.col("conv_id") % 10 == 0)
    b = L.appended(t, "conv_id", ["turn"], "text", "fixed", limit)
    return b.select("conv_id", "applied", "refused", F.length("block").cast("long").alias("chars"), F.sha2("block", 256).alias("digest"))


@query("m16_replace_block", ctes("entities") + "SELECT id, CASE WHEN contains(content, 'the') AND length(replace(content, 'the', 'THESE')) <= 3000 THEN md5(replace(content, 'the', 'THESE')) ELSE md5(content) END AS digest FROM entities")
def replace_block(spark, sf):
    new = F.replace("content", F.lit("the"), F.lit("THESE"))
    ok = F.contains("content", F.lit("the")) & (F.length(new) <= 3000)
    return T.entities(spark, sf).select("id", F.md5(F.when(ok, new).otherwise(F.col("content"))).alias("digest"))


@query("m18_prune_links", ctes("associations", "entities") + ", s AS (SELECT a_id, b_id, CASE WHEN importance > 0.7 THEN least(1.0, strength * 1.2) ELSE strength END AS s FROM associations LEFT JOIN entities ON id = a_id) SELECT a_id, b_id, round(s, 6) AS strength FROM s WHERE s >= 0.3")
def prune_links(spark, sf):
    """Links from important memories are strengthened, then weak ones go."""
    of = T.entities(spark, sf).select(F.col("id").alias("a_id"), "importance")
    s = F.when(F.col("importance") > 0.7, F.least(F.lit(1.0), F.col("strength") * 1.2)).otherwise(F.col("strength"))
    return T.associations(spark, sf).join(of, "a_id", "left").withColumn("s", s).where("s >= 0.3").select("a_id", "b_id", S.rounded("s").alias("strength"))
