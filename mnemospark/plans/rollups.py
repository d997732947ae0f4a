"""Status rollups, statistics and histograms (aggregations over memory tables)."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Window
from pyspark.sql import functions as F

from mnemospark.functions import scores as S
from mnemospark.operators import graph as G
from mnemospark.plans.registry import query
from mnemospark.sources import storage
from mnemospark.sources import tables as T
from mnemospark.sources.tables import ctes


def rows():
    return F.count(F.lit(1))


def _window(spark, sf, hours: float):
    """Actions of the last hours before the newest one, bounds inclusive."""
    a = T.actions(spark, sf)
    return a.where(F.col("executed_at") >= F.lit(T.as_of(a, "executed_at") - timedelta(hours=hours)))


@query("s23_entities_resource", ctes("entities") + "SELECT tier, entity_type, count(*) AS n, CAST(sum(access_count) AS BIGINT) AS accesses FROM entities GROUP BY tier, entity_type")
def entities_resource(spark, sf):
    return T.entities(spark, sf).groupBy("tier", "entity_type").agg(rows().alias("n"), F.sum("access_count").alias("accesses"))


@query("a01_memory_status", ctes("entities") + "SELECT tier, count(*) AS n, round(avg(length(content)), 4) AS avg_chars, CAST(sum(length(content)) AS BIGINT) AS total_chars FROM entities GROUP BY tier")
def memory_status(spark, sf):
    return T.entities(spark, sf).groupBy("tier").agg(rows().alias("n"), S.rounded(F.avg(F.length("content")), 4).alias("avg_chars"), F.sum(F.length("content")).cast("long").alias("total_chars"))


@query("a02_success_rate", ctes("actions") + "SELECT action_type, count(*) AS n, CAST(count(*) FILTER (success_score >= 0.7) AS BIGINT) AS successes, round(count(*) FILTER (success_score >= 0.7) / count(*), 6) AS rate, round(avg(success_score), 6) AS avg_score FROM actions WHERE executed_at >= (SELECT max(executed_at) FROM actions) - INTERVAL 7 DAY GROUP BY action_type")
def success_rate(spark, sf, days: int = 7):
    good = F.count_if(F.col("success_score") >= 0.7)
    return _window(spark, sf, 24 * days).groupBy("action_type").agg(rows().alias("n"), good.alias("successes"), S.rounded(F.try_divide(good, rows()), 6).alias("rate"), S.rounded(F.avg("success_score"), 6).alias("avg_score"))


@query("a03_action_statistics", ctes("actions") + """, t AS (SELECT *, (SELECT max(executed_at) FROM actions) AS now FROM actions), g AS (SELECT action_type, count(*) AS n, avg(success_score) FILTER (executed_at > now - INTERVAL 24 HOUR) AS recent, avg(success_score) FILTER (executed_at > now - INTERVAL 48 HOUR AND executed_at <= now - INTERVAL 24 HOUR) AS before FROM t GROUP BY action_type)
SELECT action_type, n, round(recent, 6) AS recent, round(before, 6) AS before, CASE WHEN recent IS NULL OR before IS NULL THEN 'stable' WHEN recent > before + 0.05 THEN 'improving' WHEN recent < before - 0.05 THEN 'declining' ELSE 'stable' END AS trend FROM g""")
def action_statistics(spark, sf):
    a = T.actions(spark, sf)
    now = T.as_of(a, "executed_at")
    day, two = F.lit(now - timedelta(hours=24)), F.lit(now - timedelta(hours=48))
    t = F.col("executed_at")
    g = a.groupBy("action_type").agg(rows().alias("n"), F.avg(F.when(t > day, F.col("success_score"))).alias("r"), F.avg(F.when((t > two) & (t <= day), F.col("success_score"))).alias("b"))
    trend = F.when(F.col("r") > F.col("b") + 0.05, "improving").when(F.col("r") < F.col("b") - 0.05, "declining").otherwise("stable")
    return g.select("action_type", "n", S.rounded("r", 6).alias("recent"), S.rounded("b", 6).alias("before"), trend.alias("trend"))


@query("a04_usage_patterns", ctes("actions") + "SELECT count(*) AS n, count(DISTINCT context) AS contexts, count(DISTINCT agent_id) AS agents, count(DISTINCT action_type) AS types, CAST(sum(CASE WHEN success_score > 0.8 THEN 1 ELSE 0 END) AS BIGINT) AS high, round(avg(success_score), 6) AS avg_score, CASE WHEN count(*) > 100 * count(DISTINCT context) THEN 'consolidate' ELSE 'ok' END AS recommendation FROM actions")
def usage_patterns(spark, sf):
    contexts = F.countDistinct("context")
    return T.actions(spark, sf).agg(rows().alias("n"), contexts.alias("contexts"), F.countDistinct("agent_id").alias("agents"), F.countDistinct("action_type").alias("types"), F.count_if(F.col("success_score") > 0.8).alias("high"), S.rounded(F.avg("success_score"), 6).alias("avg_score"), F.when(rows() > 100 * contexts, "consolidate").otherwise("ok").alias("recommendation"))


@query("a05_retrieval_statistics", ctes("actions") + "SELECT action_type, count(*) AS n, CAST(count(*) FILTER (success_score >= 0.5) AS BIGINT) AS useful, round(count(*) FILTER (success_score >= 0.5) / count(*), 6) AS usefulness FROM actions WHERE executed_at >= (SELECT max(executed_at) FROM actions) - INTERVAL 24 HOUR GROUP BY action_type")
def retrieval_statistics(spark, sf):
    useful = F.count_if(F.col("success_score") >= 0.5)
    return _window(spark, sf, 24).groupBy("action_type").agg(rows().alias("n"), useful.alias("useful"), S.rounded(useful / rows(), 6).alias("usefulness"))


@query("a06_top_memory_types", ctes("feedback") + "SELECT source, count(*) AS n, round(avg(success), 6) AS rate FROM feedback GROUP BY source HAVING count(*) >= 3 ORDER BY rate DESC, source LIMIT 10")
def top_memory_types(spark, sf):
    g = T.feedback(spark, sf).groupBy("source").agg(rows().alias("n"), S.rounded(F.avg("success"), 6).alias("rate"))
    return g.where("n >= 3").orderBy(F.desc("rate"), "source").limit(10)


@query("a07_meta_strategies", ctes("actions") + "SELECT action_type, context, count(*) AS n, round(avg(success_score), 6) AS rate FROM actions GROUP BY 1, 2 HAVING avg(success_score) >= 0.6")
def meta_strategies(spark, sf, least: float = 0.6):
    g = T.actions(spark, sf).groupBy("action_type", "context").agg(rows().alias("n"), F.avg("success_score").alias("a"))
    return g.where(F.col("a") >= least).select("action_type", "context", "n", S.rounded("a", 6).alias("rate"))


@query("a08_best_strategies", ctes("actions") + "SELECT context, count(*) AS n, round(avg(CASE WHEN success_score >= 0.5 THEN 1.0 ELSE 0.0 END), 6) AS success_rate FROM actions GROUP BY context HAVING avg(CASE WHEN success_score >= 0.5 THEN 1.0 ELSE 0.0 END) >= 0.4")
def best_strategies(spark, sf):
    met = F.avg(F.when(F.col("success_score") >= 0.5, 1.0).otherwise(0.0))
    return T.actions(spark, sf).groupBy("context").agg(rows().alias("n"), met.alias("r")).where("r >= 0.4").select("context", "n", S.rounded("r", 6).alias("success_rate"))


REVISIONS = ", rev AS (SELECT agent_id, action_type, executed_at, success_score - lag(success_score) OVER (PARTITION BY agent_id, action_type ORDER BY executed_at, action_id) AS delta FROM actions)"


def _revisions(spark, sf):
    """Changes of a belief: differences of successive scores of an agent and type."""
    w = Window.partitionBy("agent_id", "action_type").orderBy("executed_at", "action_id")
    return T.actions(spark, sf).withColumn("delta", F.col("success_score") - F.lag("success_score").over(w)).where("delta IS NOT NULL")


@query("a09_rigidity", ctes("actions") + REVISIONS + " SELECT agent_id, count(*) AS revisions, round(avg(abs(delta)), 6) AS avg_delta, round(max(abs(delta)), 6) AS max_delta, round(least(1.0, 2 * avg(abs(delta)) + 0.5 * count(*) / 1000.0), 6) AS flexibility FROM rev WHERE delta IS NOT NULL GROUP BY agent_id")
def rigidity(spark, sf):
    d = F.abs("delta")
    return _revisions(spark, sf).groupBy("agent_id").agg(rows().alias("revisions"), S.rounded(F.avg(d), 6).alias("avg_delta"), S.rounded(F.max(d), 6).alias("max_delta"), S.rounded(F.least(F.lit(1.0), 2 * F.avg(d) + 0.5 * rows() / 1000.0), 6).alias("flexibility"))


@query("a10_flexibility_summary", ctes("actions") + REVISIONS + ", f AS (SELECT agent_id, round(avg(abs(delta)), 6) AS x FROM rev WHERE delta IS NOT NULL GROUP BY agent_id) SELECT (SELECT agent_id FROM f ORDER BY x DESC, agent_id LIMIT 1) AS most, (SELECT agent_id FROM f ORDER BY x, agent_id LIMIT 1) AS least, count(*) AS agents FROM f")
def flexibility_summary(spark, sf):
    f = _revisions(spark, sf).groupBy("agent_id").agg(S.rounded(F.avg(F.abs("delta")), 6).alias("x"))
    return f.agg((-F.max(F.struct("x", (-F.col("agent_id")).alias("i")))["i"]).alias("most"), F.min(F.struct("x", "agent_id"))["agent_id"].alias("least"), rows().alias("agents"))


@query("a11_grouping_sets", ctes("actions") + "SELECT action_type, CAST(executed_at AS DATE) AS day, count(*) AS n, round(avg(success_score), 6) AS rate FROM actions GROUP BY GROUPING SETS ((), (action_type), (CAST(executed_at AS DATE)))")
def success_metrics(spark, sf):
    a = T.actions(spark, sf).withColumn("day", F.to_date("executed_at"))
    return a.groupingSets([[], [F.col("action_type")], [F.col("day")]], "action_type", "day").agg(rows().alias("n"), S.rounded(F.avg("success_score"), 6).alias("rate"))


@query("a12_component_patterns", "SELECT p_brand, p_type, count(*) AS n, round(avg(p_retailprice), 4) AS avg_price FROM part GROUP BY ROLLUP (p_brand, p_type)")
def component_patterns(spark, sf):
    return T.base(spark, sf, "part").rollup("p_brand", "p_type").agg(rows().alias("n"), S.rounded(F.avg("p_retailprice"), 4).alias("avg_price"))


@query("a13_design_trends", "SELECT p_brand, count(*) AS n, round(avg(l_quantity), 4) AS avg_quantity FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand")
def design_trends(spark, sf):
    l, p = T.base(spark, sf, "lineitem"), T.base(spark, sf, "part")
    return l.join(p, l.l_partkey == p.p_partkey).groupBy("p_brand").agg(rows().alias("n"), S.rounded(F.avg("l_quantity"), 4).alias("avg_quantity"))


@query("a14_generation_trends", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty, round(avg(l_extendedprice), 4) AS avg_price FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def generation_trends(spark, sf):
    return T.base(spark, sf, "lineitem").cube("l_returnflag", "l_linestatus").agg(rows().alias("n"), S.rounded(F.sum("l_quantity"), 2).alias("qty"), S.rounded(F.avg("l_extendedprice"), 4).alias("avg_price"))


@query("a15_route_task", ctes("actions") + ", g AS (SELECT action_type, agent_id, count(*) AS n, sum(CASE WHEN success_score >= 0.7 THEN 1 ELSE 0 END) AS s FROM actions GROUP BY 1, 2), r AS (SELECT action_type, agent_id, agent_id % 3 * 5 + CAST(floor(s / n * 20) AS BIGINT) AS score FROM g) SELECT action_type, agent_id, score FROM (SELECT *, row_number() OVER (PARTITION BY action_type ORDER BY score DESC, agent_id) AS rn FROM r) WHERE rn = 1")
def route_task(spark, sf):
    g = T.actions(spark, sf).groupBy("action_type", "agent_id").agg(rows().alias("n"), F.count_if(F.col("success_score") >= 0.7).alias("s"))
    r = g.withColumn("score", F.col("agent_id") % 3 * 5 + F.floor(F.col("s") / F.col("n") * 20))
    best = F.max(F.struct("score", (-F.col("agent_id")).alias("i")))
    return r.groupBy("action_type").agg(best.alias("b")).select("action_type", (-F.col("b.i")).alias("agent_id"), F.col("b.score").alias("score"))


@query("a16_summarize", ctes("entities") + "SELECT entity_type, count(*) AS n, round(avg(importance), 6) AS avg_importance, arg_max(id, importance * 1000000000 - id) AS top_id FROM entities GROUP BY entity_type")
def summarize(spark, sf):
    return T.entities(spark, sf).groupBy("entity_type").agg(rows().alias("n"), S.rounded(F.avg("importance"), 6).alias("avg_importance"), F.max_by("id", F.col("importance") * 1000000000 - F.col("id")).alias("top_id"))


@query("a17_field_histogram", "SELECT coalesce(lang, 'unknown') AS lang, count(*) AS n FROM documents GROUP BY 1")
def field_histogram(spark, sf):
    return T.base(spark, sf, "documents").groupBy(F.coalesce("lang", F.lit("unknown")).alias("lang")).agg(rows().alias("n"))


@query("a18_by_date", ctes("actions") + "SELECT 'day' AS granularity, strftime(executed_at, '%Y-%m-%d') AS bucket, count(*) AS n FROM actions GROUP BY 2 UNION ALL SELECT 'week', CAST(isoyear(executed_at) AS VARCHAR) || '-W' || lpad(CAST(week(executed_at) AS VARCHAR), 2, '0'), count(*) FROM actions GROUP BY 2 UNION ALL SELECT 'month', strftime(executed_at, '%Y-%m'), count(*) FROM actions GROUP BY 2")
def by_date(spark, sf):
    t = F.col("executed_at")
    week = F.concat(F.expr("extract(YEAROFWEEK FROM executed_at)").cast("string"), F.lit("-W"), F.lpad(F.weekofyear(t).cast("string"), 2, "0"))
    keys = F.array(*[F.struct(F.lit(g).alias("granularity"), k.alias("bucket")) for g, k in (("day", F.date_format(t, "yyyy-MM-dd")), ("week", week), ("month", F.date_format(t, "yyyy-MM")))])
    return T.actions(spark, sf).select(F.explode(keys).alias("x")).groupBy("x.granularity", "x.bucket").agg(rows().alias("n"))


@query("a19_statistics", ctes("actions") + "SELECT action_type, min(success_score) AS lo, max(success_score) AS hi, round(avg(success_score), 6) AS mean, round(median(success_score), 6) AS median, round(coalesce(stddev_samp(success_score), 0), 6) AS stdev FROM actions GROUP BY action_type")
def statistics(spark, sf):
    s = "success_score"
    return T.actions(spark, sf).groupBy("action_type").agg(F.min(s).alias("lo"), F.max(s).alias("hi"), S.rounded(F.avg(s), 6).alias("mean"), S.rounded(F.median(s), 6).alias("median"), S.rounded(F.coalesce(F.stddev_samp(s), F.lit(0.0)), 6).alias("stdev"))


@query("a20_group_by", "SELECT c_nationkey, count(*) AS n, string_agg(CAST(c_custkey AS VARCHAR), ',' ORDER BY c_custkey) AS ids FROM customer GROUP BY c_nationkey")
def group_rows(spark, sf):
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("c_custkey")), lambda x: x.cast("string")), ",")
    return T.base(spark, sf, "customer").groupBy("c_nationkey").agg(rows().alias("n"), ids.alias("ids"))


@query("a21_manifold_summary", ctes("entities", "feedback") + "SELECT tier, count(*) AS n, CAST(count(*) FILTER (id IN (SELECT doc_id FROM feedback)) AS BIGINT) AS rated FROM entities GROUP BY tier")
def manifold_summary(spark, sf):
    rated = T.feedback(spark, sf).select(F.col("doc_id").alias("id")).distinct().withColumn("r", F.lit(1))
    return T.entities(spark, sf).join(rated, "id", "left").groupBy("tier").agg(rows().alias("n"), F.count("r").alias("rated"))


@query("a22_map_phase", ctes("actions") + "SELECT action_type, count(*) AS n, round(avg(success_score), 6) AS significance, min(action_id) AS first_id, CASE WHEN count(DISTINCT k % 5) = 1 THEN 'k' || min(k % 5) ELSE '' END AS common_tag FROM actions WHERE executed_at >= (SELECT max(executed_at) FROM actions) - INTERVAL 24 HOUR GROUP BY action_type HAVING count(*) >= 2")
def map_phase(spark, sf):
    tag = F.col("k") % 5
    common = F.when(F.countDistinct(tag) == 1, F.concat(F.lit("k"), F.min(tag).cast("string"))).otherwise("")
    return _window(spark, sf, 24).groupBy("action_type").agg(rows().alias("n"), S.rounded(F.avg("success_score"), 6).alias("significance"), F.min("action_id").alias("first_id"), common.alias("common_tag")).where("n >= 2")


@query("a23_pattern_extraction", ctes("entities", "actions") + ", u AS (SELECT entity_type AS kind FROM entities WHERE tier = 'episodic' UNION ALL SELECT action_type FROM actions WHERE executed_at >= (SELECT max(executed_at) FROM actions) - INTERVAL 24 HOUR) SELECT kind, count(*) AS n, round(least(0.5 + 0.1 * count(*), 1.0), 6) AS confidence FROM u GROUP BY kind HAVING count(*) >= 3")
def pattern_extraction(spark, sf, least: int = 3):
    e = T.entities(spark, sf).where("tier = 'episodic'").select(F.col("entity_type").alias("kind"))
    u = e.unionByName(_window(spark, sf, 24).select(F.col("action_type").alias("kind")))
    return u.groupBy("kind").agg(rows().alias("n")).where(F.col("n") >= least).withColumn("confidence", S.rounded(F.least(0.5 + F.col("n") * 0.1, F.lit(1.0)), 6))


@query("a24_job_statistics", "SELECT o_orderstatus, count(*) AS n, round(sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE 0 END), 2) AS completed FROM orders GROUP BY 1")
def job_statistics(spark, sf):
    return T.base(spark, sf, "orders").groupBy("o_orderstatus").agg(rows().alias("n"), S.rounded(F.sum(F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice")).otherwise(0.0)), 2).alias("completed"))


@query("a25_word_patterns", ctes("entities") + "SELECT entity_type, count(*) AS frequency, CAST(sum(len(regexp_extract_all(lower(content), 'the'))) AS BIGINT) AS hits FROM entities GROUP BY entity_type HAVING count(*) >= 2 OR sum(len(regexp_extract_all(lower(content), 'the'))) >= 2")
def word_patterns(spark, sf):
    g = T.entities(spark, sf).groupBy("entity_type").agg(rows().alias("frequency"), F.sum(F.regexp_count(F.lower("content"), F.lit("the"))).cast("long").alias("hits"))
    return g.where("frequency >= 2 OR hits >= 2")


@query("a26_curation", ctes("actions") + ", top AS (SELECT * FROM actions ORDER BY success_score DESC, action_id LIMIT 200) SELECT action_type, count(*) AS n, round(avg(success_score), 6) AS significance FROM top GROUP BY action_type HAVING count(*) >= 3")
def curation(spark, sf):
    top = T.actions(spark, sf).orderBy(F.desc("success_score"), "action_id").limit(200)
    return top.groupBy("action_type").agg(rows().alias("n"), S.rounded(F.avg("success_score"), 6).alias("significance")).where("n >= 3")


@query("a27_belief_consistency", ctes("beliefs") + "SELECT statement, count(*) AS holders, round(max(probability) - min(probability), 6) AS spread, round(avg(probability), 6) AS mean, CASE WHEN count(*) = 1 THEN 'unshared' WHEN max(probability) - min(probability) < 0.2 THEN 'consistent' ELSE 'divergent' END AS verdict FROM beliefs WHERE probability >= 0.5 GROUP BY statement")
def belief_consistency(spark, sf):
    p = "probability"
    spread = F.max(p) - F.min(p)
    return T.beliefs(spark, sf).where("probability >= 0.5").groupBy("statement").agg(rows().alias("holders"), S.rounded(spread, 6).alias("spread"), S.rounded(F.avg(p), 6).alias("mean"), F.when(rows() == 1, "unshared").when(spread < 0.2, "consistent").otherwise("divergent").alias("verdict"))


@query("a28_weighted_reconcile", ctes("beliefs") + "SELECT statement, round(sum(probability * (1 + abs(evidence_balance))) / sum(1 + abs(evidence_balance)), 6) AS probability FROM beliefs GROUP BY statement")
def weighted_reconcile(spark, sf):
    w = 1 + F.abs("evidence_balance")
    return T.beliefs(spark, sf).groupBy("statement").agg(S.rounded(F.sum(F.col("probability") * w) / F.sum(w), 6).alias("probability"))


@query("a29_fusion_reconcile", ctes("beliefs") + "SELECT statement, CASE WHEN min(probability) <= 0 THEN 0.0 ELSE round(exp(avg(ln(greatest(probability, 1e-300)))), 6) END AS probability, round(1 - (max(probability) - min(probability)), 6) AS confidence FROM beliefs GROUP BY statement")
def fusion_reconcile(spark, sf):
    p = F.col("probability")
    geo = F.when(F.min(p) <= 0, 0.0).otherwise(S.rounded(F.exp(F.avg(F.log(F.greatest(p, F.lit(1e-300))))), 6))
    return T.beliefs(spark, sf).groupBy("statement").agg(geo.alias("probability"), S.rounded(1 - (F.max(p) - F.min(p)), 6).alias("confidence"))


@query("a30_majority_reconcile", ctes("beliefs") + ", g AS (SELECT statement, count(*) FILTER (probability >= 0.5) AS hi, count(*) FILTER (probability < 0.5) AS lo, avg(probability) FILTER (probability >= 0.5) AS ah, avg(probability) FILTER (probability < 0.5) AS al FROM beliefs GROUP BY statement) SELECT statement, CAST(hi AS BIGINT) AS votes_for, CAST(lo AS BIGINT) AS votes_against, round(CASE WHEN hi > lo THEN ah ELSE al END, 6) AS probability FROM g")
def majority_reconcile(spark, sf):
    p = F.col("probability")
    hi, lo = F.count_if(p >= 0.5), F.count_if(p < 0.5)
    mean = F.when(hi > lo, F.avg(F.when(p >= 0.5, p))).otherwise(F.avg(F.when(p < 0.5, p)))
    return T.beliefs(spark, sf).groupBy("statement").agg(hi.alias("votes_for"), lo.alias("votes_against"), S.rounded(mean, 6).alias("probability"))


@query("a31_l_score", ctes("relations") + "SELECT from_id, round(exp(avg(ln(greatest(1e-10, least(1.0, greatest(0.0, confidence)))))) * avg(strength) / (1 + 0.1 * 2), 6) AS l_score FROM relations GROUP BY from_id")
def l_score(spark, sf, depth: int = 2):
    geo = F.exp(F.avg(F.log(F.greatest(F.lit(1e-10), S.clamp("confidence")))))
    return T.relations(spark, sf).groupBy("from_id").agg(S.rounded(geo * F.avg("strength") / (1 + 0.1 * depth), 6).alias("l_score"))


@query("a32_quality_penalty", ctes("relations") + "SELECT to_id, count(*) AS sources, round(exp(avg(ln(CASE WHEN confidence < 0.94 THEN 0.6 WHEN confidence < 0.96 THEN 0.8 ELSE 1.0 END))), 6) AS penalty FROM relations GROUP BY to_id")
def quality_penalty(spark, sf):
    each = F.when(F.col("confidence") < 0.94, 0.6).when(F.col("confidence") < 0.96, 0.8).otherwise(1.0)
    return T.relations(spark, sf).groupBy("to_id").agg(rows().alias("sources"), S.rounded(F.exp(F.avg(F.log(each))), 6).alias("penalty"))


@query("a33_schedule_summary", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2")
def schedule_summary(spark, sf):
    return T.base(spark, sf, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(rows().alias("n"))


@query("a34_attack_summary", ctes("actions") + "SELECT action_type, CAST(executed_at AS DATE) AS day, count(*) AS n FROM actions WHERE executed_at >= (SELECT max(executed_at) FROM actions) - INTERVAL 7 DAY GROUP BY 1, 2")
def attack_summary(spark, sf):
    return _window(spark, sf, 24 * 7).groupBy("action_type", F.to_date("executed_at").alias("day")).agg(rows().alias("n"))


@query("a35_sharpening_statistics", ctes("feedback") + "SELECT source, CAST(sum(success) AS BIGINT) AS good, CAST(sum(CASE WHEN success = 0 AND toxic = 1 THEN 1 ELSE 0 END) AS BIGINT) AS bad_toxic, round(avg(toxic), 6) AS toxicity FROM feedback GROUP BY source")
def sharpening_statistics(spark, sf):
    return T.feedback(spark, sf).groupBy("source").agg(F.sum("success").alias("good"), F.count_if((F.col("success") == 0) & (F.col("toxic") == 1)).alias("bad_toxic"), S.rounded(F.avg("toxic"), 6).alias("toxicity"))


@query("a36_transition_matrix", ctes("actions") + ", t AS (SELECT action_type, lead(action_type) OVER (PARTITION BY agent_id ORDER BY executed_at, action_id) AS nxt FROM actions) SELECT action_type, CAST(count(*) FILTER (nxt = 'click') AS BIGINT) AS click, CAST(count(*) FILTER (nxt = 'error') AS BIGINT) AS error, CAST(count(*) FILTER (nxt = 'purchase') AS BIGINT) AS purchase, CAST(count(*) FILTER (nxt = 'signup') AS BIGINT) AS signup, CAST(count(*) FILTER (nxt = 'view') AS BIGINT) AS view FROM t WHERE nxt IS NOT NULL GROUP BY action_type")
def transition_matrix(spark, sf):
    w = Window.partitionBy("agent_id").orderBy("executed_at", "action_id")
    t = T.actions(spark, sf).withColumn("nxt", F.lead("action_type").over(w)).where("nxt IS NOT NULL")
    return t.groupBy("action_type").pivot("nxt", ["click", "error", "purchase", "signup", "view"]).agg(rows()).na.fill(0)


@query("a37_tier_cache", ctes("actions") + "SELECT action_type, context, agent_id % 3 AS tier, count(*) AS n, round(sum(success_score), 6) AS total, round(avg(success_score), 6) AS mean FROM actions GROUP BY 1, 2, 3")
def tier_cache(spark, sf):
    return T.actions(spark, sf).groupBy("action_type", "context", (F.col("agent_id") % 3).alias("tier")).agg(rows().alias("n"), S.rounded(F.sum("success_score"), 6).alias("total"), S.rounded(F.avg("success_score"), 6).alias("mean"))


@query("a38_fitness_summary", ctes("actions") + ", v AS (SELECT action_type, k, count(*) AS n, avg(success_score) AS m FROM actions GROUP BY 1, 2), f AS (SELECT action_type, m * least(1.0, n / 20) + 0.5 * (1 - least(1.0, n / 20)) AS x FROM v) SELECT action_type, round(avg(x), 6) AS mean, round(max(x), 6) AS best, round(min(x), 6) AS worst FROM f GROUP BY 1")
def fitness_summary(spark, sf):
    v = T.actions(spark, sf).groupBy("action_type", "k").agg(rows().alias("n"), F.avg("success_score").alias("m"))
    return v.withColumn("x", S.fitness("m", "n")).groupBy("action_type").agg(S.rounded(F.avg("x"), 6).alias("mean"), S.rounded(F.max("x"), 6).alias("best"), S.rounded(F.min("x"), 6).alias("worst"))


@query("a39_reversal_session", ctes("actions") + ", s AS (SELECT agent_id, avg(CASE WHEN success_score >= 0.5 THEN 1.0 ELSE 0.0 END) AS acc, avg(least(success_score, 1.0)) AS ratio, stddev_pop(success_score) AS sd FROM actions GROUP BY agent_id) SELECT agent_id, round(0.4 * acc + 0.4 * ratio + 0.2 * greatest(0.0, 1 - sd), 6) AS score FROM s")
def reversal_session(spark, sf):
    s = F.col("success_score")
    blend = 0.4 * F.avg(F.when(s >= 0.5, 1.0).otherwise(0.0)) + 0.4 * F.avg(F.least(s, F.lit(1.0))) + 0.2 * F.greatest(F.lit(0.0), 1 - F.stddev_pop(s))
    return T.actions(spark, sf).groupBy("agent_id").agg(S.rounded(blend, 6).alias("score"))


@query("a40_confusion_metrics", ctes("feedback") + ", c AS (SELECT count(*) FILTER (success = 1 AND toxic = 0) AS tp, count(*) FILTER (success = 0 AND toxic = 0) AS fp, count(*) FILTER (success = 1 AND toxic = 1) AS fn, count(*) FILTER (success = 0 AND toxic = 1) AS tn FROM feedback) SELECT CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, CAST(tn AS BIGINT) AS tn, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM c")
def confusion_metrics(spark, sf):
    good, clean = F.col("success") == 1, F.col("toxic") == 0
    c = T.feedback(spark, sf).agg(F.count_if(good & clean).alias("tp"), F.count_if(~good & clean).alias("fp"), F.count_if(good & ~clean).alias("fn"), F.count_if(~good & ~clean).alias("tn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return c.withColumns({"precision": S.rounded(F.try_divide(tp, tp + fp), 6), "recall": S.rounded(F.try_divide(tp, tp + fn), 6), "f1": S.rounded(F.try_divide(2 * tp, 2 * tp + fp + fn), 6)})


@query("a41_source_rankings", ctes("feedback") + "SELECT source, count(*) AS n, round((sum(success) + 1) / (count(*) + 2), 6) AS reliability FROM feedback GROUP BY source HAVING count(*) >= 5")
def source_rankings(spark, sf, least: int = 5):
    g = T.feedback(spark, sf).groupBy("source").agg(rows().alias("n"), F.sum("success").alias("s")).where(F.col("n") >= least)
    return g.select("source", "n", S.rounded(S.laplace("s", "n"), 6).alias("reliability"))


@query("a43_session_summary", "SELECT conv_id, count(*) AS turns, CAST(count(*) FILTER (role = 'user') AS BIGINT) AS user_turns, (SELECT string_agg(CAST(turn AS VARCHAR), ',' ORDER BY turn) FROM (SELECT turn FROM conversations d WHERE d.conv_id = c.conv_id AND d.role = 'user' ORDER BY turn DESC LIMIT 3)) AS last_users FROM conversations c GROUP BY conv_id")
def session_summary(spark, sf):
    users = F.sort_array(F.collect_list(F.when(F.col("role") == "user", F.col("turn"))))
    last = F.slice(users, F.greatest(F.lit(1), F.size(users) - 2), F.lit(3))
    g = T.base(spark, sf, "conversations").groupBy("conv_id").agg(rows().alias("turns"), F.count_if(F.col("role") == "user").alias("user_turns"), last.alias("l"))
    return g.select("conv_id", "turns", "user_turns", F.when(F.size("l") > 0, F.array_join(F.transform("l", lambda x: x.cast("string")), ",")).alias("last_users"))


@query("a44_index_status", "SELECT n_name, count(c_custkey) AS files, CAST(coalesce(sum(CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END), 0) AS BIGINT) AS failed, max(c_acctbal) AS newest FROM nation LEFT JOIN customer ON n_nationkey = c_nationkey GROUP BY n_name")
def index_status(spark, sf):
    n, c = T.base(spark, sf, "nation"), T.base(spark, sf, "customer")
    return n.join(c, n.n_nationkey == c.c_nationkey, "left").groupBy("n_name").agg(F.count("c_custkey").alias("files"), F.count_if(F.col("c_acctbal") < 0).alias("failed"), F.max("c_acctbal").alias("newest"))


@query("a45_activation_stats", ctes("actions") + "SELECT count(*) AS n, round(avg(success_score), 6) AS mean, max(success_score) AS hi, max(executed_at) AS last FROM actions")
def activation_stats(spark, sf):
    return T.actions(spark, sf).agg(rows().alias("n"), S.rounded(F.avg("success_score"), 6).alias("mean"), F.max("success_score").alias("hi"), F.max("executed_at").alias("last"))


@query("w01_causal_discovery", ctes("actions") + ", t AS (SELECT action_type AS a, success_score AS s, lead(action_type) OVER w AS b, lead(success_score) OVER w AS s2 FROM actions WINDOW w AS (PARTITION BY agent_id ORDER BY executed_at, action_id)) SELECT a || '->' || b AS pattern, count(*) AS n, round(least(0.5 + 0.1 * count(*), 0.95), 6) AS confidence FROM t WHERE b IS NOT NULL AND (s + s2) / 2 >= 0.6 GROUP BY 1 HAVING count(*) >= 2")
def causal_discovery(spark, sf, least: float = 0.6):
    w = Window.partitionBy("agent_id").orderBy("executed_at", "action_id")
    t = T.actions(spark, sf).select("action_type", "success_score", F.lead("action_type").over(w).alias("b"), F.lead("success_score").over(w).alias("s2"))
    t = t.where(F.col("b").isNotNull() & ((F.col("success_score") + F.col("s2")) / 2 >= least))
    return t.groupBy(F.concat_ws("->", "action_type", "b").alias("pattern")).agg(rows().alias("n")).where("n >= 2").withColumn("confidence", S.rounded(F.least(0.5 + F.col("n") * 0.1, F.lit(0.95)), 6))


@query("w02_causal_relationships", ctes("actions") + ", t AS (SELECT action_id, action_type, executed_at, lead(action_type) OVER w AS b, lead(executed_at) OVER w AS t2 FROM actions WINDOW w AS (PARTITION BY agent_id ORDER BY executed_at, action_id)) SELECT action_id, action_type, b AS next_type, (epoch_us(t2) - epoch_us(executed_at)) / 1000000.0::DOUBLE AS seconds FROM t WHERE action_type = 'error' AND b = 'purchase'")
def causal_relationships(spark, sf):
    w = Window.partitionBy("agent_id").orderBy("executed_at", "action_id")
    t = T.actions(spark, sf).withColumns({"next_type": F.lead("action_type").over(w), "t2": F.lead("executed_at").over(w)})
    return t.where("action_type = 'error' AND next_type = 'purchase'").select("action_id", "action_type", "next_type", S.seconds_between("t2", "executed_at").alias("seconds"))


@query("w03_knowledge_evolution", ctes("actions") + ", t AS (SELECT agent_id, success_score - lag(success_score) OVER (PARTITION BY agent_id ORDER BY executed_at, action_id) AS d, count(*) OVER (PARTITION BY agent_id) AS n FROM actions) SELECT agent_id, round(avg(d), 6) AS velocity, CASE WHEN avg(d) > 0.005 THEN 'growing' WHEN avg(d) < -0.005 THEN 'declining' ELSE 'stable' END AS trend FROM t WHERE n >= 3 GROUP BY agent_id")
def knowledge_evolution(spark, sf):
    w = Window.partitionBy("agent_id").orderBy("executed_at", "action_id")
    t = T.actions(spark, sf).withColumn("d", F.col("success_score") - F.lag("success_score").over(w))
    g = t.groupBy("agent_id").agg(rows().alias("n"), F.avg("d").alias("v")).where("n >= 3")
    return g.select("agent_id", S.rounded("v", 6).alias("velocity"), F.when(F.col("v") > 0.005, "growing").when(F.col("v") < -0.005, "declining").otherwise("stable").alias("trend"))


@query("w05_flexibility_trend", ctes("actions") + ", t AS (SELECT agent_id, success_score AS s, ntile(2) OVER (PARTITION BY agent_id ORDER BY executed_at DESC, action_id DESC) AS h FROM actions) SELECT agent_id, round(avg(s) FILTER (h = 1) - avg(s) FILTER (h = 2), 6) AS change FROM t GROUP BY agent_id")
def flexibility_trend(spark, sf):
    w = Window.partitionBy("agent_id").orderBy(F.desc("executed_at"), F.desc("action_id"))
    t = T.actions(spark, sf).withColumn("h", F.ntile(2).over(w))
    half = lambda k: F.avg(F.when(F.col("h") == k, F.col("success_score")))
    return t.groupBy("agent_id").agg(S.rounded(half(1) - half(2), 6).alias("change"))


@query("w06_metric_history", ctes("actions") + ", t AS (SELECT agent_id, action_type, success_score AS s, row_number() OVER (PARTITION BY agent_id ORDER BY executed_at DESC, action_id DESC) AS rn, lag(success_score) OVER (PARTITION BY agent_id ORDER BY executed_at, action_id) AS p FROM actions) SELECT agent_id, rn, CASE WHEN p IS NULL THEN 'new' WHEN s > p * 1.05 THEN 'improving' WHEN s < p * 0.95 THEN 'declining' ELSE 'stable' END AS trend FROM t WHERE rn <= 100")
def metric_history(spark, sf, keep: int = 100):
    w = Window.partitionBy("agent_id").orderBy("executed_at", "action_id")
    d = Window.partitionBy("agent_id").orderBy(F.desc("executed_at"), F.desc("action_id"))
    t = T.actions(spark, sf).withColumns({"p": F.lag("success_score").over(w), "rn": F.row_number().over(d).cast("long")}).where(F.col("rn") <= keep)
    s, p = F.col("success_score"), F.col("p")
    return t.select("agent_id", "rn", F.when(p.isNull(), "new").when(s > p * 1.05, "improving").when(s < p * 0.95, "declining").otherwise("stable").alias("trend"))


@query("w07_current_state", ctes("actions") + "SELECT agent_id, action_id, action_type FROM (SELECT *, rank() OVER (PARTITION BY agent_id ORDER BY executed_at DESC) AS r FROM actions) WHERE r = 1")
def current_state(spark, sf):
    a = T.actions(spark, sf)
    last = a.groupBy("agent_id").agg(F.max("executed_at").alias("executed_at"))
    return a.join(last, ["agent_id", "executed_at"]).select("agent_id", "action_id", "action_type")


@query("w08_session_chain", ctes("sessions", recursive=True) + ", s AS (SELECT agent_id, session_id AS start FROM sessions QUALIFY row_number() OVER (PARTITION BY agent_id ORDER BY started DESC, session_id DESC) = 1), r(start, place, id) AS (SELECT start, 0, start FROM s UNION ALL SELECT start, place + 1, previous_session_id FROM r JOIN sessions ON session_id = id WHERE place < 4 AND previous_session_id IN (SELECT session_id FROM sessions)) SELECT agent_id, place, session_id, started, actions FROM r JOIN sessions ON session_id = id")
def session_chain(spark, sf, depth: int = 5):
    """Each agent's newest session and those before it, along their links, ``depth`` at most."""
    s = storage.staged(T.sessions(spark, sf), "sessions")
    newest = s.groupBy("agent_id").agg(F.max(F.struct("started", "session_id")).alias("m")).select(F.col("m.session_id").alias("id"))
    c = G.chain_back(s.select(F.col("session_id").alias("id"), F.col("previous_session_id").alias("previous")), newest, depth)
    return c.join(s.withColumnRenamed("session_id", "id"), "id").select("agent_id", "place", F.col("id").alias("session_id"), "started", "actions")


@query("w09_convergence", ctes("actions") + ", d AS (SELECT k % 10 AS depth, avg(success_score) AS m FROM actions GROUP BY 1), l AS (SELECT depth, m, lag(m) OVER (ORDER BY depth) AS p FROM d) SELECT count(*) AS depths, count(*) >= 2 AND bool_and(p IS NULL OR m <= 0.5 * p) AS converged FROM l")
def convergence(spark, sf):
    d = T.actions(spark, sf).groupBy((F.col("k") % 10).alias("depth")).agg(F.avg("success_score").alias("m"))
    l = d.withColumn("p", F.lag("m").over(Window.orderBy("depth")))  # ten rows at most
    return l.agg(rows().alias("depths"), ((rows() >= 2) & F.bool_and(F.col("p").isNull() | (F.col("m") <= F.col("p") * 0.5))).alias("converged"))
