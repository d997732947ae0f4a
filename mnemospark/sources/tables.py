"""Logical tables of the memory engine, derived from the base tables, and the same derivations as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mnemospark.functions.scores import rounded


def base(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_of(df: DataFrame, ts: str = "ts"):
    """The newest timestamp: the engine's clock, so that results don't depend on when a query runs."""
    return df.agg(F.max(ts)).first()[0]


def actions(spark, sf_dir) -> DataFrame:
    e = base(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    return e.select(F.col("event_id").alias("action_id"), F.col("user_id").alias("agent_id"), F.col("event_type").alias("action_type"), k.alias("k"), F.concat(F.lit("k"), k.cast("string")).alias("context"), F.least(F.lit(1.0), F.col("value") / 100.0).alias("success_score"), F.col("ts").alias("executed_at"))


def entities(spark, sf_dir) -> DataFrame:
    d = base(spark, sf_dir, "documents")
    tier = F.element_at(F.array(*map(F.lit, ("core", "working", "episodic", "semantic"))), (F.col("doc_id") % 4 + 1).cast("int"))
    created = F.expr("TIMESTAMP_NTZ'2024-01-01 00:00:00' + make_dt_interval(0, 0, cast(doc_id % 500000 as int))")
    return d.select(F.col("doc_id").alias("id"), F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("name"), F.col("source").alias("entity_type"), F.col("text").alias("content"), (F.col("n_chars") % 50).alias("access_count"), tier.alias("tier"), created.alias("created_at"), (F.col("doc_id") * 37 % 101 / 100.0).alias("importance"), "lang")


def observations(spark, sf_dir) -> DataFrame:
    """One row a line of an entity's text."""
    d = base(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("entity_id"), F.posexplode(F.split("text", "\n")).alias("seq", "content"))


def vectors(spark, sf_dir) -> DataFrame:
    """Embeddings in double precision."""
    return base(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"), "label")


def relations(spark, sf_dir) -> DataFrame:
    g = base(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("from_id"), (F.col("l_partkey") + 1000000000).alias("to_id"))
    r = g.agg(rounded(F.avg("l_quantity") / 50, 6).alias("strength"), rounded(1 - F.avg("l_discount"), 6).alias("confidence"), F.min("l_shipdate").alias("valid_from"), F.when(F.count(F.lit(1)) > 1, F.max("l_shipdate")).alias("valid_until"))
    kind = F.element_at(F.array(*map(F.lit, ("causes", "leads_to", "related_to", "part_of"))), (F.col("to_id") % 4 + 1).cast("int"))
    return r.withColumn("relation_type", kind)


def _steps(spark, sf_dir) -> DataFrame:
    w = Window.partitionBy("agent_id").orderBy("executed_at", "action_id")
    return actions(spark, sf_dir).withColumn("k2", F.lead("k").over(w)).where("k2 IS NOT NULL AND k <> k2")


def causal_links(spark, sf_dir) -> DataFrame:
    n = F.count(F.lit(1))
    return _steps(spark, sf_dir).groupBy(F.col("k").alias("cause_id"), F.col("k2").alias("effect_id")).agg(n.alias("evidence_count"), F.least(F.lit(1.0), rounded(n * 0.2, 6)).alias("strength"))


def associations(spark, sf_dir) -> DataFrame:
    n = F.count(F.lit(1))
    return _steps(spark, sf_dir).groupBy(F.least("k", "k2").alias("a_id"), F.greatest("k", "k2").alias("b_id")).agg(n.alias("co_activation_count"), F.least(F.lit(1.0), rounded(n * 0.1, 6)).alias("strength"))


def chains(spark, sf_dir) -> DataFrame:
    """Each agent's causal chain: what follows what, repeats included, and how well it went."""
    w = Window.partitionBy("agent_id").orderBy("executed_at", "action_id")
    steps = actions(spark, sf_dir).select("agent_id", F.col("k").alias("a"), F.lead("k").over(w).alias("b"), F.lead("success_score").over(w).alias("s")).where("b IS NOT NULL")
    return steps.groupBy("agent_id", "a", "b").agg(F.count(F.lit(1)).alias("evidence_count"), rounded(F.avg("s"), 6).alias("strength"))


def sessions(spark, sf_dir, hours: int = 12) -> DataFrame:
    """Each agent's sessions, cut where it pauses for more than ``hours``; known by their first action and linked to the one before."""
    w = Window.partitionBy("agent_id").orderBy("executed_at", "action_id")
    a = actions(spark, sf_dir).select("agent_id", "action_id", "executed_at", (F.col("executed_at") - F.lag("executed_at").over(w) > F.expr(f"INTERVAL {hours} HOUR")).cast("int").alias("cut"))
    a = a.withColumn("part", F.sum(F.coalesce("cut", F.lit(0))).over(w))
    s = a.groupBy("agent_id", "part").agg(F.min(F.struct("executed_at", "action_id")).alias("first"), F.count(F.lit(1)).alias("actions"))
    back = F.lag("first.action_id").over(Window.partitionBy("agent_id").orderBy("part"))
    return s.select("agent_id", F.col("first.action_id").alias("session_id"), back.alias("previous_session_id"), F.col("first.executed_at").alias("started"), "actions")


def beliefs(spark, sf_dir) -> DataFrame:
    return actions(spark, sf_dir).groupBy("agent_id", F.col("action_type").alias("statement")).agg(rounded(F.avg("success_score"), 6).alias("probability"), F.sum(F.when(F.col("success_score") >= 0.5, 1).otherwise(-1)).alias("evidence_balance"))


def feedback(spark, sf_dir) -> DataFrame:
    """Outcome of each labelled document, by source."""
    labels, docs = base(spark, sf_dir, "labels"), base(spark, sf_dir, "documents")
    return labels.join(docs.select("doc_id", "source"), "doc_id").select("doc_id", "source", F.col("quality").cast("long").alias("success"), F.col("toxic").cast("long").alias("toxic"))


def versions(spark, sf_dir) -> DataFrame:
    o = base(spark, sf_dir, "orders")
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return o.select(F.col("o_custkey").alias("entity_id"), F.row_number().over(w).cast("long").alias("version"), F.concat_ws(":", "o_orderstatus", "o_orderpriority").alias("data"), F.col("o_totalprice").alias("price"), F.col("o_orderdate").alias("created_at"))


#: The same tables in DuckDB's SQL.
SQL = {
    "actions": "actions AS (SELECT event_id AS action_id, user_id AS agent_id, event_type AS action_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k, 'k' || CAST(json_extract(props, '$.k') AS VARCHAR) AS context, least(1.0, value / 100.0) AS success_score, ts AS executed_at FROM events)",
    "entities": "entities AS (SELECT doc_id AS id, 'doc_' || doc_id AS name, source AS entity_type, text AS content, n_chars % 50 AS access_count, CASE doc_id % 4 WHEN 0 THEN 'core' WHEN 1 THEN 'working' WHEN 2 THEN 'episodic' ELSE 'semantic' END AS tier, TIMESTAMP '2024-01-01' + to_minutes(doc_id % 500000) AS created_at, (doc_id * 37 % 101) / 100.0 AS importance, lang FROM documents)",
    "observations": "observations AS (SELECT doc_id AS entity_id, i - 1 AS seq, l[i] AS content FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)))",
    "vectors": "vectors AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings)",
    "relations": "relations AS (SELECT l_suppkey AS from_id, l_partkey + 1000000000 AS to_id, round(avg(l_quantity) / 50, 6) AS strength, round(1 - avg(l_discount), 6) AS confidence, min(l_shipdate) AS valid_from, CASE WHEN count(*) > 1 THEN max(l_shipdate) END AS valid_until, CASE (l_partkey + 1000000000) % 4 WHEN 0 THEN 'causes' WHEN 1 THEN 'leads_to' WHEN 2 THEN 'related_to' ELSE 'part_of' END AS relation_type FROM lineitem GROUP BY l_suppkey, l_partkey)",
    "steps": "steps AS (SELECT * FROM (SELECT *, lead(k) OVER (PARTITION BY agent_id ORDER BY executed_at, action_id) AS k2 FROM actions) WHERE k2 IS NOT NULL AND k <> k2)",
    "causal_links": "causal_links AS (SELECT k AS cause_id, k2 AS effect_id, count(*) AS evidence_count, least(1.0, round(count(*) * 0.2, 6)) AS strength FROM steps GROUP BY k, k2)",
    "associations": "associations AS (SELECT least(k, k2) AS a_id, greatest(k, k2) AS b_id, count(*) AS co_activation_count, least(1.0, round(count(*) * 0.1, 6)) AS strength FROM steps GROUP BY 1, 2)",
    "chains": "chains AS (SELECT agent_id, a, b, count(*) AS evidence_count, round(avg(s), 6) AS strength FROM (SELECT agent_id, k AS a, lead(k) OVER w AS b, lead(success_score) OVER w AS s FROM actions WINDOW w AS (PARTITION BY agent_id ORDER BY executed_at, action_id)) WHERE b IS NOT NULL GROUP BY 1, 2, 3)",
    "sessions": "sessions AS (SELECT agent_id, session_id, lag(session_id) OVER (PARTITION BY agent_id ORDER BY part) AS previous_session_id, started, actions FROM (SELECT agent_id, part, first(action_id ORDER BY executed_at, action_id) AS session_id, min(executed_at) AS started, count(*) AS actions FROM (SELECT *, sum(CASE WHEN gap > INTERVAL 12 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY agent_id ORDER BY executed_at, action_id) AS part FROM (SELECT *, executed_at - lag(executed_at) OVER (PARTITION BY agent_id ORDER BY executed_at, action_id) AS gap FROM actions)) GROUP BY 1, 2))",
    "beliefs": "beliefs AS (SELECT agent_id, action_type AS statement, round(avg(success_score), 6) AS probability, CAST(sum(CASE WHEN success_score >= 0.5 THEN 1 ELSE -1 END) AS BIGINT) AS evidence_balance FROM actions GROUP BY 1, 2)",
    "feedback": "feedback AS (SELECT doc_id, source, CAST(quality AS BIGINT) AS success, CAST(toxic AS BIGINT) AS toxic FROM labels JOIN documents USING (doc_id))",
    "versions": "versions AS (SELECT o_custkey AS entity_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS version, concat_ws(':', o_orderstatus, o_orderpriority) AS data, o_totalprice AS price, o_orderdate AS created_at FROM orders)",
}
_NEEDS = {"steps": ["actions"], "chains": ["actions"], "sessions": ["actions"], "causal_links": ["steps"], "associations": ["steps"], "beliefs": ["actions"]}


def ctes(*names: str, recursive: bool = False) -> str:
    """A WITH clause that defines the tables and what they need."""
    out: list[str] = []

    def add(name: str) -> None:
        for n in _NEEDS.get(name, []):
            add(n)
        if SQL[name] not in out:
            out.append(SQL[name])

    for name in names:
        add(name)
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(out)
