"""Decay, scoring, statistics, learners and composite plans."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from mnemospark.functions import scores as S
from mnemospark.functions import text as X
from mnemospark.operators import analytics as A
from mnemospark.operators import equations as E
from mnemospark.operators import learning as L
from mnemospark.operators.topk import ranked
from mnemospark.plans.registry import query
from mnemospark.sources import tables as T
from mnemospark.sources.tables import ctes


def rows():
    return F.count(F.lit(1))
ORDER = ["executed_at", "action_id"]
AGE = ctes("actions") + ", n AS (SELECT max(executed_at) AS now FROM actions), t AS (SELECT *, (epoch_us(now) - epoch_us(executed_at)) / 3600000000.0::DOUBLE AS h FROM actions, n)"


def _aged(spark, sf):
    a = T.actions(spark, sf)
    return a.withColumn("h", S.hours_between(F.lit(T.as_of(a, "executed_at")), "executed_at"))


@query("d01_decay", AGE + " SELECT action_id, round(success_score * exp(-0.01 * h), 6) AS strength FROM t")
def decay(spark, sf):
    return _aged(spark, sf).select("action_id", S.rounded(S.decayed("success_score", 0.01, "h")).alias("strength"))


@query("d02_forgetting", AGE + " SELECT action_id, round(exp(-0.02 * h), 6) AS retention FROM t")
def forgetting(spark, sf):
    return _aged(spark, sf).select("action_id", S.rounded(S.retention_curve(0.02, "h")).alias("retention"))


@query("d03_boost", ctes("actions") + "SELECT action_id, round(least(1.0, success_score + 0.2), 6) AS strength FROM actions")
def boost(spark, sf):
    return T.actions(spark, sf).select("action_id", S.rounded(S.boosted("success_score", 0.2)).alias("strength"))


@query("d04_retention", AGE + " SELECT action_id, round(0.4 * success_score + least(0.3, 0.02 * k) + 0.2 * exp(-0.01 * h / 24) + CASE action_type WHEN 'purchase' THEN 0.1 ELSE 0 END, 6) AS score FROM t")
def retention(spark, sf):
    return _aged(spark, sf).select("action_id", S.rounded(S.retention_score("success_score", "k", F.col("h") / 24, F.when(F.col("action_type") == "purchase", 0.1).otherwise(0.0))).alias("score"))


def fold_sql(key: str, start: dict[str, str], step: dict[str, str], extra: str = "") -> str:
    """SQL of a fold over each key's rows in order: ``f`` has the last state of each.

    A step's expressions read the state before (r.name) and the row (a.x and ``extra``).
    """
    rows = f"a AS (SELECT {key} AS key, success_score AS x{extra}, row_number() OVER (PARTITION BY {key} ORDER BY executed_at, action_id) AS i FROM actions)"
    first = ", ".join(f"{v} AS {k}" for k, v in start.items())
    then = ", ".join(step[k] for k in start)
    fold = f"r AS (SELECT DISTINCT key, 0::BIGINT AS i, {first} FROM a UNION ALL SELECT r.key, r.i + 1, {then} FROM r JOIN a ON a.key = r.key AND a.i = r.i + 1)"
    return ctes("actions", recursive=True) + f", {rows}, {fold}, f AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY key ORDER BY i DESC) = 1) "


_RAW = "(0.5 * least(1.0, 2 * CASE WHEN r.n > 0 THEN abs(a.x - r.mean) ELSE 1.0 END) + 0.3 * a.x + 0.2 * (1.0::DOUBLE / (1 + r.n)))"
_MOMENTUM = f"CASE WHEN r.n = 0 THEN {_RAW} ELSE 0.7 * r.momentum + 0.3 * {_RAW} END"
SURPRISE = fold_sql(
    "agent_id",
    {"n": "0::BIGINT", "mean": "0.0::DOUBLE", "momentum": "0.0::DOUBLE", "promoted": "0::BIGINT"},
    {"n": "r.n + 1", "mean": "r.mean + (a.x - r.mean) / (r.n + 1)", "momentum": _MOMENTUM, "promoted": f"r.promoted + CASE WHEN {_MOMENTUM} >= 0.3 + 0.1 * least(1.0, r.n::DOUBLE / 50) THEN 1 ELSE 0 END"},
)


@query("d05_surprise", SURPRISE + "SELECT key AS agent_id, n, promoted, round(momentum, 6) AS momentum FROM f")
def surprise(spark, sf):
    return L.surprise(T.actions(spark, sf), "agent_id", ORDER).withColumn("momentum", S.rounded("momentum"))


#: Turns as memories, six hours from one to the next.
MEMORIES = """, m AS (SELECT conv_id, turn, text, TIMESTAMP '2024-01-01' + to_hours(6 * turn) AS made FROM conversations),
n AS (SELECT max(made) AS now FROM m),
x AS (SELECT conv_id, turn, made, now, round(SALIENCE, 6) AS salience, list_distinct(list_filter(string_split_regex(lower(text), '\\s+'), lambda w: w <> '')) AS w, list_distinct(list_filter(string_split_regex(lower(substr(text, 1, 100)), '\\s+'), lambda w: w <> '')) AS b FROM m, n WHERE made > now - INTERVAL 24 HOUR),
t AS (SELECT *, coalesce(list(b) OVER (PARTITION BY conv_id ORDER BY made, turn ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), []) AS topics, row_number() OVER (PARTITION BY conv_id ORDER BY made, turn) AS i FROM x),
s AS (SELECT *, list_transform(topics, lambda z: len(list_intersect(b, z))::DOUBLE / len(list_distinct(list_concat(b, z)))) AS alike, list_sum(list_transform(topics, lambda z: len(list_intersect(w, z))))::DOUBLE / len(topics) AS shared FROM t),
a AS (SELECT conv_id, turn, made, now, i, round(0.5 * coalesce(1 - list_max(alike), 1.0) * CASE WHEN len(list_filter(alike, lambda y: y > 0.8)) >= 5 THEN 0.5 ELSE 1.0 END + 0.3 * salience + 0.2 * CASE WHEN len(topics) = 0 THEN 0.5 WHEN shared < 2 THEN 0.7 WHEN shared > 10 THEN 0.4 ELSE 0.5 END, 9) AS raw FROM s),
r(conv_id, i, momentum, followers, threshold, recent, score, promoted) AS (SELECT DISTINCT conv_id, 0::BIGINT, 0.5::DOUBLE, 0, 0.4::DOUBLE, []::DOUBLE[], 0.0::DOUBLE, false FROM a UNION ALL
  SELECT conv_id, i, 0.9::DOUBLE * momentum + (1 - 0.9::DOUBLE) * raw, CASE WHEN sc >= 0.7 THEN 3 WHEN followers > 0 THEN followers - 1 ELSE 0 END,
    CASE WHEN len(list_append(recent, sc)) < 10 THEN threshold WHEN list_avg(list_append(recent, sc)[-50:]) > 0.6 THEN least(0.7, threshold + 0.05) WHEN list_avg(list_append(recent, sc)[-50:]) < 0.3 THEN greatest(0.2, threshold - 0.05) ELSE threshold END,
    list_append(recent, sc)[-100:], sc, sc >= 0.8 OR sc >= CASE WHEN followers > 0 THEN threshold * 0.7 ELSE threshold END OR (sc < 0.7 AND followers > 0)
  FROM (SELECT r.conv_id, a.i, momentum, followers, threshold, recent, raw, CASE WHEN raw - momentum > 0.1 THEN least(1.0, raw * 1.3) WHEN raw - momentum < -0.1 THEN raw * 0.95 ELSE raw END::DOUBLE AS sc FROM r JOIN a ON a.conv_id = r.conv_id AND a.i = r.i + 1)),
j AS (SELECT a.conv_id, turn, made, now, score, promoted FROM a JOIN r USING (conv_id, i)),
f AS (SELECT conv_id, turn, row_number() OVER (ORDER BY round(0.4 * score + 0.2 * exp(-0.01 * floor((epoch(now) - epoch(made)) / 86400)) + 0.1, 9), conv_id, turn) <= (SELECT count(*) - 150 FROM j WHERE promoted) AS gone FROM j WHERE promoted)
SELECT conv_id, turn, round(score, 6) AS score, CASE WHEN gone THEN 'forgotten' WHEN promoted THEN 'promoted' ELSE 'skipped' END AS verdict FROM j LEFT JOIN f USING (conv_id, turn)"""


def _salience_sql() -> str:
    terms = " + ".join(f"CASE WHEN contains(lower(text), '{w}') THEN 1 ELSE 0 END" for w in X.SALIENT)
    return f"least(1.0, greatest(0.0, 0.5 + CASE WHEN length(text) BETWEEN 100 AND 500 THEN 0.1 WHEN length(text) > 1000 THEN -0.1 ELSE 0 END + least(0.3, 0.05 * ({terms})) + CASE WHEN regexp_matches(text, '```|- |1\\.|\\* ') THEN 0.1 ELSE 0 END))"


@query("d06_consolidation", "WITH RECURSIVE z AS (SELECT 1)" + MEMORIES.replace("SALIENCE", _salience_sql()))
def consolidation(spark, sf, hours: int = 24, most: int = 150):
    """The last day's memories of every conversation: promoted, skipped, or forgotten by the retention gate."""
    at = F.expr("TIMESTAMP_NTZ'2024-01-01 00:00:00' + make_dt_interval(0, cast(6 * turn as int))")
    m = T.base(spark, sf, "conversations").select("conv_id", F.col("turn").alias("id"), "text", at.alias("at"), S.rounded(X.salience("text", F.lit("episodic")), 6).alias("salience"))
    return L.consolidated_memories(m, "conv_id", hours, most).select("conv_id", F.col("id").alias("turn"), S.rounded("score").alias("score"), "verdict")


@query("d07_granularity", AGE + ", g AS (SELECT k, avg(success_score) AS imp, count(*) / 30.0 AS per_day, min(h) / 24 AS age, count(DISTINCT action_type) AS refs FROM t GROUP BY k), s AS (SELECT k, 0.35 * imp + 0.2 * least(1.0, per_day / 10) + 0.15 * exp(-age / 30) + CASE WHEN refs > 4 THEN 0.3 ELSE 0.1 END + 0.1 * least(1.0, refs / 10.0) AS s FROM g) SELECT k, round(s, 6) AS score, CASE WHEN s >= 0.8 THEN 'full' WHEN s >= 0.6 THEN 'detailed' WHEN s >= 0.4 THEN 'standard' WHEN s >= 0.2 THEN 'summary' ELSE 'minimal' END AS level FROM s")
def granularity(spark, sf):
    g = _aged(spark, sf).groupBy("k").agg(F.avg("success_score").alias("imp"), (rows() / 30.0).alias("per_day"), (F.min("h") / 24).alias("age"), F.countDistinct("action_type").alias("refs"))
    s = S.granularity("imp", "per_day", "age", F.col("refs") > 4, F.col("refs"))
    return g.select("k", s.alias("s")).select("k", S.rounded("s").alias("score"), S.granularity_level("s").alias("level"))


VARIANTS = ctes("actions") + ", v AS (SELECT action_type, k, count(*) AS n, avg(success_score) AS m, sum(CASE WHEN success_score >= 0.5 THEN 1 ELSE 0 END) AS s FROM actions GROUP BY 1, 2), f AS (SELECT *, m * least(1.0, n / 20) + 0.5 * (1 - least(1.0, n / 20)) AS fit FROM v)"


def _variants(spark, sf):
    v = T.actions(spark, sf).groupBy("action_type", "k").agg(rows().alias("n"), F.avg("success_score").alias("m"), F.count_if(F.col("success_score") >= 0.5).alias("s"))
    return v.withColumn("fit", S.fitness("m", "n"))


@query("d08_fitness", VARIANTS + " SELECT action_type, k, round(fit, 6) AS fitness FROM f")
def fitness(spark, sf):
    return _variants(spark, sf).select("action_type", "k", S.rounded("fit").alias("fitness"))


@query("d09_wilson_interval", VARIANTS + ", w AS (SELECT *, s * 1.0 / n AS p FROM f) SELECT action_type, k, round(greatest(0.0, (p + 3.8416 / (2 * n)) / (1 + 3.8416 / n) - 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4.0 * n * n)) / (1 + 3.8416 / n)), 6) AS low, round(least(1.0, (p + 3.8416 / (2 * n)) / (1 + 3.8416 / n) + 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4.0 * n * n)) / (1 + 3.8416 / n)), 6) AS high FROM w")
def wilson_interval(spark, sf):
    low, high = S.wilson("s", "n")
    return _variants(spark, sf).select("action_type", "k", S.rounded(low).alias("low"), S.rounded(high).alias("high"))


@query("d10_select_variant", VARIANTS + ", r AS (SELECT action_type, k, row_number() OVER (PARTITION BY action_type ORDER BY round(0.7 * fit + 0.3 * m, 9) DESC, k) AS rn FROM f) SELECT action_type, k FROM r WHERE rn = 1")
def select_variant(spark, sf):
    best = F.max(F.struct(F.round(F.col("fit") * 0.7 + F.col("m") * 0.3 + 1e-10, 9).alias("s"), (-F.col("k")).alias("k")))
    return _variants(spark, sf).groupBy("action_type").agg(best.alias("b")).select("action_type", (-F.col("b.k")).alias("k"))


@query("d11_affinity", fold_sql("context", {"s": "NULL::DOUBLE"}, {"s": "CASE WHEN r.s IS NULL THEN a.x ELSE 0.7 * r.s + 0.3 * a.x END"}) + "SELECT key AS context, round(s, 6) AS affinity FROM f")
def affinity(spark, sf):
    return L.affinity(T.actions(spark, sf), "context", ORDER).withColumn("affinity", S.rounded("affinity"))


@query("d12_evolution", VARIANTS + " SELECT CASE WHEN n >= 5 AND fit < 0.45 THEN 'prune' WHEN n >= 5 AND fit > 0.55 THEN 'mutate' ELSE 'keep' END AS action, count(*) AS variants FROM f GROUP BY 1")
def evolution(spark, sf):
    act = F.when((F.col("n") >= 5) & (F.col("fit") < 0.45), "prune").when((F.col("n") >= 5) & (F.col("fit") > 0.55), "mutate").otherwise("keep")
    return _variants(spark, sf).groupBy(act.alias("action")).agg(rows().alias("variants"))


BIAS = ctes("actions") + ", p AS (SELECT action_type, avg(success_score) FILTER (agent_id % 3 = 0) AS simple, avg(success_score) FILTER (agent_id % 3 = 1) AS balanced, avg(success_score) FILTER (agent_id % 3 = 2) AS complex, count(*) AS n FROM actions GROUP BY 1), b AS (SELECT action_type, n, (simple - (simple + balanced + complex) / 3) * 0.5 + CASE WHEN simple > 0.9 * complex THEN 0.1 ELSE 0 END AS s, (balanced - (simple + balanced + complex) / 3) * 0.5 AS m, (complex - (simple + balanced + complex) / 3) * 0.5 AS c FROM p)"


def _bias(spark, sf):
    p = T.actions(spark, sf).withColumn("tier", F.col("agent_id") % 3).groupBy("action_type").agg(*[F.avg(F.when(F.col("tier") == i, F.col("success_score"))).alias(t) for i, t in enumerate(("x", "y", "z"))], rows().alias("n"))
    mean = (F.col("x") + F.col("y") + F.col("z")) / 3
    return p.select("action_type", "n", ((F.col("x") - mean) * 0.5 + F.when(F.col("x") > F.col("z") * 0.9, 0.1).otherwise(0.0)).alias("s"), ((F.col("y") - mean) * 0.5).alias("m"), ((F.col("z") - mean) * 0.5).alias("c"))


@query("d13_learned_bias", BIAS + " SELECT action_type, round(s, 6) AS simple, round(m, 6) AS balanced, round(c, 6) AS complex FROM b")
def learned_bias(spark, sf):
    return _bias(spark, sf).select("action_type", S.rounded("s").alias("simple"), S.rounded("m").alias("balanced"), S.rounded("c").alias("complex"))


@query("d14_recommended_tier", BIAS + " SELECT action_type, CASE WHEN n < 3 THEN 'balanced' WHEN s >= m AND s >= c THEN 'simple' WHEN m >= c THEN 'balanced' ELSE 'complex' END AS tier, round(CASE WHEN n < 3 THEN 0.3 ELSE least(0.9, 0.3 + n / 50.0) END, 6) AS confidence FROM b")
def recommended_tier(spark, sf):
    s, m, c, n = (F.col(x) for x in "smcn")
    return _bias(spark, sf).select("action_type", F.when(n < 3, "balanced").when((s >= m) & (s >= c), "simple").when(m >= c, "balanced").otherwise("complex").alias("tier"), S.rounded(F.when(n < 3, 0.3).otherwise(F.least(F.lit(0.9), n / 50.0 + 0.3))).alias("confidence"))


@query("d15_q_values", fold_sql("context", {"q": "0.5::DOUBLE"}, {"q": "r.q + 0.1 / (1 + 0.01 * r.i) * (a.x - r.q)"}) + "SELECT key AS context, i AS n, round(q, 6) AS q FROM f")
def q_values(spark, sf):
    return L.q_values(T.actions(spark, sf), "context", ORDER).withColumn("q", S.rounded("q"))


@query("d16_boosted_scores", ctes("actions") + ", q AS (SELECT context, round(avg(success_score), 6) AS q FROM actions GROUP BY 1) SELECT action_id, round(least(1.0, greatest(0.0, success_score + (q - 0.5) * 0.4)), 6) AS score FROM actions JOIN q USING (context)")
def boosted_scores(spark, sf):
    a = T.actions(spark, sf)
    q = a.groupBy("context").agg(S.rounded(F.avg("success_score")).alias("q"))
    return a.join(q, "context").select("action_id", S.rounded(S.clamp(F.col("success_score") + (F.col("q") - 0.5) * 0.4)).alias("score"))


@query("d17_conformal_quantile", ctes("actions") + ", s AS (SELECT action_type, abs(success_score - 0.5) AS d FROM actions), r AS (SELECT action_type, d, row_number() OVER (PARTITION BY action_type ORDER BY d) AS rn, count(*) OVER (PARTITION BY action_type) AS n FROM s) SELECT action_type, d AS threshold FROM r WHERE rn = least(n, CAST(floor(n * 0.9) AS BIGINT) + 1)")
def conformal_quantile(spark, sf, q: float = 0.9):
    """The floor(n q)-th smallest nonconformity, by counting equal values instead of collecting a group."""
    s = T.actions(spark, sf).select("action_type", F.abs(F.col("success_score") - 0.5).alias("d"))
    c = s.groupBy("action_type", "d").agg(rows().alias("m"))
    w = Window.partitionBy("action_type").orderBy("d")
    total = c.groupBy("action_type").agg(F.sum("m").alias("n"))
    r = c.withColumn("upto", F.sum("m").over(w)).join(total, "action_type")
    place = F.least(F.col("n"), F.floor(F.col("n") * q) + 1)
    return r.where(F.col("upto") >= place).groupBy("action_type").agg(F.min("d").alias("threshold"))


@query("d18_uncertainty", ctes("beliefs") + "SELECT agent_id, statement, round(least(1.0, greatest(0.0, 1 - 2 * abs(probability - 0.5))), 6) AS uncertainty FROM beliefs")
def uncertainty(spark, sf):
    return T.beliefs(spark, sf).select("agent_id", "statement", S.rounded(S.uncertainty("probability")).alias("uncertainty"))


FISHER = fold_sql(
    "agent_id",
    {"fisher": "0.0::DOUBLE", "mean": "0.0::DOUBLE", "m2": "0.0::DOUBLE", "z": "0.0::DOUBLE"},
    {
        "fisher": "0.9 * r.fisher + 0.1 * a.x * a.x",
        "mean": "r.mean + (a.x - r.mean) / (r.i + 1)",
        "m2": "r.m2 + (a.x - r.mean) * (a.x - (r.mean + (a.x - r.mean) / (r.i + 1)))",
        "z": "CASE WHEN r.i > 1 AND r.m2 > 0 THEN greatest(r.z, abs(a.x - r.mean) / sqrt(r.m2 / (r.i - 1))) ELSE r.z END",
    },
)


@query("d19_fisher", FISHER + "SELECT key AS agent_id, round(fisher, 6) AS fisher, round(mean, 6) AS mean, round(m2 / greatest(1, i - 1), 6) AS variance, round(z, 6) AS max_z FROM f")
def fisher(spark, sf):
    f = L.fisher(T.actions(spark, sf), "agent_id", ORDER)
    return f.select("agent_id", *[S.rounded(c).alias(c) for c in ("fisher", "mean", "variance", "max_z")])


@query("d20_task_boundary", FISHER + "SELECT key AS agent_id, z > 2.0 AS boundary FROM f")
def task_boundary(spark, sf):
    return L.fisher(T.actions(spark, sf), "agent_id", ORDER).select("agent_id", (F.col("max_z") > 2.0).alias("boundary"))


@query("d21_ewc_loss", ctes("vectors") + ", m AS (SELECT v AS a FROM vectors WHERE id = 0) SELECT id, round(0.2 * list_sum(list_transform(list_zip(v, a), lambda z: abs(z[2]) * (z[1] - z[2]) * (z[1] - z[2]))), 6) AS loss FROM vectors, m")
def ewc_loss(spark, sf, strength: float = 0.4):
    a = F.array(*[F.lit(float(x)) for x in T.vectors(spark, sf).where("id = 0").first().v])
    each = F.zip_with("v", a, lambda w, o: F.abs(o) * (w - o) * (w - o))
    return T.vectors(spark, sf).select("id", S.rounded(F.aggregate(each, F.lit(0.0), lambda s, x: s + x) * (strength / 2)).alias("loss"))


def _claims(spark, sf):
    """Ten features of each action, between 0 and 1."""
    a = T.actions(spark, sf)
    return a.select("agent_id", *ORDER, "success_score", *[((F.col("k") * (2 * i + 1) + i) % 11 / 10.0).alias(f) for i, f in enumerate(L.FEATURES)])


_W = range(len(L.FEATURES))
_ERROR = "(1 / (1 + exp(-(r.b + " + " + ".join(f"r.w{i} * a.f{i}" for i in _W) + "))) - a.x)"
SGD = fold_sql(
    "agent_id",
    {"b": "0.5::DOUBLE"} | {f"w{i}": f"{w}::DOUBLE" for i, w in enumerate(L.FEATURES.values())},
    {"b": f"greatest(0.0, least(1.0, r.b - 0.01 * 2 * {_ERROR}))"} | {f"w{i}": f"greatest(-1.0, least(1.0, r.w{i} - 0.01 * 2 * {_ERROR} * a.f{i}))" for i in _W},
    "".join(f", (k * {2 * i + 1} + {i}) % 11 / 10.0::DOUBLE AS f{i}" for i in _W),
)


@query("d22_online_sgd", SGD + "SELECT key AS agent_id, i AS n, round(b, 6) AS bias, " + ", ".join(f"round(w{i}, 6) AS w_{f}" for i, f in enumerate(L.FEATURES)) + " FROM f")
def online_sgd(spark, sf):
    """The confidence model of each agent after its claims, one step a claim."""
    m = L.online_sgd(_claims(spark, sf), "agent_id", ORDER)
    return m.select("agent_id", "n", *[S.rounded(c).alias(c) for c in m.columns[2:]])


@query("d23_confidence", ctes("actions") + "SELECT action_id, round(1 / (1 + exp(-(0.1 + 0.8 * success_score - 0.3 * k / 100.0))), 6) AS confidence FROM actions")
def confidence(spark, sf):
    return T.actions(spark, sf).select("action_id", S.rounded(S.sigmoid(0.1 + F.col("success_score") * 0.8 - F.col("k") * 0.3 / 100.0)).alias("confidence"))


_CDF = "(1 - exp(-{z} * {z} / 2) / sqrt(2 * pi()) * ({t} * (0.319381530 + {t} * (-0.356563782 + {t} * (1.781477937 + {t} * (-1.821255978 + {t} * 1.330274429))))))"


def _cdf_sql(z: str) -> str:
    """Of z >= 0."""
    return _CDF.format(z=z, t=f"(1 / (1 + 0.2316419 * {z}))").replace("0.319381530", "0.319381530::DOUBLE")


@query("d24_normal_cdf", ctes("actions") + f", z AS (SELECT action_id, 4 * success_score AS z FROM actions) SELECT action_id, round({_cdf_sql('z')}, 6) AS p FROM z")
def normal_cdf(spark, sf):
    return T.actions(spark, sf).select("action_id", S.rounded(S.normal_cdf(F.col("success_score") * 4)).alias("p"))


EFFECT = ctes("actions") + ", e AS (SELECT action_type, avg(success_score) - 0.5 AS b, stddev_samp(success_score) / sqrt(count(*)) AS se, (avg(success_score) - 0.5) / stddev_samp(success_score) AS d, count(*) AS n FROM actions GROUP BY 1)"


def _effect(spark, sf):
    s = "success_score"
    g = T.actions(spark, sf).groupBy("action_type").agg((F.avg(s) - 0.5).alias("b"), F.stddev_samp(s).alias("sd"), rows().alias("n"))
    return g.withColumns({"se": F.col("sd") / F.sqrt("n"), "d": F.col("b") / F.col("sd")})


@query("d25_p_value", EFFECT + f" SELECT action_type, round(CASE WHEN se = 0 THEN 1 ELSE 2 * (1 - {_cdf_sql('abs(b / se)')}) END, 5) AS p FROM e")
def p_value(spark, sf):
    return _effect(spark, sf).select("action_type", S.rounded(S.p_value("b", "se"), 5).alias("p"))


@query("d26_power", EFFECT + f", z AS (SELECT action_type, 1.96 - abs(d) * sqrt(n / 2) AS z FROM e) SELECT action_type, round(CASE WHEN z >= 0 THEN 1 - {_cdf_sql('abs(z)')} ELSE {_cdf_sql('abs(z)')} END, 5) AS power FROM z")
def power(spark, sf):
    return _effect(spark, sf).select("action_type", S.rounded(S.power(F.abs("d"), "n"), 5).alias("power"))


@query("d27_residuals", ctes("actions") + "SELECT action_type, round(avg(success_score - 0.5), 6) AS mean, round(var_pop(success_score - 0.5), 6) AS variance, abs(avg(success_score - 0.5)) > 0.1 AS biased FROM actions GROUP BY 1")
def residuals(spark, sf):
    r = F.col("success_score") - 0.5
    return T.actions(spark, sf).groupBy("action_type").agg(S.rounded(F.avg(r)).alias("mean"), S.rounded(F.var_pop(r)).alias("variance"), (F.abs(F.avg(r)) > 0.1).alias("biased"))


@query("d28_claim_confidence", ctes("beliefs") + "SELECT statement, round(greatest(0.0, 0.3 * least(1.0, count(*) / 100.0) + 0.25 * avg(probability) + 0.25 * (1 - stddev_pop(probability)) + 0.2 * avg(CASE WHEN probability >= 0.5 THEN 1.0 ELSE 0.0 END) - least(0.3, 0.1 * (max(probability) - min(probability)))), 6) AS confidence FROM beliefs GROUP BY 1")
def claim_confidence(spark, sf):
    return A.claim_confidence(T.beliefs(spark, sf), "statement").withColumn("confidence", S.rounded("confidence"))


@query("d29_citations", ctes("relations") + "SELECT to_id, count(*) AS citations, count(DISTINCT from_id % 5) AS kinds, round(avg(CASE WHEN confidence >= 0.95 THEN 1.0 ELSE 0.0 END), 6) AS verified, count(*) >= 2 AND count(DISTINCT from_id % 5) >= 2 AND avg(CASE WHEN confidence >= 0.95 THEN 1.0 ELSE 0.0 END) >= 0.8 AS valid FROM relations GROUP BY 1")
def citations(spark, sf):
    return A.citation_summary(T.relations(spark, sf), "to_id", F.col("from_id") % 5, F.col("confidence") >= 0.95).withColumn("verified", S.rounded("verified"))


CHANGE = ctes("actions") + ", t AS (SELECT *, success_score - lag(success_score) OVER (PARTITION BY agent_id ORDER BY executed_at, action_id) AS d FROM actions)"


def _changes(spark, sf):
    return A.changes(T.actions(spark, sf), "agent_id", ORDER, "success_score")


@query("d30_counterfactual", CHANGE + " SELECT action_id, round(CASE WHEN k >= 50 THEN least(1.5, d / 0.5) ELSE least(1.5, -d / 0.5) END, 6) AS flexibility FROM t WHERE d IS NOT NULL")
def counterfactual(spark, sf):
    return _changes(spark, sf).select("action_id", S.rounded(A.counterfactual_flexibility("d", F.col("k") >= 50)).alias("flexibility"))


@query("d31_flexibility", CHANGE + " SELECT agent_id, round(0.4 * avg(least(1.5, abs(d) / 0.5)) + 0.3 * least(1.0, count(*) / 100.0) + 0.3 * avg(abs(d)), 6) AS score FROM t WHERE d IS NOT NULL GROUP BY 1")
def flexibility(spark, sf):
    return A.flexibility(_changes(spark, sf), "agent_id").withColumn("score", S.rounded("score"))


@query("d32_meta_judge", ctes("actions") + "SELECT action_id, round(least(1.0, greatest(0.0, success_score + CASE WHEN k >= 50 THEN 0.1 ELSE -0.1 END - 0.1 * abs(success_score - 0.5))), 6) AS score FROM actions")
def meta_judge(spark, sf):
    return T.actions(spark, sf).select("action_id", S.rounded(A.meta_judged("success_score", F.col("k") >= 50)).alias("score"))


_FORMS = L.expressions(["k", "hour"], 15)


def _importance_sql() -> str:
    one = " UNION ALL ".join(f"SELECT '{e}' AS expression, {c} AS complexity, regr_slope(y, {e}) AS slope, regr_intercept(y, {e}) AS intercept, regr_r2(y, {e}) AS r2 FROM x" for e, c in _FORMS.items())
    return ctes("actions") + f", x AS (SELECT success_score AS y, k / 100.0::DOUBLE AS k, hour(executed_at) / 24.0::DOUBLE AS hour FROM actions), o AS ({one}), b AS (SELECT *, max(round(r2, 9)) OVER (ORDER BY complexity, round(r2, 9) DESC, expression ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM o) SELECT expression, complexity, round(slope, 6) AS slope, round(intercept, 6) AS intercept, round(r2, 6) AS r2, round(r2, 9) > coalesce(seen, -1) AS best FROM b"


@query("d33_importance_equation", _importance_sql())
def importance_equation(spark, sf):
    """Equations for a memory's success by its key and hour, and the front of the simplest that fit best."""
    x = T.actions(spark, sf).select("success_score", (F.col("k") / 100.0).alias("k"), (F.hour("executed_at") / 24.0).alias("hour"))
    f = L.symbolic_fits(x, "success_score", ["k", "hour"])
    return f.select("expression", "complexity", *[S.rounded(c).alias(c) for c in ("slope", "intercept", "r2")], "best")


@query("d33_evolved_equations")
def evolved_equations(spark, sf):
    """The front of equations of up to 15 nodes for a memory's success, bred from its key, hour and day."""
    x = T.actions(spark, sf).select("success_score", (F.col("k") / 100.0).alias("k"), (F.hour("executed_at") / 24.0).alias("hour"), (F.dayofmonth("executed_at") / 31.0).alias("day"))
    f = E.evolved(x, "success_score", ["k", "hour", "day"], population=60, generations=4)
    return f.select("expression", "complexity", *[S.rounded(c).alias(c) for c in ("slope", "intercept", "r2")])


@query("d34_vote", ctes("actions") + "SELECT context, count(*) AS votes, CAST(count(*) FILTER (success_score >= 0.5) AS BIGINT) AS yes, count(*) FILTER (success_score >= 0.5) >= greatest(1, ceil(count(*) * 0.5)) AS accepted FROM actions GROUP BY 1")
def vote(spark, sf):
    return A.vote(T.actions(spark, sf), "context", F.col("success_score") >= 0.5)


@query("d35_attention", AGE + ", g AS (SELECT k, min(h) AS h, count(*) AS n, avg(success_score) AS e FROM t GROUP BY 1) SELECT k, round(0.5 * (exp(-h / 24) + least(1.0, n / 100.0)) + 0.5 * e, 6) AS attention FROM g")
def attention(spark, sf):
    return A.attention(_aged(spark, sf), "k", "h", "success_score").withColumn("attention", S.rounded("attention"))


@query("d36_cache_eviction", AGE + ", g AS (SELECT context, min(h) AS h, count(*) AS n, avg(k) AS tokens FROM t GROUP BY 1) SELECT context, round(0.4 / (h + 1) + 0.4 * least(1.0, n / 10.0) + 0.2 * tokens / 1000, 6) AS score FROM g ORDER BY 0.4 / (h + 1) + 0.4 * least(1.0, n / 10.0) + 0.2 * tokens / 1000, context LIMIT 20")
def cache_eviction(spark, sf):
    return A.evictable(_aged(spark, sf), "context", "h", "k", 20).withColumn("score", S.rounded("score"))


@query("d37_significance", EFFECT + f" SELECT action_type, CASE WHEN 2 * (1 - {_cdf_sql('abs(b / se)')}) < 0.05 THEN 'significant' ELSE 'inconclusive' END AS verdict FROM e")
def significance(spark, sf):
    return _effect(spark, sf).select("action_type", F.when(S.p_value("b", "se") < 0.05, "significant").otherwise("inconclusive").alias("verdict"))


@query("d38_validated_improvement", AGE + " SELECT action_type, round(avg(success_score) FILTER (h < 360) - avg(success_score) FILTER (h >= 360), 6) AS gain, avg(success_score) FILTER (h < 360) - avg(success_score) FILTER (h >= 360) > 0.01 AS improved FROM t GROUP BY 1")
def validated_improvement(spark, sf):
    return A.improvement(_aged(spark, sf), "action_type", "success_score", F.col("h") < 360).withColumn("gain", S.rounded("gain"))


@query("c01_full_consolidation", ctes("actions", "associations") + ", r AS (SELECT * FROM actions WHERE executed_at >= (SELECT max(executed_at) FROM actions) - INTERVAL 24 HOUR), p AS (SELECT 'pattern' AS step, action_type AS what, count(*) AS n FROM r GROUP BY 2 HAVING count(*) >= 3), c AS (SELECT 'causal' AS step, action_type || '->' || b AS what, count(*) AS n FROM (SELECT action_type, lead(action_type) OVER (PARTITION BY agent_id ORDER BY executed_at, action_id) AS b FROM r) WHERE b IS NOT NULL GROUP BY 2 HAVING count(*) >= 2), a AS (SELECT 'association' AS step, CASE WHEN strength >= 0.3 THEN 'kept' ELSE 'pruned' END AS what, count(*) AS n FROM associations GROUP BY 2) SELECT * FROM p UNION ALL SELECT * FROM c UNION ALL SELECT * FROM a")
def full_consolidation(spark, sf):
    """Patterns, causal pairs and pruned associations of the last day in one report."""
    from datetime import timedelta

    a = T.actions(spark, sf)
    r = a.where(F.col("executed_at") >= F.lit(T.as_of(a, "executed_at") - timedelta(hours=24)))
    p = r.groupBy(F.lit("pattern").alias("step"), F.col("action_type").alias("what")).agg(rows().alias("n")).where("n >= 3")
    w = Window.partitionBy("agent_id").orderBy("executed_at", "action_id")
    c = r.select("action_type", F.lead("action_type").over(w).alias("b")).where("b IS NOT NULL").groupBy(F.lit("causal").alias("step"), F.concat_ws("->", "action_type", "b").alias("what")).agg(rows().alias("n")).where("n >= 2")
    s = T.associations(spark, sf).groupBy(F.lit("association").alias("step"), F.when(F.col("strength") >= 0.3, "kept").otherwise("pruned").alias("what")).agg(rows().alias("n"))
    return p.unionByName(c).unionByName(s)


@query("c02_validation_pipeline", "WITH v AS (SELECT doc_id, CASE WHEN text IS NULL OR length(text) < 20 THEN 'too_short' WHEN regexp_matches(lower(text), 'worthless|pathetic|idiot') THEN 'flagged' WHEN regexp_matches(text, '[0-9]{3}-[0-9]{2}-[0-9]{4}') THEN 'personal' ELSE 'valid' END AS verdict, lang FROM documents) SELECT lang, verdict, count(*) AS n FROM v GROUP BY 1, 2")
def validation_pipeline(spark, sf):
    t = F.col("text")
    v = A.first_rule({"too_short": t.isNull() | (F.length(t) < 20), "flagged": F.rlike(F.lower(t), F.lit("worthless|pathetic|idiot")), "personal": F.rlike(t, F.lit("[0-9]{3}-[0-9]{2}-[0-9]{4}"))}, "valid")
    return T.base(spark, sf, "documents").groupBy("lang", v.alias("verdict")).agg(rows().alias("n"))


@query("c03_top_actions_per_agent", ctes("actions") + "SELECT agent_id, action_id, rank FROM (SELECT agent_id, action_id, row_number() OVER (PARTITION BY agent_id ORDER BY success_score DESC, action_id) AS rank FROM actions) WHERE rank <= 3")
def top_actions(spark, sf):
    return ranked(T.actions(spark, sf), ["agent_id"], [F.desc("success_score"), F.col("action_id")], 3).select("agent_id", "action_id", F.col("rank").cast("long").alias("rank"))
