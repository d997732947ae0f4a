"""Text queries: keywords, classification, validation, chunking."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from mnemospark.functions import scores as S
from mnemospark.functions import text as X
from mnemospark.operators import chunking as C
from mnemospark.plans.registry import query
from mnemospark.sources import tables as T
from mnemospark.sources.tables import ctes


def rows():
    return F.count(F.lit(1))
_STOP = ", ".join(f"'{w}'" for w in X.STOPWORDS)
_STRIP = X.STRIPPED.replace("'", "''")
KW = f"kw AS (SELECT conv_id, turn, w FROM (SELECT conv_id, turn, trim(unnest(string_split_regex(lower(text), '\\s+')), '{_STRIP}') AS w FROM conversations) WHERE length(w) > 2 AND w NOT IN ({_STOP}))"


def _sum(column: str, patterns: list[str]) -> str:
    return " + ".join("CAST(regexp_matches({}, '{}') AS INT)".format(column, p.replace("'", "''")) for p in patterns)


@query("t01_keywords", f"WITH {KW} SELECT conv_id, count(*) AS n, count(DISTINCT w) AS distinct_words FROM kw GROUP BY 1")
def keywords(spark, sf):
    c = T.base(spark, sf, "conversations")
    return c.select("conv_id", F.explode(X.keywords("text")).alias("w")).groupBy("conv_id").agg(rows().alias("n"), F.countDistinct("w").alias("distinct_words"))


@query("t02_top_keywords", f"WITH {KW}, g AS (SELECT w, count(*) AS n FROM kw WHERE length(w) > 4 GROUP BY 1) SELECT w, n FROM g ORDER BY n DESC, w LIMIT 50")
def top_keywords(spark, sf):
    w = T.base(spark, sf, "conversations").select(F.explode(X.keywords("text", 5)).alias("w"))
    return w.groupBy("w").agg(rows().alias("n")).orderBy(F.desc("n"), "w").limit(50)


@query("t03_named_phrases")  # word boundaries at accented letters differ between regular expression dialects
def named_phrases(spark, sf):
    p = X.named_phrases("text")
    return T.base(spark, sf, "conversations").select("conv_id", "turn", F.coalesce(F.size(p), F.lit(0)).cast("long").alias("phrases"))


@query("t04_term_frequency", f"WITH {KW} SELECT w, count(*) AS tf, count(DISTINCT conv_id) AS df FROM kw GROUP BY 1")
def term_frequency(spark, sf):
    w = T.base(spark, sf, "conversations").select("conv_id", F.explode(X.keywords("text")).alias("w"))
    per = w.groupBy("w", "conv_id").agg(rows().alias("n"))
    return per.groupBy("w").agg(F.sum("n").alias("tf"), rows().alias("df"))


_TYPES = ", ".join(f"{_sum('t', p)} AS {k}" for k, p in X.QUERY_TYPES.items())


@query("t05_query_type", f"WITH q AS (SELECT conv_id, turn, trim(lower(text)) AS t FROM conversations WHERE role = 'user'), s AS (SELECT conv_id, turn, {_TYPES} FROM q), m AS (SELECT *, greatest(comparative, procedural, analytical, exploratory, factual) AS top FROM s) SELECT CASE WHEN top = 0 THEN 'factual' WHEN comparative = top THEN 'comparative' WHEN procedural = top THEN 'procedural' WHEN analytical = top THEN 'analytical' WHEN exploratory = top THEN 'exploratory' ELSE 'factual' END AS type, count(*) AS n FROM m GROUP BY 1")
def query_type(spark, sf):
    return T.base(spark, sf, "conversations").where("role = 'user'").groupBy(X.query_type("text").alias("type")).agg(rows().alias("n"))


@query("t06_complexity", f"WITH q AS (SELECT trim(lower(text)) AS t, len(list_filter(string_split_regex(lower(text), '\\s+'), lambda x: x <> '')) AS n FROM conversations), s AS (SELECT n, {_sum('t', X.COMPLEX)} AS hard, {_sum('t', X.SIMPLE)} AS easy FROM q) SELECT CASE WHEN hard >= 2 THEN 'complex' WHEN n > 15 OR hard >= 1 THEN 'medium' WHEN easy > 0 AND n < 8 THEN 'simple' ELSE 'medium' END AS complexity, count(*) AS n FROM s GROUP BY 1")
def complexity(spark, sf):
    return T.base(spark, sf, "conversations").groupBy(X.complexity("text").alias("complexity")).agg(rows().alias("n"))


_STATES = " ".join(f"WHEN regexp_matches(lower(text), '{'|'.join(p)}') THEN '{k}'" for k, p in X.STATE_FAMILIES.items())


@query("t07_query_state", f"SELECT CASE {_STATES} ELSE 'general' END AS state, count(*) AS n FROM conversations GROUP BY 1")
def query_state(spark, sf):
    return T.base(spark, sf, "conversations").groupBy(X.first_family("text").alias("state")).agg(rows().alias("n"))


_TASKS = " ".join(f"WHEN contains(lower(text), '{p}') THEN '{k}'" for p, k in X.TASK_TYPES)


@query("t08_task_type", f"SELECT CASE {_TASKS} ELSE 'general' END AS task, count(*) AS n FROM documents GROUP BY 1")
def task_type(spark, sf):
    return T.base(spark, sf, "documents").groupBy(X.task_type("text").alias("task")).agg(rows().alias("n"))


@query("t09_priority", "WITH s AS (SELECT doc_id, len(regexp_extract_all(text, '\\d+\\s*[+\\-*/]\\s*\\d+')) + len(regexp_extract_all(text, '=>')) AS hits, greatest(1, floor(len(string_split_regex(trim(text), '\\s+')) / 10.0)) AS base FROM documents) SELECT doc_id, round(hits / base, 6) AS score, CASE WHEN hits / base > 0.5 THEN 0.75::DOUBLE ELSE 0.1::DOUBLE END AS weight FROM s")
def priority(spark, sf):
    hits = F.regexp_count("text", F.lit(r"\d+\s*[+\-*/]\s*\d+")) + F.regexp_count("text", F.lit("=>"))
    score = hits / F.greatest(F.lit(1), F.floor(F.size(F.split(F.btrim("text"), r"\s+")) / 10.0))
    return T.base(spark, sf, "documents").select("doc_id", S.rounded(score).alias("score"), F.when(score > 0.5, 0.75).otherwise(0.1).alias("weight"))


@query("t10_content_class", "WITH s AS (SELECT doc_id, CAST(contains(lower(text), 'the') AS INT) + CAST(contains(lower(text), 'tion') AS INT) + CAST(contains(lower(text), 'worthless') AS INT) + CAST(contains(lower(text), 'license') AS INT) AS n FROM documents) SELECT CASE WHEN n >= 2 THEN 'reasoning' ELSE 'general' END AS category, CASE WHEN n >= 2 THEN 1.3::DOUBLE ELSE 1.0::DOUBLE END AS weight, round(least(n / 4.0, 1.0), 6) AS confidence, count(*) AS docs FROM s GROUP BY 1, 2, 3")
def content_class(spark, sf, words=("the", "tion", "worthless", "license")):
    n = X.matches(F.lower("text"), list(words))
    s = T.base(spark, sf, "documents").select(n.alias("n"))
    return s.groupBy(F.when(F.col("n") >= 2, "reasoning").otherwise("general").alias("category"), F.when(F.col("n") >= 2, 1.3).otherwise(1.0).alias("weight"), S.rounded(F.least(F.col("n") / len(words), F.lit(1.0))).alias("confidence")).agg(rows().alias("docs"))


@query("t11_memory_tier", "WITH e AS (SELECT CASE o_orderstatus WHEN 'F' THEN 'historical_order' WHEN 'O' THEN 'session' ELSE 'order' END AS kind, 'order ' || CASE WHEN o_orderkey % 10 = 0 THEN 'Orchestrator' WHEN o_orderkey % 10 = 1 THEN 'Current' WHEN o_orderkey % 10 = 2 THEN 'archive' ELSE 'x' END AS name FROM orders) SELECT CASE WHEN kind IN ('system_role', 'core_system') OR contains(lower(name), 'orchestrator') THEN 'core' WHEN kind IN ('project', 'session') OR contains(lower(name), 'current') THEN 'working' WHEN contains(lower(name), 'archive') OR contains(kind, 'historical') THEN 'archive' ELSE 'reference' END AS tier, count(*) AS n FROM e GROUP BY 1")
def memory_tier(spark, sf):
    r = F.col("o_orderkey") % 10
    e = T.base(spark, sf, "orders").select(F.when(F.col("o_orderstatus") == "F", "historical_order").when(F.col("o_orderstatus") == "O", "session").otherwise("order").alias("kind"), F.concat(F.lit("order "), F.when(r == 0, "Orchestrator").when(r == 1, "Current").when(r == 2, "archive").otherwise("x")).alias("name"))
    return e.groupBy(X.memory_tier("kind", "name").alias("tier")).agg(rows().alias("n"))


@query("t12_extractive_summary")
def extractive_summary(spark, sf):
    return C.summaries(T.base(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text"), 300)


@query("t13_sections", "WITH l AS (SELECT doc_id, i, l[i] AS line FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))), s AS (SELECT *, sum(CASE WHEN length(line) < 40 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS section FROM l) SELECT doc_id, CAST(section AS BIGINT) AS section, CAST(sum(length(line)) AS BIGINT) AS chars FROM s GROUP BY 1, 2 HAVING sum(length(line)) >= 100")
def sections(spark, sf, heading: int = 40, least: int = 100):
    """Sections of a text: short lines are headings, short sections are dropped."""
    l = T.observations(spark, sf)
    w = Window.partitionBy("entity_id").orderBy("seq")
    s = l.withColumn("section", F.sum((F.length("content") < heading).cast("long")).over(w))
    return s.groupBy(F.col("entity_id").alias("doc_id"), "section").agg(F.sum(F.length("content")).cast("long").alias("chars")).where(F.col("chars") >= least)


@query("t14_chunks")
def chunks(spark, sf):
    return C.chunked(T.base(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text"), 500, 1)


SENTENCES = r"""WITH s AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(regexp_replace(regexp_replace(text, '\b(Mr|Mrs|Ms|Dr|Prof|Sr|Jr|vs|etc)\.', '\1' || chr(1), 'g'), '(\d)\.(\d)', '\1' || chr(1) || '\2', 'g'), '([.!?])[ \t\n\x0B\f\r]+(\p{Lu})', '\1' || chr(2) || '\2', 'g'), chr(2)), lambda x: trim(replace(x, chr(1), '.'))), lambda x: x <> '') AS s FROM documents)
SELECT doc_id, len(s) AS sentences, md5(array_to_string(s, chr(1))) AS digest FROM s"""


@query("t17_sentences", SENTENCES)
def sentences(spark, sf):
    return T.base(spark, sf, "documents").select("doc_id", F.size(X.sentences("text")).cast("long").alias("sentences"), F.md5(F.array_join(X.sentences("text"), "\u0001")).alias("digest"))


@query("t19_context_window", "SELECT doc_id, md5(substr(text, greatest(1, position('the' IN text) - 200), 400 + 3)) AS context FROM documents WHERE contains(text, 'the')")
def context_window(spark, sf, around: int = 200, word: str = "the"):
    at = F.locate(word, F.col("text"))
    return T.base(spark, sf, "documents").where(F.contains("text", F.lit(word))).select("doc_id", F.md5(F.substring("text", F.greatest(F.lit(1), at - around), F.lit(2 * around + len(word)))).alias("context"))


@query("t20_token_estimate", "SELECT doc_id, CAST(floor(length(text) / 4) AS BIGINT) AS tokens FROM documents")
def token_estimate(spark, sf):
    return T.base(spark, sf, "documents").select("doc_id", F.floor(F.length("text") / 4).alias("tokens"))


_OPP = ", ".join(f"({i}, '{a}', '{b}', '{k}')" for i, (a, b, k) in enumerate(X.OPPOSITES))


@query("t21_contradictions", f"WITH r(o, a, b, kind) AS (VALUES {_OPP}), s AS (SELECT conv_id, turn, lower(text) AS t FROM conversations), p AS (SELECT x.conv_id AS conv_id, x.turn AS t1, y.turn AS t2, min(o) AS o FROM s x JOIN s y ON x.conv_id = y.conv_id AND x.turn < y.turn, r WHERE (contains(x.t, a) AND contains(y.t, b)) OR (contains(y.t, a) AND contains(x.t, b)) GROUP BY 1, 2, 3) SELECT conv_id, t1, t2, kind FROM p JOIN r USING (o)")
def contradictions(spark, sf):
    """Statements of one conversation with opposed words; the first kind counts.

    Statements meet by (conversation, rule), first word against second, not as
    all pairs.
    """
    s = T.base(spark, sf, "conversations").select("conv_id", "turn", F.lower("text").alias("t"))
    sides = F.array(*[F.struct(F.lit(i).alias("o"), F.contains("t", F.lit(a)).alias("x"), F.contains("t", F.lit(b)).alias("y")) for i, (a, b, _) in enumerate(X.OPPOSITES)])
    e = s.select("conv_id", "turn", F.explode(F.filter(sides, lambda r: r["x"] | r["y"])).alias("r")).select("conv_id", "turn", "r.*")
    first, second = e.where("x").select("conv_id", "o", F.col("turn").alias("u")), e.where("y").select("conv_id", "o", F.col("turn").alias("v"))
    pairs = first.join(second, ["conv_id", "o"]).where("u <> v").groupBy("conv_id", F.least("u", "v").alias("t1"), F.greatest("u", "v").alias("t2")).agg(F.min("o").alias("o"))
    return pairs.select("conv_id", "t1", "t2", F.element_at(F.array(*[F.lit(k) for _, _, k in X.OPPOSITES]), F.col("o") + 1).alias("kind"))


@query("t22_negation_pairs", "WITH s AS (SELECT doc_id AS id, lang, md5(replace(replace(lower(text), 'not ', ''), 'no ', '')) AS core, regexp_matches(lower(text), '\\b(not|no)\\b') AS neg FROM documents) SELECT x.id AS a, y.id AS b FROM s x JOIN s y ON x.core = y.core AND x.neg AND NOT y.neg")
def negation_pairs(spark, sf):
    """Statements that are equal but for a negation: they meet by their text without negations."""
    low = F.lower("text")
    core = F.md5(F.replace(F.replace(low, F.lit("not "), F.lit("")), F.lit("no "), F.lit("")))
    s = T.base(spark, sf, "documents").select(F.col("doc_id").alias("id"), core.alias("core"), F.rlike(low, F.lit(r"\b(not|no)\b")).alias("neg"))
    a, b = s.where("neg").select(F.col("id").alias("a"), "core"), s.where("NOT neg").select(F.col("id").alias("b"), "core")
    return a.join(b, "core").select("a", "b")


_RULES = {"overconfident": r"\b(always|never|guaranteed|certainly)\b", "unsupported_numbers": r"\d+(\.\d+)?%", "temporal_vague": r"recent (studies|research)|latest research", "absolute": r"\b(cures|eliminates|completely)\b", "authority": r"according to experts|studies show"}


@query("t23_hallucination_rules", "SELECT doc_id, concat_ws(',', " + ", ".join(f"CASE WHEN regexp_matches(lower(text), '{p}') THEN '{k}' END" for k, p in _RULES.items()) + ") AS found FROM documents")
def hallucination_rules(spark, sf):
    from mnemospark.operators.filters import issues

    low = F.lower("text")
    return T.base(spark, sf, "documents").select("doc_id", F.array_join(issues({k: F.rlike(low, F.lit(p)) for k, p in _RULES.items()}), ",").alias("found"))


@query("t24_inconsistencies", "WITH s AS (SELECT conv_id, turn, list_filter(list_transform(string_split_regex(text, '[.!?]+'), lambda x: trim(lower(x))), lambda x: x <> '') AS s FROM conversations) SELECT conv_id, turn, len(list_filter(s, lambda x: regexp_matches(x, '(^|\\s)(not|no|never|none|neither|nor)(\\s|$)'))) > 0 AND len(list_filter(s, lambda x: NOT regexp_matches(x, '(^|\\s)(not|no|never|none|neither|nor)(\\s|$)'))) > 0 AND len(s) < 5 AS flagged FROM s")
def inconsistencies(spark, sf):
    s = F.filter(F.transform(F.split("text", "[.!?]+"), lambda x: F.btrim(F.lower(x))), lambda x: x != "")
    negative = lambda x: F.rlike(x, F.lit(r"(^|\s)(not|no|never|none|neither|nor)(\s|$)"))
    return T.base(spark, sf, "conversations").select("conv_id", "turn", (F.exists(s, negative) & F.exists(s, lambda x: ~negative(x)) & (F.size(s) < 5)).alias("flagged"))


@query("t25_arithmetic_claims", "WITH c AS (SELECT l_orderkey, l_linenumber, CAST(l_linenumber AS DOUBLE) AS a, CAST(l_orderkey % 7 AS DOUBLE) AS b, CAST(CASE WHEN l_orderkey % 5 = 0 THEN 1 ELSE 0 END AS DOUBLE) AS off, l_orderkey % 4 AS op FROM lineitem), g AS (SELECT *, CASE op WHEN 0 THEN a + b WHEN 1 THEN a + 10 - b WHEN 2 THEN a * b ELSE CASE WHEN b = 0 THEN NULL ELSE a / b END END AS got FROM c) SELECT CASE WHEN got IS NULL THEN 'blocked' WHEN off = 0 THEN 'valid' ELSE 'blocked' END AS verdict, count(*) AS n FROM g WHERE op <> 3 OR b = 0 GROUP BY 1")
def arithmetic_claims(spark, sf):
    l = T.base(spark, sf, "lineitem").select(F.col("l_linenumber").cast("long").alias("a"), (F.col("l_orderkey") % 7).alias("b"), F.when(F.col("l_orderkey") % 5 == 0, 1).otherwise(0).alias("off"), (F.col("l_orderkey") % 4).alias("op"))
    s = lambda c: F.col(c).cast("string")
    claim = F.when(F.col("op") == 0, F.concat_ws(" ", s("a"), F.lit("+"), s("b"), F.lit("="), (F.col("a") + F.col("b") + F.col("off")).cast("string")))
    claim = claim.when(F.col("op") == 1, F.concat_ws(" ", (F.col("a") + 10).cast("string"), F.lit("-"), s("b"), F.lit("="), (F.col("a") + 10 - F.col("b") + F.col("off")).cast("string")))
    claim = claim.when(F.col("op") == 2, F.concat_ws(" ", s("a"), F.lit("*"), s("b"), F.lit("="), (F.col("a") * F.col("b") + F.col("off")).cast("string")))
    claim = claim.otherwise(F.concat_ws(" ", s("a"), F.lit("/"), s("b"), F.lit("= 1")))
    return l.where("op <> 3 OR b = 0").select(claim.alias("claim")).groupBy(X.arithmetic_verdict("claim").alias("verdict")).agg(rows().alias("n"))


@query("t26_contradiction_patterns", "SELECT doc_id FROM documents WHERE regexp_matches(lower(text), 'always.*never|never.*always|idiot.*worthless')")
def contradiction_patterns(spark, sf):
    return T.base(spark, sf, "documents").where(F.rlike(F.lower("text"), F.lit("always.*never|never.*always|idiot.*worthless"))).select("doc_id")


TAUTOLOGIES = r"""WITH w AS (SELECT doc_id, lower(text) AS t, string_split_regex(lower(text), '\s+') AS w FROM documents)
SELECT doc_id, len(list_filter(range(1, len(w) - 1), lambda i: w[i + 1] = 'is' AND regexp_extract(w[i], '(\w+)$', 1) <> '' AND regexp_extract(w[i], '(\w+)$', 1) = regexp_extract(w[i + 2], '^(\w+)', 1))) > 0 AS tautology, regexp_matches(t, 'because\s+it\s+is|proves?\s+itself') AS circular FROM w"""


@query("t27_tautologies", TAUTOLOGIES)
def tautologies(spark, sf):
    """"x is x" and circular reasons."""
    low = F.lower("text")
    return T.base(spark, sf, "documents").select("doc_id", F.rlike(low, F.lit(r"\b(\w+)\s+is\s+\1\b")).alias("tautology"), F.rlike(low, F.lit(r"because\s+it\s+is|proves?\s+itself")).alias("circular"))


@query("t29_validation", "WITH v AS (SELECT doc_id, CASE WHEN text IS NULL OR length(text) < 20 THEN 'blocked' WHEN regexp_matches(lower(text), 'worthless|pathetic') THEN 'flagged' ELSE 'valid' END AS v FROM documents) SELECT v AS verdict, count(*) AS n, CAST(count(*) FILTER (v <> 'blocked') AS BIGINT) AS accepted FROM v GROUP BY 1")
def validation(spark, sf):
    v = F.when(F.col("text").isNull() | (F.length("text") < 20), "blocked").when(F.rlike(F.lower("text"), F.lit("worthless|pathetic")), "flagged").otherwise("valid")
    return T.base(spark, sf, "documents").groupBy(v.alias("verdict")).agg(rows().alias("n"), F.count_if(v != "blocked").alias("accepted"))


@query("t28_provenance_rules", ctes("relations") + "SELECT concat_ws(',', CASE WHEN relation_type NOT IN ('causes', 'leads_to') THEN 'method' END, CASE WHEN confidence < 0.95 THEN 'confidence' END, CASE WHEN valid_until IS NULL THEN 'citation' END) AS issues, count(*) AS n FROM relations GROUP BY 1")
def provenance_rules(spark, sf):
    from mnemospark.operators.filters import issues

    rules = {"method": ~F.col("relation_type").isin("causes", "leads_to"), "confidence": F.col("confidence") < 0.95, "citation": F.col("valid_until").isNull()}
    return T.relations(spark, sf).groupBy(F.array_join(issues(rules), ",").alias("issues")).agg(rows().alias("n"))


@query("t30_context_hash", ctes("actions") + "SELECT action_id, substr(sha256(action_type || '{\"agent\":\"' || agent_id || '\",\"context\":\"' || context || '\"}'), 1, 16) AS hash FROM actions")
def context_hash(spark, sf):
    ctx = F.to_json(F.struct(F.col("agent_id").cast("string").alias("agent"), F.col("context").alias("context")))
    return T.actions(spark, sf).select("action_id", F.substring(F.sha2(F.concat("action_type", ctx), 256), 1, 16).alias("hash"))


@query("t32_pattern_id", ctes("actions") + "SELECT substr(md5('sco:' || CAST(least(4, floor(success_score * 5)) AS INT) || '|typ:' || length(action_type)), 1, 12) AS pattern, count(*) AS n FROM actions GROUP BY 1")
def pattern_id(spark, sf):
    bin_ = F.least(F.lit(4), F.floor(F.col("success_score") * 5)).cast("int").cast("string")
    key = F.concat(F.lit("sco:"), bin_, F.lit("|typ:"), F.length("action_type").cast("string"))
    return T.actions(spark, sf).groupBy(F.substring(F.md5(key), 1, 12).alias("pattern")).agg(rows().alias("n"))


def _mask_sql(column: str) -> str:
    for p, token in X.PERSONAL:
        column = f"regexp_replace({column}, '{p}', '{token}', 'gi')"
    return column


@query("t33_mask_personal_data", f"SELECT doc_id, md5({_mask_sql('text')}) AS digest, {_mask_sql('text')} <> text AS masked FROM documents")
def mask_personal_data(spark, sf):
    m = X.masked("text")
    return T.base(spark, sf, "documents").select("doc_id", F.md5(m).alias("digest"), (m != F.col("text")).alias("masked"))


@query("t36_pattern_similarity", "SELECT p_partkey, round(CASE WHEN p_brand = 'Brand#3' THEN 0.3 ELSE 0 END + CASE WHEN p_size BETWEEN 10 AND 20 THEN 0.2 ELSE 0 END + 0.3 * (CASE WHEN p_type = 'PROMO' THEN 1.0 ELSE 0.0 END) + 0.2 * (len(list_intersect(string_split(p_name, ' '), ['red', 'part'])) * 1.0 / len(list_distinct(list_concat(string_split(p_name, ' '), ['red', 'part'])))), 6) AS similarity FROM part")
def pattern_similarity(spark, sf):
    want = F.array(F.lit("red"), F.lit("part"))
    eq = lambda c, w: F.when(c, w).otherwise(0.0)
    s = eq(F.col("p_brand") == "Brand#3", 0.3) + eq(F.col("p_size").between(10, 20), 0.2) + eq(F.col("p_type") == "PROMO", 0.3) + X.jaccard(F.split("p_name", " "), want) * 0.2
    return T.base(spark, sf, "part").select("p_partkey", S.rounded(s).alias("similarity"))


@query("t37_component_relevance", "SELECT p_partkey, round(least(1.0, CASE WHEN p_brand = 'Brand#4' THEN 0.3 ELSE 0 END + CASE WHEN p_size > 30 THEN 0.2 ELSE 0 END + CASE WHEN p_retailprice > 1000 THEN 0.2 ELSE 0 END + 0.3 * (CAST(contains(lower(p_type), 'econ') AS INT) + CAST(contains(lower(p_type), 'promo') AS INT)) / 2.0), 6) AS relevance FROM part")
def component_relevance(spark, sf):
    eq = lambda c, w: F.when(c, w).otherwise(0.0)
    s = eq(F.col("p_brand") == "Brand#4", 0.3) + eq(F.col("p_size") > 30, 0.2) + eq(F.col("p_retailprice") > 1000, 0.2) + X.matches(F.lower("p_type"), ["econ", "promo"]) * 0.3 / 2.0
    return T.base(spark, sf, "part").select("p_partkey", S.rounded(F.least(F.lit(1.0), s)).alias("relevance"))


@query("t39_salience", ctes("entities") + "SELECT id, round(least(1.0, greatest(0.0, 0.5 + CASE WHEN length(content) BETWEEN 100 AND 500 THEN 0.1 WHEN length(content) > 1000 THEN -0.1 ELSE 0 END + least(0.3, 0.05 * (" + _sum("lower(content)", X.SALIENT) + ")) + CASE tier WHEN 'semantic' THEN 0.1 WHEN 'working' THEN -0.1 ELSE 0 END + CASE WHEN regexp_matches(content, '```|- |1\\.|\\* ') THEN 0.1 ELSE 0 END)), 6) AS salience FROM entities")
def salience(spark, sf):
    return T.entities(spark, sf).select("id", S.rounded(X.salience("content", "tier")).alias("salience"))


@query("t41_context_quality", ctes("entities") + "SELECT id, round(0.2 * least(1.0, length(content) / 1000.0) + 0.4 * (CAST(contains(lower(content), 'the') AS INT) + CAST(contains(lower(content), 'with') AS INT)) / 2.0 + 0.2 * CASE WHEN contains(content, chr(10)) THEN 1 ELSE 0.5 END + 0.2 * CASE WHEN regexp_matches(content, '\\d') THEN 1 ELSE 0 END, 6) AS quality FROM entities")
def context_quality(spark, sf):
    c = F.col("content")
    q = F.least(F.lit(1.0), F.length(c) / 1000.0) * 0.2 + X.matches(F.lower(c), ["the", "with"]) * 0.4 / 2.0 + F.when(F.contains(c, F.lit("\n")), 1.0).otherwise(0.5) * 0.2 + F.when(F.rlike(c, F.lit(r"\d")), 1.0).otherwise(0.0) * 0.2
    return T.entities(spark, sf).select("id", S.rounded(q).alias("quality"))


@query("t42_context_prefix", ctes("entities") + "SELECT id, '[Context: This is a ' || entity_type || ' entity named ''' || name || ''' with information about ' || substr(content, 1, 50) || '...] ' AS prefix FROM entities")
def context_prefix(spark, sf):
    return T.entities(spark, sf).select("id", F.concat(F.lit("[Context: This is a "), "entity_type", F.lit(" entity named '"), "name", F.lit("' with information about "), F.substring("content", 1, 50), F.lit("...] ")).alias("prefix"))


@query("f14_noise_filter", "SELECT doc_id FROM documents WHERE regexp_matches(text, '(?i)license|copyright|warranty')")
def noise_filter(spark, sf):
    return T.base(spark, sf, "documents").where(F.rlike("text", F.lit("(?i)license|copyright|warranty"))).select("doc_id")


@query("u04_relevance", f"WITH {KW}, q AS (SELECT ['the', 'haedtion', 'ertion', 'ounting'] AS q) SELECT conv_id, round(count(DISTINCT w) FILTER (list_contains(q, w)) / 4.0, 6) AS relevance FROM kw, q GROUP BY conv_id")
def relevance(spark, sf, terms=("the", "haedtion", "ertion", "ounting")):
    w = T.base(spark, sf, "conversations").select("conv_id", F.explode(X.keywords("text")).alias("w"))
    hit = F.countDistinct(F.when(F.col("w").isin(*terms), F.col("w")))
    return w.groupBy("conv_id").agg(S.rounded(hit / float(len(terms))).alias("relevance"))


@query("u05_turn_similarity", "WITH t AS (SELECT conv_id, turn, list_distinct(list_filter(string_split_regex(lower(text), '\\s+'), lambda x: x <> '')) AS w, lead(list_distinct(list_filter(string_split_regex(lower(text), '\\s+'), lambda x: x <> ''))) OVER (PARTITION BY conv_id ORDER BY turn) AS v FROM conversations) SELECT conv_id, turn, round(coalesce(len(list_intersect(w, v)) * 1.0 / nullif(len(list_distinct(list_concat(w, v))), 0), 0), 6) AS jaccard FROM t WHERE v IS NOT NULL")
def turn_similarity(spark, sf):
    w = Window.partitionBy("conv_id").orderBy("turn")
    t = T.base(spark, sf, "conversations").select("conv_id", "turn", F.array_distinct(X.words("text")).alias("w"))
    return t.withColumn("v", F.lead("w").over(w)).where("v IS NOT NULL").select("conv_id", "turn", S.rounded(X.jaccard("w", "v")).alias("jaccard"))


@query("w10_coherence", "WITH t AS (SELECT conv_id, turn, list_distinct(list_filter(string_split_regex(lower(text), '\\s+'), lambda x: x <> '')) AS w, lead(list_distinct(list_filter(string_split_regex(lower(text), '\\s+'), lambda x: x <> ''))) OVER (PARTITION BY conv_id ORDER BY turn) AS v FROM conversations) SELECT conv_id, round(avg(coalesce(len(list_intersect(w, v)) * 1.0 / nullif(len(list_distinct(list_concat(w, v))), 0), 0)), 6) AS coherence FROM t WHERE v IS NOT NULL GROUP BY 1")
def coherence(spark, sf):
    w = Window.partitionBy("conv_id").orderBy("turn")
    t = T.base(spark, sf, "conversations").select("conv_id", "turn", F.array_distinct(X.words("text")).alias("w"))
    return t.withColumn("v", F.lead("w").over(w)).where("v IS NOT NULL").groupBy("conv_id").agg(S.rounded(F.avg(X.jaccard("w", "v"))).alias("coherence"))


@query("t34_compressed_observations", ctes("observations") + f", c AS (SELECT entity_id, content, CASE WHEN length(content) >= 50 THEN array_to_string(list_filter(string_split_regex(content, '\\s+'), lambda w: w <> '' AND lower(w) NOT IN ({_STOP})), ' ') ELSE content END AS short FROM observations), t AS (SELECT entity_id, count(*) AS observations, CAST(count(*) FILTER (short <> content) AS BIGINT) AS compressed, CAST(sum(floor(length(content) / 4)) AS BIGINT) AS tokens, CAST(sum(floor(length(short) / 4)) AS BIGINT) AS kept_tokens FROM c GROUP BY 1) SELECT entity_id, observations, compressed, tokens, kept_tokens, round(CASE WHEN tokens > 0 THEN 100.0 * (tokens - kept_tokens) / tokens ELSE 0 END, 6) AS reduction_pct FROM t")
def compressed_observations(spark, sf):
    """What compaction saves of each entity's observations; the originals are kept beside them."""
    c = T.observations(spark, sf).withColumn("short", X.compacted("content"))
    tokens = lambda x: F.floor(F.length(x) / 4)
    t = c.groupBy("entity_id").agg(rows().alias("observations"), F.count_if(F.col("short") != F.col("content")).alias("compressed"), F.sum(tokens("content")).alias("tokens"), F.sum(tokens("short")).alias("kept_tokens"))
    saved = F.when(F.col("tokens") > 0, (F.col("tokens") - F.col("kept_tokens")) * 100.0 / F.col("tokens")).otherwise(0.0)
    return t.select("*", S.rounded(saved).alias("reduction_pct"))
