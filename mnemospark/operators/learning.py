"""Order-dependent learners: folds over each key's rows in time order, as streams of sorted Arrow batches; symbolic regression.

Edge cases, for all folds: a row whose score is null changes nothing and isn't
counted, and a key with such rows only gets no row; a null key is a key; rows
that tie in the order's columns are taken in the order of their values; repeated
rows count each; an empty table gives no rows; a key's rows are one task's
stream, of any length, with one state in memory.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from mnemospark.functions import scores
from mnemospark.sources import storage


def folded(df: DataFrame, key: str, order: list[str], values: list[str], start: Callable, step: Callable, schema: str, result: Callable, needed: int | None = None) -> DataFrame:
    """One row per key: result(state) after step(state, *values) over its rows in order.

    Rows are hash-partitioned by the key and sorted; a task keeps one state at
    a time, so a key may have any number of rows. needed: how many of the first
    values must not be null (all by default).
    """
    columns = [x.split(" ")[0] for x in schema.split(", ")]
    types = to_arrow_schema(T.StructType([T.StructField(key, df.schema[key].dataType), *T._parse_datatype_string(schema).fields]))

    def built(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), types)], names=[key, *columns])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state, begun = None, None, False
        for b in batches:
            out = []
            cols = [b.column(i).to_pylist() for i in range(b.num_columns)]
            for k, *vs in zip(cols[0], *cols[1 + len(order) :]):
                if not begun or k != last:
                    if begun:
                        out.append((last, *result(state)))
                    last, state, begun = k, start(), True
                state = step(state, *vs)
            if out:
                yield built(out)
        if begun:
            yield built([(last, *result(state))])

    rows = df.select(key, *[F.col(o).alias(f"__{i}") for i, o in enumerate(order)], *[F.col(v).alias(f"__v{i}") for i, v in enumerate(values)])
    for i in range(len(values) if needed is None else needed):
        rows = rows.where(F.col(f"__v{i}").isNotNull())
    kind = df.schema[key].dataType.simpleString()
    return rows.repartition(key).sortWithinPartitions(key, *[f"__{i}" for i in range(len(order))], *[f"__v{i}" for i in range(len(values))]).mapInArrow(run, f"{key} {kind}, {schema}")


def appended(edits: DataFrame, key: str, order: list[str], text: str, read_only: str, limit: int) -> DataFrame:
    """(key, block, applied, refused): each key's block after its edit log, in order.

    The first text begins the block, however long; each other one is appended
    after a newline, and refused whole where the block is read-only or would
    exceed ``limit`` characters. A task holds one block at a time.
    """

    def step(state: tuple | None, more: str, fixed: bool) -> tuple:
        if state is None:
            return more, 0, 0
        block, applied, refused = state
        if fixed or len(block) + 1 + len(more) > limit:
            return block, applied, refused + 1
        return f"{block}\n{more}", applied + 1, refused

    return folded(edits, key, order, [text, read_only], lambda: None, step, "block string, applied long, refused long", lambda s: s, needed=1)


def scanned(df: DataFrame, key: str, order: list[str], value: str, start: Callable, step: Callable, schema: str) -> DataFrame:
    """Every row of (key, order, value) with what step(state, value) -> (state, result) gives for it, over each key's rows in order."""
    columns = [x.split(" ")[0] for x in schema.split(", ")]
    rows = df.select(key, *order, value).where(F.col(value).isNotNull())
    full = T.StructType([*rows.schema.fields, *T._parse_datatype_string(schema).fields])
    types = to_arrow_schema(full)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state, begun = None, None, False
        for b in batches:
            out = []
            for k, v in zip(b.column(0).to_pylist(), b.column(b.num_columns - 1).to_pylist()):
                if not begun or k != last:
                    last, state, begun = k, start(), True
                state, found = step(state, v)
                out.append(found)
            if out:
                yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(c, types.field(n).type) for n, c in zip(columns, zip(*out)))], names=full.fieldNames())

    return rows.repartition(key).sortWithinPartitions(key, *order, value).mapInArrow(run, full)


#: Fixed values of the surprise scan: smoothing, boost, thresholds, and how many memories follow one of high surprise.
BETA, BOOST, STORE, HIGH, AT_ONCE, FOLLOWERS = 0.9, 1.3, 0.4, 0.7, 0.8, 3


def promote_step(state: tuple, raw: float) -> tuple:
    """((momentum, followers left, threshold, recent scores), (score, promoted)) after one more raw score."""
    momentum, followers, threshold, recent = state
    rise = raw - momentum
    score = min(1.0, raw * BOOST) if rise > 0.1 else raw * 0.95 if rise < -0.1 else raw
    stored = score >= (threshold * 0.7 if followers > 0 else threshold)
    if score >= HIGH:
        followers = FOLLOWERS
    elif followers > 0:
        followers, stored = followers - 1, True
    recent = [*recent, score][-100:]
    if len(recent) >= 10:
        mean = sum(recent[-50:]) / len(recent[-50:])
        threshold = min(0.7, threshold + 0.05) if mean > 0.6 else max(0.2, threshold - 0.05) if mean < 0.3 else threshold
    return (BETA * momentum + (1 - BETA) * raw, followers, threshold, recent), (score, stored or score >= AT_ONCE)


def consolidated_memories(memories: DataFrame, key: str, hours: int, most: int, topics: int = 5) -> DataFrame:
    """memories(key, id, text, at, salience) of the last ``hours`` -> (key, id, at, score, verdict).

    A memory's raw score is half its novelty (against the beginnings of the
    ``topics`` memories before it), 0.3 salience and 0.2 how little it goes on
    with their words; the scan smooths it and decides. Beyond ``most`` promoted
    memories, those of the lowest retention are forgotten.
    """
    last = F.lit(memories.agg(F.max("at")).first()[0]).cast(memories.schema["at"].dataType)  # one row
    words = lambda text: F.array_distinct(F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != ""))
    rows = memories.where(F.col("at") > last - F.make_interval(hours=F.lit(hours))).select(key, "id", "at", "salience", words("text").alias("all"), words(F.substring("text", 1, 100)).alias("begin"))
    before = F.collect_list("begin").over(Window.partitionBy(key).orderBy("at", "id").rowsBetween(-topics, -1))
    rows = rows.withColumn("topics", before).withColumn("like", F.transform("topics", lambda t: F.coalesce(F.try_divide(F.size(F.array_intersect("begin", t)), F.size(F.array_union("begin", t))), F.lit(0.0))))
    novelty = F.coalesce(1 - F.array_max("like"), F.lit(1.0)) * F.when(F.size(F.filter("like", lambda x: x > 0.8)) >= 5, 0.5).otherwise(1.0)
    shared = F.aggregate("topics", F.lit(0), lambda n, t: n + F.size(F.array_intersect("all", t))) / F.size("topics")
    temporal = F.when(F.size("topics") == 0, 0.5).when(shared < 2, 0.7).when(shared > 10, 0.4).otherwise(0.5)
    raw = rows.select(key, "at", "id", F.round(novelty * 0.5 + F.col("salience") * 0.3 + temporal * 0.2 + 1e-10, 9).alias("raw"))
    judged = storage.staged(scanned(raw, key, ["at", "id"], "raw", lambda: (0.5, 0, STORE, []), promote_step, "score double, promoted boolean"), "judged")
    excess = judged.where("promoted").count() - most
    verdict = F.when(F.col("promoted"), "promoted").otherwise("skipped")
    if excess <= 0:
        return judged.select(key, "id", "at", "score", verdict.alias("verdict"))
    days = F.floor((F.unix_timestamp(last.cast("timestamp")) - F.unix_timestamp(F.col("at").cast("timestamp"))) / 86400)
    kept = F.round(scores.retention_score("score", F.lit(0), days, 0.1) + 1e-10, 9)
    gone = judged.where("promoted").select(key, "id", kept.alias("kept")).orderBy("kept", key, "id").limit(excess).select(key, "id", F.lit(True).alias("gone"))
    return judged.join(gone, [key, "id"], "left").select(key, "id", "at", "score", F.when(F.col("gone"), "forgotten").otherwise(verdict).alias("verdict"))


def surprise_step(state: tuple, score: float | None) -> tuple:
    """(n, mean, momentum, promoted) after one more score; a null score changes nothing."""
    if score is None:
        return state
    n, mean, momentum, promoted = state
    novelty = abs(score - mean) if n else 1.0
    raw = 0.5 * min(1.0, 2 * novelty) + 0.3 * score + 0.2 * (1.0 / (1 + n))
    momentum = raw if n == 0 else 0.7 * momentum + 0.3 * raw
    promoted += momentum >= 0.3 + 0.1 * min(1.0, n / 50)
    return n + 1, mean + (score - mean) / (n + 1), momentum, int(promoted)


def surprise(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Momentum surprise: 0.5 novelty + 0.3 salience + 0.2 gap against the key's history, smoothed; (n, promoted, momentum)."""
    return folded(df, key, order, ["success_score"], lambda: (0, 0.0, 0.0, 0), surprise_step, "n long, promoted long, momentum double", lambda s: (s[0], s[3], s[2]))


def q_values(df: DataFrame, key: str, order: list[str], rate: float = 0.1) -> DataFrame:
    """q += rate / (1 + 0.01 n) * (reward - q) from 0.5 on."""
    return folded(df, key, order, ["success_score"], lambda: (0, 0.5), lambda s, r: (s[0] + 1, s[1] + rate / (1 + 0.01 * s[0]) * (r - s[1])), "n long, q double", lambda s: s)


def affinity(df: DataFrame, key: str, order: list[str], alpha: float = 0.3) -> DataFrame:
    """Exponential moving average of the scores."""
    return folded(df, key, order, ["success_score"], lambda: None, lambda s, x: x if s is None else (1 - alpha) * s + alpha * x, "affinity double", lambda s: (s,))


def fisher(df: DataFrame, key: str, order: list[str], decay: float = 0.9) -> DataFrame:
    """Running importance (EMA of squares), mean and variance (Welford) and the largest z-score seen."""

    def step(s, x):
        f, n, mean, m2, z = s
        if n > 1 and m2 > 0:
            z = max(z, abs(x - mean) / math.sqrt(m2 / (n - 1)))
        d = x - mean
        mean += d / (n + 1)
        return decay * f + (1 - decay) * x * x, n + 1, mean, m2 + d * (x - mean), z

    return folded(df, key, order, ["success_score"], lambda: (0.0, 0, 0.0, 0.0, 0.0), step, "fisher double, mean double, variance double, max_z double", lambda s: (s[0], s[2], s[3] / max(1, s[1] - 1), s[4]))


#: The features of the confidence model, in order, with the weights that they start with.
FEATURES = {
    "citation_count": 0.15, "peer_reviewed_ratio": 0.2, "recency_score": 0.1, "evidence_level_score": 0.2, "contradiction_count": -0.15,
    "hallucination_flags": -0.25, "text_length": 0.02, "quantitative_claims": 0.05, "source_reliability": 0.15, "semantic_coherence": 0.1,
}


def online_sgd(df: DataFrame, key: str, order: list[str], features: dict[str, float] = FEATURES, target: str = "success_score", rate: float = 0.01, bias: float = 0.5) -> DataFrame:
    """(key, n, bias, and a weight for each feature): one gradient step a row on the squared error of sigmoid(bias + w . x).

    The gradient leaves the sigmoid's slope out, as the surveyed learner does;
    weights stay within [-1, 1], the bias within [0, 1]. A null feature is 0.
    """

    def step(s, y, *xs):
        n, b, w = s
        x = [v or 0.0 for v in xs]
        e = 1 / (1 + math.exp(-(b + sum(p * q for p, q in zip(w, x))))) - y
        return n + 1, max(0.0, min(1.0, b - rate * 2 * e)), [max(-1.0, min(1.0, p - rate * 2 * e * q)) for p, q in zip(w, x)]

    schema = "n long, bias double, " + ", ".join(f"w_{f} double" for f in features)
    return folded(df, key, order, [target, *features], lambda: (0, bias, [*features.values()]), step, schema, lambda s: (s[0], s[1], *s[2]), needed=1)


#: Forms of one variable x and of two, x and y, with their complexity (symbols).
FORMS = {"{x}": 1, "{x} * {x}": 3, "sqrt({x})": 2, "ln(1 + {x})": 4, "exp(-{x})": 3, "1 / (1 + {x})": 5}
PAIR_FORMS = {"{x} * {y}": 3, "{x} / (1 + {y})": 5, "sqrt({x} * {y})": 4, "{x} * exp(-{y})": 5}


def expressions(variables: list[str], most: int) -> dict[str, int]:
    """Expressions of the variables (values from 0 on) up to a complexity."""
    out = {f.format(x=x): c for x in variables for f, c in FORMS.items()}
    for x in variables:
        for y in variables:
            if x != y:
                out |= {f.format(x=x, y=y): c for f, c in PAIR_FORMS.items() if x < y or f in ("{x} / (1 + {y})", "{x} * exp(-{y})")}
    return {e: c for e, c in out.items() if c <= most}


def symbolic_fits(df: DataFrame, target: str, variables: list[str], most: int = 15) -> DataFrame:
    """(expression, complexity, slope, intercept, r2, best): target = intercept + slope * expression for every expression of a bounded grammar.

    All fits come from one pass of least-squares sums; ``best`` marks those that
    no simpler or equally simple expression matches (the front of complexity
    against r2; ties go to the first by name). Rows with a null are left out of
    the expressions they touch; an expression that is constant has null slope,
    intercept and r2 and is never best; an empty table fits nothing.
    """
    every = expressions(variables, most)
    y = F.col(target)
    stats = [F.struct(F.regr_slope(y, F.expr(e)).alias("slope"), F.regr_intercept(y, F.expr(e)).alias("intercept"), F.regr_r2(y, F.expr(e)).alias("r2")).alias(f"f{i}") for i, e in enumerate(every)]
    one = df.select(target, *variables).agg(*stats)  # one row
    rows = F.array(*[F.struct(F.lit(e).alias("expression"), F.lit(c).alias("complexity"), F.col(f"f{i}.slope").alias("slope"), F.col(f"f{i}.intercept").alias("intercept"), F.col(f"f{i}.r2").alias("r2")) for i, (e, c) in enumerate(every.items())])
    fits = one.select(F.explode(rows).alias("r")).select("r.*")
    # As many rows as expressions: one task settles the front.
    before = Window.orderBy("complexity", F.desc_nulls_last(F.round("r2", 9)), "expression").rowsBetween(Window.unboundedPreceding, -1)
    seen = F.coalesce(F.max(F.round("r2", 9)).over(before), F.lit(-1.0))
    return fits.withColumn("best", F.coalesce((F.round("r2", 9) > seen) & F.col("slope").isNotNull(), F.lit(False)))
