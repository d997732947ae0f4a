"""Aggregates and scores of the engine with their parameters: confidence, citations, flexibility, votes, attention, caches, improvements.

Edge cases, for all of them: a null value is no vote, score or citation (but a
row to ``rows``-like counts); a null key is a group of its own; repeated rows
count each; ties go to the smaller key; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemospark.functions.scores import c, clamp, eviction_score


def rows() -> Column:
    return F.count(F.lit(1))


def claim_confidence(df: DataFrame, claim: str, probability: str = "probability", enough: int = 100) -> DataFrame:
    """(claim, confidence): how many statements there are, how sure, how much alike, how many for it, less their range."""
    p = F.col(probability)
    agreed = F.avg(F.when(p >= 0.5, 1.0).when(p < 0.5, 0.0))
    x = 0.3 * F.least(F.lit(1.0), rows() / float(enough)) + 0.25 * F.avg(p) + 0.25 * (1 - F.stddev_pop(p)) + 0.2 * agreed - F.least(F.lit(0.3), (F.max(p) - F.min(p)) * 0.1)
    return df.groupBy(claim).agg(F.greatest(F.lit(0.0), x).alias("confidence"))


def citation_summary(df: DataFrame, work: str, kind: Column, verified: Column, least: int = 2, kinds: int = 2, share: float = 0.8) -> DataFrame:
    """(work, citations, kinds, verified, valid): valid with enough citations, of enough kinds, enough of them verified."""
    n_kinds, part = F.count_distinct(kind), F.avg(F.when(verified, 1.0).otherwise(0.0))
    return df.groupBy(work).agg(rows().alias("citations"), n_kinds.alias("kinds"), part.alias("verified"), ((rows() >= least) & (n_kinds >= kinds) & (part >= share)).alias("valid"))


def changes(df: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """The rows with d, the value's change since the key's row before; first rows are left out."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("d", F.col(value) - F.lag(value).over(w)).where("d IS NOT NULL")


def counterfactual_flexibility(change, expects_rise: Column, full: float = 0.5, most: float = 1.5) -> Column:
    """How far a belief moved the way new evidence asks for, in parts of a full move."""
    d = c(change) / full
    return F.when(expects_rise, F.least(F.lit(most), d)).otherwise(F.least(F.lit(most), -d))


def flexibility(df: DataFrame, key: str, change: str = "d", full: float = 0.5, most: float = 1.5, enough: int = 100) -> DataFrame:
    """(key, score): size, number and mean of the changes."""
    d = F.abs(change)
    x = 0.4 * F.avg(F.least(F.lit(most), d / full)) + 0.3 * F.least(F.lit(1.0), rows() / float(enough)) + 0.3 * F.avg(d)
    return df.groupBy(key).agg(x.alias("score"))


def meta_judged(score, favoured: Column, bonus: float = 0.1, pull: float = 0.1) -> Column:
    """A judge's score, with a bonus for favoured rows and a malus for others, less what it lies from the middle."""
    return clamp(c(score) + F.when(favoured, bonus).otherwise(-bonus) - F.abs(c(score) - 0.5) * pull)


def vote(df: DataFrame, proposal: str, approves: Column, quorum: float = 0.5) -> DataFrame:
    """(proposal, votes, yes, accepted): accepted with the quorum's share of yes, one at least."""
    yes = F.count_if(approves)
    return df.groupBy(proposal).agg(rows().alias("votes"), yes.alias("yes"), (yes >= F.greatest(F.lit(1), F.ceil(rows() * quorum))).alias("accepted"))


def attention(df: DataFrame, key: str, hours: str, emotion: str, day: float = 24.0, enough: int = 100) -> DataFrame:
    """(key, attention): how recent and how frequent, and the mean emotion."""
    g = df.groupBy(key).agg(F.min(hours).alias("h"), rows().alias("n"), F.avg(emotion).alias("e"))
    return g.select(key, ((F.exp(-F.col("h") / day) + F.least(F.lit(1.0), F.col("n") / float(enough))) * 0.5 + F.col("e") * 0.5).alias("attention"))


def evictable(df: DataFrame, key: str, hours: str, tokens: str, n: int) -> DataFrame:
    """(key, score): the n entries that a cache gives up first."""
    g = df.groupBy(key).agg(F.min(hours).alias("h"), rows().alias("n"), F.avg(tokens).alias("tokens"))
    return g.select(key, eviction_score("h", "n", "tokens").alias("score")).orderBy("score", key).limit(n)


def improvement(df: DataFrame, group: str, value: str, recent: Column, least: float = 0.01) -> DataFrame:
    """(group, gain, improved): the recent rows' mean over that of the others; null where one side has none."""
    gain = F.avg(F.when(recent, F.col(value))) - F.avg(F.when(~recent, F.col(value)))
    return df.groupBy(group).agg(gain.alias("gain"), (gain > least).alias("improved"))


def first_rule(rules: dict[str, Column], otherwise: str) -> Column:
    """Name of the first rule that holds."""
    out = F.lit(otherwise)
    for name, rule in reversed(rules.items()):
        out = F.when(rule, name).otherwise(out)
    return out
