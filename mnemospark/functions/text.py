"""Text analysis as column expressions: keywords, classifiers, validators, masking."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that carry no meaning of their own.
STOPWORDS = """the a an is are was were be been being have has had do does did will would could should may might must shall can to of in for on with at by from as into through
during before after above below between under again further then once here there when where why how all each few more most other some such no nor not only own same so than too very
just and but if or because until while what which who whom this that these those am i me my you your he him his she her it its we us our they them their""".split()

#: Punctuation that is stripped from words.
STRIPPED = ".,!?;:()[]{}\"'-"

#: Patterns of query types, in the order in which ties are settled.
QUERY_TYPES = {
    "comparative": [r"\bcompare\b", r"\bversus\b", r"\bvs\.?\b", r"\bdifference\b", r"\brelate\b", r"\bconnection\b", r"\bbetween\b.*and\b"],
    "procedural": [r"^how\s+do\b", r"^how\s+to\b", r"^how\s+can\b", r"^steps\s+to\b", r"^process\b", r"^procedure\b", r"^implement\b"],
    "analytical": [r"^why\b", r"^analyze\b", r"^evaluate\b", r"^assess\b", r"\bcause\b", r"\breason\b", r"\bimpact\b"],
    "exploratory": [r"^tell\s+me\s+about\b", r"^explain\b", r"^describe\b", r"^discuss\b", r"^overview\b", r"^summarize\b"],
    "factual": [r"^what\s+is\b", r"^define\b", r"^who\s+is\b", r"^when\s+did\b", r"^where\s+is\b", r"^which\b", r"\?$"],
}

#: Patterns of complexity.
SIMPLE = [r"^what\s+is\b", r"^who\s+is\b", r"^define\b"]
COMPLEX = [r"\band\b.*\band\b", r"\bmultiple\b", r"\bcomplex\b", r"\bcomprehensive\b", r"\banalyz\b", r"\bevaluate\b"]

#: Keyword families of query states, first match wins.
STATE_FAMILIES = {
    "procedural": ["how", "implement", "code", "function"],
    "factual": ["what", "define", "meaning", "concept"],
    "causal": ["why", "reason", "because", "explain"],
    "exemplar": ["example", "instance", "case", "scenario"],
    "comparative": ["compare", "difference", "versus", "vs"],
}

#: Parts of words that tell a task's type, first match wins.
TASK_TYPES = [("review", "code_review"), ("analyze", "analysis"), ("debug", "debugging"), ("fix", "debugging"), ("test", "testing"), ("document", "documentation"), ("architect", "architecture"), ("design", "architecture"), ("security", "security"), ("optim", "optimization"), ("refactor", "refactoring"), ("generat", "code_generation"), ("create", "code_generation"), ("build", "code_generation"), ("question", "quick_question"), ("what", "quick_question"), ("how", "quick_question"), ("why", "analysis")]

#: Opposed words and the kind of contradiction between them.
OPPOSITES = [("always", "never", "temporal contradiction"), ("all", "none", "universal contradiction"), ("true", "false", "boolean contradiction"), ("increase", "decrease", "directional contradiction"), ("yes", "no", "affirmation contradiction"), ("must", "cannot", "modal contradiction"), ("enable", "disable", "state contradiction"), ("include", "exclude", "set contradiction"), ("positive", "negative", "polarity contradiction"), ("accept", "reject", "decision contradiction")]

#: Words that make a memory salient, and bonuses of memory types.
SALIENT = ["error", "bug", "fix", "solution", "learned", "discovered", "important", "critical", "success", "failure", "insight", "pattern", "principle", "rule", "always", "never", "must"]
TYPE_BONUS = {"procedural": 0.15, "semantic": 0.10, "episodic": 0.0, "working": -0.1}

#: Personal data and what stands for it, in order of replacement.
PERSONAL = [(r"\b\d{3}-\d{2}-\d{4}\b", "[SSN]"), (r"\b[\w.+-]+@[\w-]+\.[\w.-]+\b", "[EMAIL]"), (r"\b\d{4}[- ]?\d{4}[- ]?\d{4}[- ]?\d{4}\b", "[CARD]"), (r"\b\d{3}[-.]?\d{3}[-.]?\d{4}\b", "[PHONE]"), (r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b", "[IP]"), (r"\b[A-Za-z0-9]{32,}\b", "[APIKEY]")]


def words(text: str | Column) -> Column:
    return F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")


def stripped(word: Column) -> Column:
    return F.btrim(word, F.lit(STRIPPED))


def keywords(text: str | Column, least: int = 3) -> Column:
    """Words of ``least`` characters and more that aren't stop words, stripped of punctuation; repeats stay."""
    stop = F.array(*map(F.lit, STOPWORDS))
    return F.filter(F.transform(words(text), stripped), lambda w: (F.length(w) >= least) & ~F.array_contains(stop, w))


def named_phrases(text: str | Column) -> Column:
    """Capitalised phrases, without one that begins the text."""
    found = F.regexp_extract_all(text, F.lit(r"\b[A-Z][a-zA-Z]+(?:\s+[A-Z][a-zA-Z]+)*\b"), F.lit(0))
    first = F.try_element_at(found, F.lit(1))
    return F.when(F.startswith(text, first), F.slice(found, 2, F.greatest(F.size(found) - 1, F.lit(0)))).otherwise(found)


def matches(text: str | Column, patterns: list[str]) -> Column:
    """How many of the patterns occur."""
    total = F.lit(0)
    for p in patterns:
        total = total + F.rlike(text, F.lit(p)).cast("int")
    return total


def best_of(scores: dict[str, Column], otherwise: str) -> Column:
    """Name of the largest positive score; the first on a tie."""
    top = F.greatest(*scores.values())
    out = F.when(top <= 0, otherwise)
    for name, s in scores.items():
        out = out.when(s == top, name)
    return out


def query_type(text: str | Column) -> Column:
    low = F.btrim(F.lower(text))
    return best_of({k: matches(low, p) for k, p in QUERY_TYPES.items()}, "factual")


def complexity(text: str | Column) -> Column:
    low = F.btrim(F.lower(text))
    hard, n = matches(low, COMPLEX), F.size(words(text))
    return F.when(hard >= 2, "complex").when((n > 15) | (hard >= 1), "medium").when((matches(low, SIMPLE) > 0) & (n < 8), "simple").otherwise("medium")


def first_family(text: str | Column, families: dict[str, list[str]] = STATE_FAMILIES, otherwise: str = "general") -> Column:
    low, out = F.lower(text), None
    for name, parts in families.items():
        hit = F.rlike(low, F.lit("|".join(parts)))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(otherwise)


def task_type(text: str | Column) -> Column:
    low, out = F.lower(text), None
    for part, name in TASK_TYPES:
        hit = F.contains(low, F.lit(part))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("general")


def memory_tier(kind: str | Column, name: str | Column) -> Column:
    kind, low = (F.col(kind) if isinstance(kind, str) else kind), F.lower(name)
    return (
        F.when(kind.isin("system_role", "core_system") | F.contains(low, F.lit("orchestrator")), "core")
        .when(kind.isin("project", "session") | F.contains(low, F.lit("current")), "working")
        .when(F.contains(low, F.lit("archive")) | F.contains(F.lower(kind), F.lit("historical")), "archive")
        .otherwise("reference")
    )


def masked(text: str | Column) -> Column:
    """The text with personal data replaced."""
    out = F.col(text) if isinstance(text, str) else text
    for pattern, token in PERSONAL:
        out = F.regexp_replace(out, "(?i)" + pattern, token)
    return out


def salience(text: str | Column, kind: str | Column) -> Column:
    text, kind = (F.col(x) if isinstance(x, str) else x for x in (text, kind))
    n = F.length(text)
    score = F.lit(0.5) + F.when((n >= 100) & (n <= 500), 0.1).when(n > 1000, -0.1).otherwise(0.0)
    score = score + F.least(F.lit(0.3), matches(F.lower(text), SALIENT) * 0.05)
    bonus = F.lit(0.0)
    for name, b in TYPE_BONUS.items():
        bonus = F.when(kind == name, b).otherwise(bonus)
    marks = F.rlike(text, F.lit(r"```|- |1\.|\* "))
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), score + bonus + F.when(marks, 0.1).otherwise(0.0)))


def compacted(text: str | Column, least: int = 50) -> Column:
    """The text with runs of white space as one space and without stop words between others; texts under ``least`` characters stay as they are."""
    text = F.col(text) if isinstance(text, str) else text
    stop = F.array(*map(F.lit, STOPWORDS))
    kept = F.filter(F.split(text, r"\s+"), lambda w: (w != "") & ~F.array_contains(stop, F.lower(w)))
    return F.when(F.length(text) >= least, F.array_join(kept, " ")).otherwise(text)


def jaccard(a: str | Column, b: str | Column) -> Column:
    """Of two arrays as sets; 0 when both are empty."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(0.0))


def sentences(text: str | Column) -> Column:
    """Sentences: cut after . ! ? before white space and a capital; abbreviations and decimals don't end one."""
    safe = F.regexp_replace(text, r"\b(Mr|Mrs|Ms|Dr|Prof|Sr|Jr|vs|etc)\.", "$1\u0001")
    safe = F.regexp_replace(safe, r"(\d)\.(\d)", "$1\u0001$2")
    parts = F.split(safe, r"(?<=[.!?])\s+(?=\p{Lu})")
    return F.filter(F.transform(parts, lambda s: F.btrim(F.replace(s, F.lit("\u0001"), F.lit(".")))), lambda s: s != "")


def arithmetic_verdict(text: str | Column) -> Column:
    """Checks the first claim "a op b = c": valid, blocked (wrong or divided by zero), or none."""
    pattern = r"(\d+(?:\.\d+)?)\s*([+\-*/])\s*(\d+(?:\.\d+)?)\s*=\s*(\d+(?:\.\d+)?)"
    part = lambda i: F.regexp_extract(text, pattern, i)
    a, b, c = (F.expr("1").cast("double") * part(i).try_cast("double") for i in (1, 3, 4))
    op = part(2)
    got = F.when(op == "+", a + b).when(op == "-", a - b).when(op == "*", a * b).when(b != 0, F.try_divide(a, b))
    return F.when(op == "", "none").when(got.isNull(), "blocked").when(F.abs(got - c) <= 1e-4, "valid").otherwise("blocked")
