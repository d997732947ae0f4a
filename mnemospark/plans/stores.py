"""Files, logs, exports, payloads and resumed jobs, each written to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from mnemospark.functions import scores as S
from mnemospark.functions import vector as V
from mnemospark.operators import chunking as C
from mnemospark.operators import topk as K
from mnemospark.plans.registry import query
from mnemospark.sources import storage
from mnemospark.sources import tables as T
from mnemospark.sources.tables import ctes


def rows():
    return F.count(F.lit(1))


def _folder(spark) -> str:
    return storage.new_path(spark, "files")


def _tier_files(spark, sf) -> str:
    """Texts as files, a folder for each tier."""
    path = _folder(spark)
    T.entities(spark, sf).select("tier", "content").where("content IS NOT NULL").write.partitionBy("tier").text(path)
    return path


@query("s06_index_files", ctes("entities") + "SELECT tier, CAST(sum(strlen(content) + 1) AS BIGINT) AS bytes FROM entities WHERE content IS NOT NULL AND tier IN ('core', 'semantic') GROUP BY tier")
def index_files(spark, sf):
    """Scans a folder of text files; files whose path and digest are indexed already (two of the four tiers) are left out."""
    files = storage.read_text_files(spark, _tier_files(spark, sf), most_bytes=1 << 31)
    tier = F.regexp_extract("path", r"tier=(\w+)", 1)
    fresh = storage.changed_files(files, files.where(tier.isin("working", "episodic")))
    return fresh.groupBy(tier.alias("tier")).agg(F.sum("length").alias("bytes"))


@query("s07_find_files", ctes("entities") + "SELECT DISTINCT tier FROM entities")
def find_files(spark, sf):
    found = storage.find_files(spark, _tier_files(spark, sf), "PART-")
    return found.select(F.regexp_extract("path", r"tier=(\w+)", 1).alias("tier")).distinct()


@query("s08_append_log", "SELECT event_type, 2 * count(*) AS n FROM events GROUP BY 1")
def append_log(spark, sf):
    path = _folder(spark)
    log = T.base(spark, sf, "events").select("event_id", "event_type")
    storage.append_json_lines(log, path)
    storage.append_json_lines(log, path)
    return storage.read_json_lines(spark, path, "event_id long, event_type string").groupBy("event_type").agg(rows().alias("n"))


@query("s10_export_agent", ctes("entities") + ", x AS (SELECT id, name FROM entities ORDER BY created_at DESC, id LIMIT 1000) SELECT count(*) AS n, CAST(sum(id) AS BIGINT) AS ids, CAST(sum(length(name)) AS BIGINT) AS chars FROM x")
def export_agent(spark, sf):
    path = _folder(spark)
    storage.export_agent(T.entities(spark, sf).select("id", "name", "created_at"), path)
    back = storage.read_json_lines(spark, path, "id long, name string")
    return back.agg(rows().alias("n"), F.sum("id").alias("ids"), F.sum(F.length("name")).cast("long").alias("chars"))


@query("s12_encode_payload", ctes("entities") + "SELECT id, sha256('{\"name\":\"' || name || '\",\"tier\":\"' || tier || '\",\"access_count\":' || access_count || '}') AS digest FROM entities")
def encode_payload(spark, sf):
    return T.entities(spark, sf).select("id", F.sha2(F.to_json(F.struct("name", "tier", "access_count")), 256).alias("digest"))


@query("s15_short_checksum", ctes("observations") + "SELECT entity_id, seq, substr(sha256(content), 1, 16) AS checksum FROM observations".replace("seq,", "CAST(seq AS INTEGER) AS seq,"))
def short_checksum(spark, sf):
    return T.observations(spark, sf).select("entity_id", "seq", F.substring(F.sha2("content", 256), 1, 16).alias("checksum"))


@query("s18_regenerate_vectors", ctes("vectors") + ", n AS (SELECT id, v, sqrt(list_dot_product(v, v)) AS n FROM vectors) SELECT id, round(v[1] / n, 6) AS first, round(v[64] / n, 6) AS last FROM n WHERE n > 0")
def regenerate_vectors(spark, sf):
    """All vectors anew, at unit length; zero vectors are skipped."""
    v = T.vectors(spark, sf).withColumn("n", V.norm("v")).where("n > 0")
    return v.select("id", S.rounded(F.col("v")[0] / F.col("n")).alias("first"), S.rounded(F.col("v")[63] / F.col("n")).alias("last"))


@query("s21_checkpointed_job", ctes("entities") + "SELECT CASE WHEN tier IN ('core', 'working') THEN 'before' ELSE 'resumed' END AS run, count(*) AS n FROM entities GROUP BY 1")
def checkpointed_job(spark, sf):
    """A job that was stopped after two tiers goes on with what its written ids lack."""
    e = T.entities(spark, sf).select("id", "tier")
    done = storage.staged(e.where("tier IN ('core', 'working')").select("id"), "done")
    rest = e.join(done, "id", "left_anti").select(F.lit("resumed").alias("run"))
    return done.select(F.lit("before").alias("run")).unionByName(rest).groupBy("run").agg(rows().alias("n"))


@query("f15_intersections", ctes("entities", "vectors") + "SELECT e.id AS id, round(importance * label / 9.0, 6) AS score FROM entities e JOIN vectors v ON e.id = v.id WHERE importance * label / 9.0 >= 0.7 ORDER BY importance * label / 9.0 DESC, e.id LIMIT 50")
def intersections(spark, sf, least: float = 0.7):
    e, v = T.entities(spark, sf).select("id", "importance"), T.vectors(spark, sf).select("id", "label")
    j = e.join(v, "id").withColumn("s", F.col("importance") * F.col("label") / 9.0).where(F.col("s") >= least)
    return j.orderBy(F.desc("s"), "id").limit(50).select("id", S.rounded("s").alias("score"))


@query("u01_union_lists", ctes("entities") + ", u AS (SELECT id, name, 0 AS o FROM entities WHERE tier = 'core' UNION ALL SELECT id, name, 1 FROM entities WHERE id % 3 = 0 UNION ALL SELECT id, name, 2 FROM entities WHERE id % 7 = 0) SELECT id, name, min(o) AS source FROM u GROUP BY 1, 2")
def union_lists(spark, sf):
    e = T.entities(spark, sf).select("id", "name", "tier")
    lists = [e.where(c).select("id", "name", F.lit(i).alias("source")) for i, c in enumerate(("tier = 'core'", "id % 3 = 0", "id % 7 = 0"))]
    return K.combine(lists, "name")


@query("t16_merged_chunks")
def merged_chunks(spark, sf):
    return C.semantic(T.base(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text"), 1200, 0.02)


@query("t35_formatted", ctes("entities") + "SELECT id, printf('%s (%s): %d', name, tier, access_count) AS line FROM entities")
def formatted(spark, sf):
    return T.entities(spark, sf).select("id", F.printf(F.lit("%s (%s): %d"), "name", "tier", "access_count").alias("line"))


@query("t43_iso_week", ctes("actions") + "SELECT CAST(isoyear(executed_at) AS INTEGER) AS year, CAST(week(executed_at) AS INTEGER) AS week, count(*) AS n FROM actions GROUP BY 1, 2")
def iso_week(spark, sf):
    return T.actions(spark, sf).groupBy(F.expr("extract(YEAROFWEEK FROM executed_at)").alias("year"), F.weekofyear("executed_at").alias("week")).agg(rows().alias("n"))


@query("s27_migrations", ctes("entities") + "SELECT id, tier, access_count, access_count >= 25 AS hot, CASE WHEN access_count >= 25 THEN 'hot:' || tier ELSE tier END AS shelf FROM entities")
def migrations(spark, sf):
    """A stored table with two migrations, of which the second reads what the first has added; a repeated run applies nothing."""
    path = _folder(spark)
    T.entities(spark, sf).select("id", "tier", "access_count").write.parquet(f"{path}/v0")
    steps = [("add_hot", {"hot": "access_count >= 25"}), ("add_shelf", {"shelf": "CASE WHEN hot THEN 'hot:' || tier ELSE tier END"})]
    storage.migrate(spark, path, steps[:1])
    storage.migrate(spark, path, steps)
    return storage.migrate(spark, path, steps).select("id", "tier", "access_count", "hot", "shelf")
