"""Readers and writers: JSON lines logs, exported agents, folders of text files, staged tables."""

from __future__ import annotations

import functools
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, the folder all executors share; a temporary one only where it is unset, in local mode.

    On a cluster a temporary folder would be another one on every machine.
    """
    key = "spark.checkpoint.dir"
    found = spark.conf.get(key, None) or spark.sparkContext.getConf().get(key)
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError(f"{key} must name a folder that the driver and all executors share")
        import tempfile

        found = "file://" + tempfile.mkdtemp(prefix="mnemospark-")
        spark.conf.set(key, found)
    return found.rstrip("/")


#: Paths made by the operator or query that runs, for its result to own; a list a thread.
_made: ContextVar[list[str] | None] = ContextVar("made", default=None)


def new_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; the result of the operator or query that asks for it owns it (see ``owner``)."""
    path = f"{shared_folder(spark)}/engine/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    if (own := _made.get()) is not None:
        own.append(path)
    return path


@contextmanager
def paths_made() -> Iterator[list[str]]:
    """The paths that are made inside; they count as made outside, too."""
    outer, own = _made.get(), []
    token = _made.set(own)
    try:
        yield own
    finally:
        _made.reset(token)
        if outer is not None:
            outer.extend(own)


def owner(f: Callable) -> Callable:
    """An operator or query whose result, a DataFrame, owns what was staged for it (see ``release``).

    If it fails, its tables are deleted at once.
    """

    @functools.wraps(f)
    def run(*args, **options):
        with paths_made() as paths:
            try:
                out = f(*args, **options)
            except BaseException:
                if (spark := SparkSession.getActiveSession()) is not None:
                    for path in paths:
                        delete(spark, path)
                raise
        if isinstance(out, DataFrame):
            out._owned = [*paths]
        return out

    return run


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def staged(df: DataFrame, name: str = "stage") -> DataFrame:
    """The rows written to the shared folder and reread: cuts the lineage, outlives lost executors; the job's shuffle files go as soon as it ends."""
    spark = df.sparkSession
    path = new_path(spark, name)
    with setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


_lock = threading.Lock()
#: How many threads hold a setting of a session, and what it was before the first of them.
_held: dict[tuple[int, str], list] = {}


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """The session's setting inside; the last of several threads that leave puts the old one back."""
    with _lock:
        held = _held.setdefault((id(spark), key), [0, spark.conf.get(key, None)])
        held[0] += 1
        spark.conf.set(key, value)
    try:
        yield
    finally:
        with _lock:
            held[0] -= 1
            if not held[0]:
                del _held[id(spark), key]
                if held[1] is None:
                    spark.conf.unset(key)
                else:
                    spark.conf.set(key, held[1])


def dropped(*tables: DataFrame) -> None:
    """Deletes tables made by ``staged`` that nothing reads any more."""
    for t in tables:
        delete(t.sparkSession, t._staged_at)
        if t._staged_at in (own := _made.get() or []):
            own.remove(t._staged_at)


def release(result: DataFrame | SparkSession) -> None:
    """Deletes the tables that were staged for a result, and nobody else's; the result can't be read afterwards. Of a session: all that its application has staged."""
    if isinstance(result, SparkSession):
        delete(result, f"{shared_folder(result)}/engine/{result.sparkContext.applicationId}")
        return
    for path in getattr(result, "_owned", ()):
        delete(result.sparkSession, path)
        if path in (own := _made.get() or []):
            own.remove(path)


def migrate(spark: SparkSession, path: str, migrations: list[tuple[str, dict[str, str]]]) -> DataFrame:
    """The table at ``path`` after all migrations (name, new or replaced columns as SQL expressions), each applied once, in order.

    Versions are folders below ``path`` ("v0" is the table as it began), and the
    log of applied migrations is a row a version, so a migration that was broken
    off is applied again. A migration keeps all other columns; one whose name is
    in the log is skipped; an empty table keeps its new columns.
    """
    schema = "version int, name string"
    fs = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/applied").getFileSystem(spark._jsc.hadoopConfiguration())
    log = spark.read.schema(schema).json(f"{path}/applied") if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/applied")) else spark.createDataFrame([], schema)
    done = {r.name: r.version for r in log.collect()}  # a row a migration
    version = max(done.values(), default=0)
    for name, columns in migrations:
        if name not in done:
            now = spark.read.parquet(f"{path}/v{version}").withColumns({c: F.expr(e) for c, e in columns.items()})
            version += 1
            now.write.mode("overwrite").parquet(f"{path}/v{version}")
            append_json_lines(spark.createDataFrame([(version, name)], schema), f"{path}/applied")
            done[name] = version
    return spark.read.parquet(f"{path}/v{version}")


def append_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def read_json_lines(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """A log with an explicit schema; lines that don't parse have nulls."""
    return spark.read.schema(schema).json(path)


def read_text_files(spark: SparkSession, path: str, pattern: str = "*.txt", most_bytes: int = 10 << 20) -> DataFrame:
    """(path, length, content, sha256) of text files below a folder, up to a size each."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return files.where(F.col("length") <= most_bytes).select("path", "length", F.decode("content", "UTF-8").alias("content"), F.sha2("content", 256).alias("sha256"))


def find_files(spark: SparkSession, path: str, text: str) -> DataFrame:
    """Files whose name contains a text; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")
    return files.where(F.contains(F.lower(F.element_at(F.split("path", "/"), -1)), F.lit(text.lower())))


def changed_files(now: DataFrame, indexed: DataFrame) -> DataFrame:
    """Files whose content isn't indexed yet."""
    return now.join(indexed.select("path", "sha256"), ["path", "sha256"], "left_anti")


def export_agent(entities: DataFrame, path: str, compress: bool = True, most: int = 1000) -> None:
    """The newest entities as JSON lines, optionally gzipped."""
    newest = entities.orderBy(F.desc("created_at"), "id").limit(most)
    newest.select(F.to_json(F.struct(*newest.columns)).alias("value")).write.mode("overwrite").text(path, compression="gzip" if compress else "none")


def import_agent(spark: SparkSession, path: str, schema: str, existing: DataFrame) -> DataFrame:
    """Entities of an export with a status: imported, or skipped where the name exists."""
    rows = spark.read.schema(schema).json(path)
    known = existing.select("name").distinct().withColumn("known", F.lit(True))
    return rows.join(known, "name", "left").withColumn("status", F.when(F.col("known"), "skipped").otherwise("imported")).drop("known")
