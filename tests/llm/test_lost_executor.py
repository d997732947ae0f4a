"""An executor that is lost after results are released is replaced, and later jobs run on the new one."""

import os
import subprocess
import sys
from pathlib import Path

SCRIPT = """
import sys, time
import psutil
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

shared = sys.argv[1]
spark = SparkSession.builder.master("local-cluster[1,2,1024]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", "file://" + shared).config("spark.sql.shuffle.partitions", "3").config("spark.executorEnv.PYTHONPATH", sys.argv[2]).getOrCreate()
spark.sparkContext.setLogLevel("OFF")

from mnemospark.llm import bpe
from mnemospark.llm._common import owner, release
from mnemospark.llm.queries import TOKENIZER

docs = spark.createDataFrame([(k, f"the word {k % 7} again, the word") for k in range(200)], "doc_id long, text string")

@owner
def encoded():
    return bpe.encode(docs, TOKENIZER, bpe.build_lexicon(docs, TOKENIZER))

def lose():
    for p in psutil.Process().children(recursive=True):
        if "CoarseGrainedExecutorBackend" in " ".join(p.cmdline()):
            p.kill()
    time.sleep(1)

first = encoded()
assert first.select(F.sum(F.size("ids"))).first()[0] > 0
lose()
again = first.select(F.sum(F.size("ids"))).first()[0]  # a new executor has the lexicon
release(first)
lose()
print("counted", spark.range(100).repartition(2).count(), again > 0, encoded().count())
"""


def test_released_results_are_not_needed(tmp_path):
    repo = str(Path(__file__).parents[2])
    shared = tmp_path / "shared"
    shared.mkdir()
    home = tmp_path / "home"  # executors log in Spark's home
    home.mkdir()
    import pyspark

    for p in Path(pyspark.__file__).parent.iterdir():
        if p.name != "work":
            (home / p.name).symlink_to(p)
    env = os.environ | {"PYTHONPATH": repo, "SPARK_HOME": str(home), "PYSPARK_PYTHON": sys.executable, "SPARK_SCALA_VERSION": "2.13"}
    env.pop("PYSPARK_GATEWAY_PORT", None)
    run = subprocess.run([sys.executable, "-c", SCRIPT, str(shared), repo], env=env, cwd=repo, capture_output=True, text=True, timeout=240)
    assert "counted 100 True 200" in run.stdout, run.stdout[-2000:] + run.stderr[-2000:]
