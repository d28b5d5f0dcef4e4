"""What executors hold between the steps of a session."""

import os
import subprocess
import sys
from pathlib import Path

import pyspark

REPO = Path(__file__).resolve().parents[2]
SESSION = """
import sys
from pyspark.sql import SparkSession
from questmill.llm import common

top = sys.argv[1]
conf = {
    "spark.master": "local-cluster[2,1,1024]", "spark.executor.memory": "512m", "spark.checkpoint.dir": f"file://{top}/shared", "spark.ui.enabled": "false",
    "spark.driver.host": "127.0.0.1", "spark.sql.warehouse.dir": f"{top}/warehouse", "spark.executor.extraJavaOptions": f"-Xlog:gc:file={top}/gc-%p.log",
}
spark = SparkSession.builder.config(map=conf).getOrCreate()
docs = spark.range(0, 20_000, 1, 8).selectExpr("id", "repeat(cast(id as string), 200) as text")
assert common.written(docs.groupBy("id").agg({"text": "max"}), "one").count() == 20_000
common.COLLECT_S = 3600
common.written(docs, "two")  # soon after the first: nothing is collected again
spark.stop()
"""


def test_executors_collect_their_garbage_behind_a_step(tmp_path):
    (tmp_path / "home/work").mkdir(parents=True)
    for p in Path(pyspark.__file__).parent.iterdir():  # the workers' folders go below Spark's home
        if p.name != "work":
            (tmp_path / "home" / p.name).symlink_to(p)
    env = os.environ | {"SPARK_HOME": str(tmp_path / "home"), "PYTHONPATH": f"{REPO}:{os.environ.get('PYTHONPATH', '')}", "PYSPARK_PYTHON": sys.executable, "SPARK_LOCAL_IP": "127.0.0.1", "SPARK_SCALA_VERSION": "2.13"}
    env.pop("PYSPARK_GATEWAY_PORT", None), env.pop("PYSPARK_GATEWAY_SECRET", None)
    subprocess.run([sys.executable, "-c", SESSION, str(tmp_path)], env=env, cwd=tmp_path, check=True, timeout=180)
    logs = [p.read_text() for p in tmp_path.glob("gc-*.log")]
    assert len(logs) == 2
    assert [log.count("Pause Full (System.gc())") for log in logs] == [1, 1]
