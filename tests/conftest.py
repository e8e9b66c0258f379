import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from codeloom.session import build_session
    s = build_session("tests", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g", "spark.checkpoint.dir": str(tmp_path_factory.mktemp("ckpt"))})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def make_files(spark):
    """{path: source} -> files table of one repository."""
    from pyspark.sql import functions as F

    from codeloom.functions.exprs import module_path

    def make(sources, repo="r"):
        rows = [(repo, p, p, s) for p, s in sources.items()]
        df = spark.createDataFrame(rows, "repo_id string, path string, relative_path string, source string")
        return df.withColumn("module_path", module_path(F.col("relative_path")))
    return make
