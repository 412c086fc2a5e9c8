from __future__ import annotations

import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    got = (
        SparkSession.builder.master("local[4]").appName("tests")
        .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "3g")
        .config("spark.executorEnv.PYTHONPATH", str(ROOT)).getOrCreate()
    )
    got.sparkContext.setLogLevel("ERROR")
    got.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoint")))
    got.sparkContext.environment["PYTHONPATH"] = str(ROOT)
    yield got
    got.stop()
