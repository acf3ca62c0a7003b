import os
import sys
from pathlib import Path

import pytest

HERE = Path(__file__).resolve().parent
for folder in (HERE / "llm", HERE, HERE.parent):
    sys.path.insert(0, str(folder))
# Workers import what tests hand them.
os.environ["PYTHONPATH"] = ":".join([*map(str, (HERE.parent, HERE, HERE / "llm")), os.environ.get("PYTHONPATH", "")])


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "6g")
        .config("spark.checkpoint.dir", "file://" + str(tmp_path_factory.mktemp("shared")))
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
