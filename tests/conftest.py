from __future__ import annotations

import os
import sys
import time

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .appName("millrace-tests")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def drop_files(tmp_path):
    """Writes lists of JSON lines as one file each, arriving in the given order."""
    count = iter(range(10_000))
    start = time.time() - 20_000

    def drop(folder: str, *files: list[str]) -> str:
        target = tmp_path / folder
        target.mkdir(exist_ok=True)
        for lines in files:
            n = next(count)
            path = target / f"part-{n:05d}.json"
            path.write_text("\n".join(lines) + "\n")
            os.utime(path, (start + n, start + n))
        return str(target)

    return drop
