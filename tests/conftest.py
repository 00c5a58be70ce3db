from __future__ import annotations

import sys
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from objectlog import ObjectLog, configure  # noqa: E402

START = datetime(2024, 1, 1)
HOUR = timedelta(hours=1)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    if session.conf.get("spark.checkpoint.dir", None) is None:
        session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))
    yield configure(session)
    session.stop()


@pytest.fixture(scope="session")
def make_log(spark):
    """Log from {object_id: type} and (event_id, type, time, [object ids]) tuples."""

    def make(objects: dict[str, str], events, qualifiers=None) -> ObjectLog:
        times = {e[0]: e[2] for e in events}
        first: dict[str, datetime] = {}
        for _id, _type, time, ids in events:
            for i in ids:
                first[i] = min(first.get(i, time), time)
        rows = [(e, o, (qualifiers or {}).get((e, n), f"q{n}"), times[e]) for e, _t, _m, ids in events for n, o in enumerate(ids)]
        stamp = "timestamp_ntz"
        return ObjectLog(
            {
                "event": spark.createDataFrame([e[:3] for e in events], f"event_id string, type string, time {stamp}"),
                "object": spark.createDataFrame(
                    [(o, t, first.get(o, START)) for o, t in objects.items()], f"object_id string, type string, time {stamp}"
                ),
                "e2o": spark.createDataFrame(rows, f"event_id string, object_id string, qualifier string, time {stamp}"),
            }
        )

    return make
