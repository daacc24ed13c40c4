"""Session defaults shared by the command line, the bench and the tests."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def get_session(app: str = "sediment", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, Arrow and UTC; ``conf`` overrides any setting.

    ``master`` is only set when given, so that a cluster's own submit settings win.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    if master and master.startswith("local"):
        defaults["spark.sql.shuffle.partitions"] = str(os.cpu_count() or 8)
        defaults["spark.driver.memory"] = os.environ.get("SEDIMENT_DRIVER_MEMORY", "8g")
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
