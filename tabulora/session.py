"""SparkSession factory with the settings the engine is written for."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def get_session(app: str = "tabulora", cores: int | None = None, **conf) -> SparkSession:
    """A session in UTC with ANSI and adaptive execution on; an active session is reused."""
    n = cores or int(os.environ.get("BENCH_CPUS", os.cpu_count() or 4))
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.shuffle.partitions": str(n),
        "spark.driver.memory": "8g",
    } | {k: str(v) for k, v in conf.items()}
    return SparkSession.builder.master(f"local[{n}]").appName(app).config(map=settings).getOrCreate()
