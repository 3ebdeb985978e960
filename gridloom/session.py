"""Session settings under which the engine's semantics hold."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Settings that results depend on: checked arithmetic, UTC, duplicate map keys resolved instead of raised.
SEMANTICS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
}

#: Settings that only the plan depends on.
TUNING = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build(master: str = "local[*]", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session for tests, benches and notebooks; on a cluster, use its own and ``configure`` it."""
    builder = SparkSession.builder.master(master).appName("gridloom")
    settings = SEMANTICS | TUNING | {"spark.sql.shuffle.partitions": str(shuffle_partitions), "spark.ui.enabled": "false", "spark.driver.memory": "8g"} | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    return configure(builder.getOrCreate())


def configure(spark: SparkSession) -> SparkSession:
    """Set what results depend on in a session that exists; its tuning stays its owner's."""
    for key, value in SEMANTICS.items():
        spark.conf.set(key, value)
    return spark
