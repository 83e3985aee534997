"""The session of a job: its own views and functions, the settings of the one it comes from."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.functions import register

#: Runtime settings that a job takes over; newSession() starts from the defaults.
INHERITED = ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone", "spark.sql.autoBroadcastJoinThreshold", "spark.sql.files.maxPartitionBytes", "spark.sql.adaptive.advisoryPartitionSizeInBytes")


def job_session(spark: SparkSession) -> SparkSession:
    """A session isolated from other jobs, in which "name" is an identifier and the SQL functions exist."""
    own = spark.newSession()
    for name in INHERITED:
        value = spark.conf.get(name, None)
        if value is not None:
            own.conf.set(name, value)
    own.conf.set("spark.sql.ansi.doubleQuotedIdentifiers", "true")
    own.conf.set("spark.sql.adaptive.enabled", "true")
    own.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    return register(own)


def shared_folder(spark: SparkSession) -> str:
    """Where executors and driver can write: spark.checkpoint.dir, or on one machine a temporary folder where that is unset."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="shared-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named.rstrip("/")


def durable(df: DataFrame) -> DataFrame:
    """Cuts the lineage of a round through the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
