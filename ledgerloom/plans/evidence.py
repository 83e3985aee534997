"""The audit records of a run: Parquet tables and a JSON file, on any file system that Spark writes."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RULE, CONFIDENCE = "match_sql", 1.0


@dataclass
class RunMetadata:
    run_id: str
    recipe_id: str
    started_at: str
    left_source: str
    right_source: str
    completed_at: str | None = None
    left_record_count: int = 0
    right_record_count: int = 0
    matched_count: int = 0
    unmatched_left_count: int = 0
    unmatched_right_count: int = 0
    status: str = "running"


def matched_records(pairs: DataFrame, left_key, right_key, matched_at: str, rule: str = RULE, confidence: float = CONFIDENCE) -> DataFrame:
    """match_id, left_key, right_key, rule_name, confidence, matched_at.  The id is a hash of both keys: a task that runs again gives the same one."""
    h = F.md5(F.concat_ws("|", left_key, right_key))
    uuid = F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))
    return pairs.select(uuid.alias("match_id"), left_key.alias("left_key"), right_key.alias("right_key"), F.lit(rule).alias("rule_name"), F.lit(confidence).alias("confidence"), F.lit(matched_at).cast("timestamp").alias("matched_at"))


NO_MATCH, NEAR_MISS = "no match", "outside tolerance"


def unmatched_records(rows: DataFrame, key, rules: list[str], reason: str = NO_MATCH, candidates: DataFrame | None = None) -> DataFrame:
    """record_key, attempted_rules (a JSON array), closest_candidate, rejection_reason.  candidates: record_key, closest_candidate, one row a key at most."""
    records = rows.select(key.alias("record_key"))
    if candidates is None:
        found = records.withColumn("closest_candidate", F.lit(None).cast("string"))
    else:
        found = records.join(candidates, "record_key", "left")
    why = F.when(F.col("closest_candidate").isNotNull(), NEAR_MISS).otherwise(reason)
    return found.select("record_key", F.lit(json.dumps(rules)).alias("attempted_rules"), "closest_candidate", why.alias("rejection_reason"))


class EvidenceStore:
    """Folders runs/<run_id> below a base path."""

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base.rstrip("/")

    def path(self, run_id: str, name: str = "") -> str:
        if not run_id or "/" in run_id or run_id.startswith("."):
            raise ValueError(f"{run_id!r} can't be a run's id")
        return f"{self.base}/runs/{run_id}" + (f"/{name}" if name else "")

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def init_run(self, metadata: RunMetadata) -> str:
        p, fs = self._fs(self.path(metadata.run_id))
        fs.mkdirs(p)
        self.update_metadata(metadata)
        return self.path(metadata.run_id)

    def update_metadata(self, metadata: RunMetadata) -> None:
        p, fs = self._fs(self.path(metadata.run_id, "metadata.json"))
        out = fs.create(p, True)
        try:
            out.write(bytearray(json.dumps(asdict(metadata), indent=2).encode()))
        finally:
            out.close()

    def metadata(self, run_id: str) -> RunMetadata:
        text = "\n".join(r[0] for r in self.spark.read.text(self.path(run_id, "metadata.json"), wholetext=True).collect())
        return RunMetadata(**json.loads(text))

    def _write(self, df: DataFrame, run_id: str, name: str) -> str:
        path = self.path(run_id, name)
        df.write.option("compression", "snappy").mode("overwrite").parquet(path)
        return path

    def write_matched(self, run_id: str, records: DataFrame) -> str:
        return self._write(records, run_id, "matched.parquet")

    def write_unmatched(self, run_id: str, side: str, records: DataFrame) -> str:
        if side not in ("left", "right"):
            raise ValueError("side is left or right")
        return self._write(records, run_id, f"unmatched_{side}.parquet")

    def latest_run(self) -> str | None:
        """The run whose folder changed last."""
        p, fs = self._fs(f"{self.base}/runs")
        if not fs.exists(p):
            return None
        found = sorted((s.getModificationTime(), s.getPath().getName()) for s in fs.listStatus(p) if s.isDirectory())
        return found[-1][1] if found else None
