"""Runs of a recipe: register, match, write evidence, count."""

from __future__ import annotations

import threading
import time
import warnings
from collections import Counter
from collections.abc import Callable
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import key_of
from ledgerloom.operators.asof import join_asof, nearest_in_groups
from ledgerloom.operators.metrics import match_counts
from ledgerloom.plans.bands import JoinParts, bucketed, sided, top_join
from ledgerloom.plans.evidence import RULE, EvidenceStore, RunMetadata, matched_records, unmatched_records
from ledgerloom.session import job_session
from ledgerloom.sources.filters import FilterCondition
from ledgerloom.sources.readers import register_source
from ledgerloom.sources.registry import Registry

FIXED = ("left_src", "right_src")


class MatchError(Exception):
    pass


@dataclass(frozen=True)
class JobSource:
    """uri: or an alias of the registry.  schema: the types of a CSV file's columns, as DDL; without one they are inferred by a pass of their own."""

    alias: str
    uri: str
    filters: tuple[FilterCondition, ...] = ()
    schema: str | None = None


@dataclass(frozen=True)
class JobRequest:
    """The first two sources are left and right; more are further views.  primary_keys: by alias.  candidates: whether unmatched records name the closest record of the other side."""

    run_id: str
    match_sql: str
    sources: tuple[JobSource, ...]
    primary_keys: dict[str, tuple[str, ...]]
    output_path: str
    recipe_id: str = ""
    candidates: bool = True


@dataclass(frozen=True)
class RunResult:
    run_id: str
    total_left: int
    total_right: int
    matched_count: int
    unmatched_left_count: int
    unmatched_right_count: int
    output_paths: dict[str, str] = field(default_factory=dict)


def output_key(columns: list[str], side: str, aliases: tuple[str, ...], key: tuple[str, ...], other_key: tuple[str, ...]) -> Column:
    """A side's key among the columns of a match: left_key or right_key, or each key column as "alias.name" or by its name if that can only be this side's."""
    count = Counter(columns)
    quoted = lambda name: F.col("`" + name + "`")
    if count[f"{side}_key"] == 1:
        return quoted(f"{side}_key").cast("string")
    parts = []
    for k in key:
        named = [f"{a}.{k}" for a in aliases if count[f"{a}.{k}"] == 1]
        if named:
            parts.append(quoted(named[0]))
        elif count[k] == 1 and k not in other_key:
            parts.append(quoted(k))
        else:
            raise MatchError(f"the match must return the {side} key {k!r} as {side}_key or \"{aliases[0]}.{k}\"; it returns {', '.join(columns)}")
    return key_of(parts)


def matched_pairs(session: SparkSession, request: JobRequest) -> DataFrame:
    """left_key, right_key of the rows that match_sql returns, without those that lack either."""
    left, right = request.sources[:2]
    found = bucketed(session.sql(request.match_sql))
    lk, rk = request.primary_keys[left.alias], request.primary_keys[right.alias]
    a = output_key(found.columns, "left", (left.alias, FIXED[0]), lk, rk)
    b = output_key(found.columns, "right", (right.alias, FIXED[1]), rk, lk)
    return found.select(a.alias("left_key"), b.alias("right_key")).where("left_key IS NOT NULL AND right_key IS NOT NULL")


#: Rows of one group that a task may take on at once.
GROUP = 100_000


def _small_groups(one: DataFrame, two: DataFrame, keys: list[str]) -> bool:
    """Whether no values of the keys have more than GROUP rows on both sides together; keys are counted by a hash into as many slots as are few to send."""
    slot = F.pmod(F.xxhash64(*keys), F.lit(SLOTS)).alias("slot")
    return one.select(slot).unionAll(two.select(slot)).groupBy("slot").count().where(F.col("count") > GROUP).isEmpty()


#: Slots that keys are counted in: two keys of one slot count as one, which only makes groups seem larger.
SLOTS = 1 << 16


def closest(parts: JoinParts | None, side: str, key: tuple[str, ...], other_key: tuple[str, ...], rest: DataFrame) -> DataFrame | None:
    """record_key, closest_candidate: for records of a side that matched nothing, the record of the other side that the match's
    join would have come nearest to: equal in what must be equal, and at the least distance of its tolerance or from the
    middle of its interval.  None if the match has no such join, or its inputs lack the keys."""
    own, other = (parts.left, parts.right) if parts and side == "left" else (parts.right, parts.left) if parts else (None, None)
    if own is None or not set(key) <= set(own.columns) or not set(other_key) <= set(other.columns):
        return None
    values = next(((found, band) for band in parts.bands if (found := sided(parts, band)) is not None), None)
    if values is None:
        return None
    (_, _, point, low, high), band = values
    middle = low / 2 + high / 2
    v, w = (point, middle) if band.point_side == side else (middle, point)
    i = 0 if side == "left" else 1
    shared = [f"equal_{n}" for n in range(len(parts.equal))]
    record = lambda df, k, value, at: df.select(key_of([F.col(f"`{c}`") for c in k]).alias("record_key"), value.alias("value"), *(e[at].alias(n) for e, n in zip(parts.equal, shared, strict=True))).where("record_key IS NOT NULL")
    every, others = record(own, key, v, i), record(other, other_key, w, 1 - i)
    if shared and _small_groups(every, others, shared):
        # records that matched are asked too: the join with the rest leaves them out, and sends nothing again
        return nearest_in_groups(every, others, shared).groupBy("record_key").agg(F.min("best").alias("b")).select("record_key", F.col("b.record_key").alias("closest_candidate"))
    asked = every.join(rest.distinct(), "record_key", "left_semi")
    near = join_asof(asked, others, "value", "value", shared, "nearest", ties=["record_key"], how="inner")
    best = F.min_by("record_key_right", F.struct(F.abs(F.col("value") - F.col("value_right")), "value_right", "record_key_right"))
    return near.groupBy("record_key").agg(best.alias("closest_candidate"))


ATTEMPTS, PAUSE = 3, 0.5


def _announce(tell, **more) -> None:
    """Says that a run is done, again if the receiver fails; a run that is done stays so whatever the receiver does."""
    for attempt in range(ATTEMPTS):
        try:
            return tell("completed", **more)
        except Exception as e:
            warnings.warn(f"the receiver of a run's events failed: {e}", stacklevel=2)
            time.sleep(PAUSE * attempt)


def plan_warning(found: DataFrame) -> str | None:
    """What a run says of a match whose rows are compared all with all."""
    plan = found._jdf.queryExecution().executedPlan().toString()
    if "CartesianProduct" in plan or "BroadcastNestedLoopJoin" in plan:
        return "the match has no equality: all rows are compared with all; bucket it as tolerance_join and window_join do"
    return None


class Watch:
    """Tells the tasks done and known of a run's job group while it runs, when they have changed."""

    def __init__(self, spark: SparkSession, group: str, tell: Callable[..., None], every: float = 0.25):
        self.tracker, self.group, self.tell, self.every = spark.sparkContext.statusTracker(), group, tell, every
        self._end, self._stages, self._told = threading.Event(), {}, None
        self._thread = threading.Thread(target=self._run, daemon=True)

    def look(self) -> None:
        for job in self.tracker.getJobIdsForGroup(self.group):
            info = self.tracker.getJobInfo(job)
            for stage in info.stageIds if info else ():
                known = self.tracker.getStageInfo(stage)
                if known:
                    self._stages[stage] = known.numCompletedTasks, known.numTasks
        done, known = (sum(x[i] for x in self._stages.values()) for i in (0, 1))
        if known and (done, known) != self._told:
            self._told = done, known
            self.tell("progress", tasks_done=done, tasks=known)

    def _run(self) -> None:
        while not self._end.wait(self.every):
            self.look()

    def __enter__(self) -> Watch:
        self._thread.start()
        return self

    def __exit__(self, *_) -> None:
        self._end.set()
        self._thread.join()
        self.look()


def run_job(spark: SparkSession, request: JobRequest, on_event: Callable[[dict], None] = lambda event: None, partitions: int = 4, registry: Registry | None = None) -> RunResult:
    """Matches the sources and writes the evidence.  on_event gets stages and, once, completed or failed.  registry: resolves sources that are given by an alias."""
    tell = lambda stage, **more: on_event({"run_id": request.run_id, "stage": stage, **more})
    now = lambda: datetime.now(timezone.utc).isoformat()
    store = metadata = None
    try:
        if len(request.sources) < 2:
            raise MatchError("a run needs two sources")
        left_source, right_source = request.sources[:2]
        for s in (left_source, right_source):
            if not request.primary_keys.get(s.alias):
                raise MatchError(f"source {s.alias!r} needs a primary key")
        session = job_session(spark)
        store = EvidenceStore(session, request.output_path)
        metadata = RunMetadata(request.run_id, request.recipe_id, now(), left_source.uri, right_source.uri)
        store.init_run(metadata)
        tell("staging")
        frames = []
        for i, s in enumerate(request.sources):
            uri = registry.resolve(s.uri) if registry else s.uri
            frames.append(register_source(session, s.alias, uri, list(s.filters), partitions, s.schema))
            if i < 2:
                frames[i].createOrReplaceTempView(FIXED[i])
        left, right = frames[:2]
        found = matched_pairs(session, request)
        warning = plan_warning(found)
        tell("matching", **({"warning": warning} if warning else {}))
        parts = top_join(session.sql(request.match_sql)) if request.candidates else None
        # the evidence is written first, then read: the match runs once for counts and unmatched rows
        matched_path = store.write_matched(request.run_id, matched_records(found, F.col("left_key"), F.col("right_key"), now()))
        matched = session.read.parquet(matched_path)
        counts = match_counts(matched, left, right, F.col("left_key"), F.col("right_key")).first()
        tell("writing", matched_count=counts["matched_count"])
        paths = {"matched": matched_path}
        for side, frame, source in (("left", left, left_source), ("right", right, right_source)):
            key = key_of([F.col(f"`{k}`") for k in request.primary_keys[source.alias]])
            rows = frame.select(key.alias("record_key"))
            rest = rows.join(matched.select(F.col(f"{side}_key").alias("record_key")), "record_key", "left_anti")
            keys = [request.primary_keys[s.alias] for s in ((left_source, right_source) if side == "left" else (right_source, left_source))]
            near = closest(parts, side, *keys, rest)
            paths[f"unmatched_{side}"] = store.write_unmatched(request.run_id, side, unmatched_records(rest, F.col("record_key"), [RULE], candidates=near))
        result = RunResult(request.run_id, counts["total_left"], counts["total_right"], counts["matched_count"], counts["unmatched_left_count"], counts["unmatched_right_count"], paths)
        metadata.completed_at, metadata.status = now(), "completed"
        metadata.left_record_count, metadata.right_record_count, metadata.matched_count = result.total_left, result.total_right, result.matched_count
        metadata.unmatched_left_count, metadata.unmatched_right_count = result.unmatched_left_count, result.unmatched_right_count
        store.update_metadata(metadata)
    except Exception as e:
        if store is not None and metadata is not None:
            metadata.completed_at, metadata.status = now(), "failed"
            store.update_metadata(metadata)
        tell("failed", error=str(e))
        raise
    _announce(tell, matched_count=result.matched_count, unmatched_left_count=result.unmatched_left_count, unmatched_right_count=result.unmatched_right_count, output_paths=result.output_paths)
    return result


class QueueFull(Exception):
    pass


class JobService:
    """Runs several jobs at a time in one application: each in a job group, by which it can be cancelled, and a scheduler pool
    of its own, so that with spark.scheduler.mode=FAIR jobs share the executors.  At most ``waiting`` jobs wait."""

    def __init__(self, spark: SparkSession, at_a_time: int = 4, waiting: int = 100, registry: Registry | None = None):
        self.spark, self.registry, self.waiting = spark, registry, waiting
        self._pool, self._lock, self._counts = ThreadPoolExecutor(at_a_time), threading.Lock(), Counter()
        self._futures: dict[str, Future] = {}
        self._stopped: set[str] = set()

    def submit(self, request: JobRequest, on_event: Callable[[dict], None] = lambda event: None) -> Future:
        with self._lock:
            if self._counts["queued"] >= self.waiting:
                raise QueueFull(f"{self.waiting} runs are waiting")
            self._counts["queued"] += 1
            self._stopped.discard(request.run_id)
            future = self._futures[request.run_id] = self._pool.submit(self._run, request, on_event)
        return future

    def cancel(self, run_id: str) -> bool:
        """Stops a run that waits or runs; a running one ends as failed.  False if there is no such run."""
        with self._lock:
            future = self._futures.get(run_id)
            if future is None or future.done():
                return False
            self._stopped.add(run_id)
        if future.cancel():
            self._count(queued=-1, failed=1)
            self._forget(run_id)
        else:
            self.spark.sparkContext.cancelJobGroup(run_id)
        return True

    def _count(self, **change: int) -> None:
        with self._lock:
            for k, v in change.items():
                self._counts[k] += v

    def _forget(self, run_id: str) -> None:
        with self._lock:
            self._futures.pop(run_id, None)

    def _run(self, request: JobRequest, on_event) -> RunResult:
        self._count(queued=-1, active=1)
        sc = self.spark.sparkContext
        sc.setJobGroup(request.run_id, f"run {request.run_id}", interruptOnCancel=True)
        sc.setLocalProperty("spark.scheduler.pool", request.run_id)

        def told(event: dict) -> None:
            if request.run_id in self._stopped and event["stage"] not in ("failed", "completed"):
                raise MatchError("cancelled")  # between two of its jobs
            on_event(event)

        try:
            with Watch(self.spark, request.run_id, lambda stage, **more: on_event({"run_id": request.run_id, "stage": stage, **more})):
                result = run_job(self.spark, request, told, registry=self.registry)
            self._count(completed=1)
            return result
        except Exception:
            self._count(failed=1)
            raise
        finally:
            sc.setLocalProperty("spark.scheduler.pool", None)
            sc.setLocalProperty("spark.jobGroup.id", None)
            self._count(active=-1)
            self._forget(request.run_id)

    def metrics(self) -> dict[str, int]:
        with self._lock:
            return {k: self._counts[k] for k in ("active", "queued", "completed", "failed")}

    def close(self) -> None:
        self._pool.shutdown(wait=True)
