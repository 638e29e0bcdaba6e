"""Reading what Spark ran: plan text and shuffle sizes."""

from __future__ import annotations

import re
from contextlib import contextmanager
from itertools import count

from pyspark.sql import DataFrame, SparkSession

_groups = count()


def executed_plan(df: DataFrame) -> str:
    """The final plan, subqueries included, after running ``df``."""
    df.collect()
    text = df._jdf.queryExecution().executedPlan().toString()
    # Adaptive execution prints every plan twice: as run, and before that.
    kept, skip_at = [], None
    for line in text.splitlines():
        indent = len(line) - len(line.lstrip(" :+-"))
        if skip_at is not None and indent > skip_at:
            continue
        initial = line.find("+- == Initial Plan ==")
        skip_at = initial if initial >= 0 else None
        if skip_at is None:
            kept.append(line)
    return "\n".join(kept)


def scans(plan: str, table: str) -> list[str]:
    """The columns of each scan of ``table``."""
    found = []
    for line in plan.splitlines():
        if "FileScan" in line and f"/{table}.parquet" in line:
            found.append(re.search(r"ReadSchema: struct<(.*)>", line).group(1))
    return found


@contextmanager
def shuffled(spark: SparkSession):
    """Collect what the jobs run inside shuffled.

    ``records`` counts the rows written to shuffles; ``largest_read`` is the most
    shuffled rows any one task read.
    """
    store = spark.sparkContext._jsc.sc().statusStore()
    tracker = spark.sparkContext.statusTracker()
    group = f"shuffled-{next(_groups)}"
    found: dict[str, int] = {}
    spark.sparkContext.setJobGroup(group, group)
    try:
        yield found
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    ids = {s for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds}
    records = largest = 0
    for stage_id in ids:
        stage = store.lastStageAttempt(stage_id)
        status = stage.status().toString()
        if status == "SKIPPED":  # what it would have made was there already
            continue
        assert status == "COMPLETE", f"stage {stage_id} is {status}"
        records += stage.shuffleWriteRecords()
        n_tasks = stage.numTasks()
        tasks = store.taskList(stage_id, stage.attemptId(), 2 * n_tasks + 1)
        assert n_tasks <= tasks.size() <= 2 * n_tasks, f"stage {stage_id}: {tasks.size()} of {n_tasks} tasks seen"
        for i in range(tasks.size()):
            metrics = tasks.apply(i).taskMetrics()
            if metrics.isDefined():
                largest = max(largest, metrics.get().shuffleReadMetrics().recordsRead())
    found["records"] = records
    found["largest_read"] = largest
