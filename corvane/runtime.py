"""Memory that stages need against what a session has, and a report of the system."""

from __future__ import annotations

import os
import platform
import re

import pyspark
from pyspark.sql import SparkSession

from corvane.config import Settings
from corvane.errors import ResourceError
from corvane.log import LOG

#: Memory (MB) of a task's share of JVM and Python worker before any data, and copies of the matrices a training holds at once.
TASK_MB, TRAINING_COPIES = 400, 3
#: Words a vocabulary is assumed to hold before it has been counted.
ASSUMED_WORDS = 200_000


def megabytes(text: str) -> int:
    """A size of a Spark setting, as in 4g or 512m, in MB; a bare number counts MB."""
    found = re.fullmatch(r"\s*(\d+)\s*([kmgt]?)b?\s*", text.lower())
    if not found:
        raise ResourceError(f"no size: {text!r}")
    n, unit = int(found.group(1)), found.group(2) or "m"
    return max(1, int(n * {"k": 1 / 1024, "m": 1, "g": 1024, "t": 1024 * 1024}[unit]))


def needed_mb(settings: Settings, stage: str, *, limit: int | None = None) -> int:
    """Memory (MB) one task needs for a stage: ``preprocess``, ``train``, ``index`` or ``search``.

    Data stream through tasks, so only what a task holds counts: the matrices
    of a training, the word vectors of pooling. A row limit lowers the assumed
    vocabulary.
    """
    if stage not in ("preprocess", "train", "index", "search"):
        raise ResourceError(f"no stage {stage!r}")
    words = ASSUMED_WORDS if limit is None else min(ASSUMED_WORDS, 200 * limit)
    buckets = settings.buckets if settings.model == "fasttext" else 0
    matrix = settings.vector_size * 4 / 1e6
    held = {"preprocess": 0, "train": TRAINING_COPIES * (2 * words + buckets) * matrix, "index": 2 * words * matrix, "search": 2 * words * matrix}[stage]
    return int(TASK_MB + held)


def available_mb(spark: SparkSession) -> int:
    """Memory (MB) of a session for one task: the executor's (locally the driver's), divided by its cores."""
    conf, sc = spark.sparkContext.getConf(), spark.sparkContext
    local = sc.master.startswith("local") and not sc.master.startswith("local-cluster")
    memory = megabytes(conf.get("spark.driver.memory", "1g") if local else conf.get("spark.executor.memory", "1g"))
    overhead = 0 if local else max(384, memory // 10)
    cores = sc.defaultParallelism if local else int(conf.get("spark.executor.cores", "1"))
    tasks = max(1, cores // int(conf.get("spark.task.cpus", "1")))
    return (memory + overhead) // tasks


def check_memory(spark: SparkSession, settings: Settings, stage: str, *, limit: int | None = None, strict: bool = False) -> bool:
    """Whether a task has the memory a stage needs; if not, a warning, or with ``strict`` a ``ResourceError``."""
    need, have = needed_mb(settings, stage, limit=limit), available_mb(spark)
    if have >= need:
        return True
    said = f"{stage} needs about {need} MB a task, {have} MB are there: give executors more memory or fewer cores, or set a row limit"
    if strict:
        raise ResourceError(said)
    LOG.warning(said)
    return False


def system_report(spark: SparkSession) -> dict[str, str]:
    """Versions, master, cores and memory of a session."""
    conf = spark.sparkContext.getConf()
    return {
        "python": platform.python_version(), "pyspark": pyspark.__version__, "spark": spark.version, "master": spark.sparkContext.master, "parallelism": str(spark.sparkContext.defaultParallelism),
        "driver_memory": conf.get("spark.driver.memory", "1g"), "executor_memory": conf.get("spark.executor.memory", "1g"), "task_mb": str(available_mb(spark)), "driver_cpus": str(os.cpu_count()),
    }
