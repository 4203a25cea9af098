"""Timed jobs over a ladder of datasets, with a stop rule, and the same jobs as a matrix of backends."""

from __future__ import annotations

import resource
import time
from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import families, metrics, pools, search
from ..sources import binary_lists
from . import programs

RESULT = "dataset string, job string, status string, seconds double, n_rows bigint, peak_kb bigint, error string"


@dataclass(frozen=True)
class Job:
    """Work over one dataset of a catalogue, and the entries it needs."""

    name: str
    needs: tuple[str, ...]
    run: Callable[[SparkSession, Mapping[str, str]], DataFrame]


def _postings(spark: SparkSession, dataset: Mapping[str, str]) -> DataFrame:
    return programs.postings_of(spark, dataset["docs_packed_path"])


def _family(spark: SparkSession, dataset: Mapping[str, str]) -> DataFrame:
    """The number of distinct lists of global ids, and the nodes of their shared diagram."""
    lists = binary_lists.scan(spark, dataset["docs_global_path"]).select(F.lit("all").alias("family"), "items")
    return families.cardinality(lists, "family", "items").join(metrics.family_nodes(lists, "family", "items"), "family")


JOBS = (
    Job("build", ("docs_packed_path",), lambda s, d: programs.summary(_postings(s, d))),
    Job("search", ("docs_packed_path",), lambda s, d: search.pattern_counts(_postings(s, d))),
    Job("pool", ("docs_packed_path",), lambda s, d: metrics.pool_nodes(pools.versions_of_pairs(_postings(s, d)), "rels")),
    Job("family", ("docs_global_path",), _family),
)


def _run(spark: SparkSession, dataset: Mapping[str, str], job: Job, limit: float) -> tuple:
    begin, n, status, error = time.perf_counter(), None, "ok", None
    if any(not dataset.get(k) for k in job.needs):
        return dataset["id"], job.name, "skipped", 0.0, None, None, None
    try:
        n = job.run(spark, dataset).count()
    except Exception as e:  # a job that fails is a row of the result
        status, error = "failed", str(e)[:500]
    seconds = time.perf_counter() - begin
    if status == "ok" and seconds > limit:
        status = "threshold_exceeded"
    return dataset["id"], job.name, status, seconds, n, resource.getrusage(resource.RUSAGE_SELF).ru_maxrss, error


def climb(spark: SparkSession, datasets: Iterable[Mapping[str, str]], jobs: Sequence[Job] = JOBS, minutes: float = 30.0, stop: bool = True) -> DataFrame:
    """A row per dataset and job: ok, failed, threshold_exceeded, or skipped where the dataset lacks what the job needs.

    With ``stop`` the first job that fails or takes longer than ``minutes`` is the last; without, all run, as a matrix.
    """
    rows: list[tuple] = []
    for dataset in datasets:
        for job in jobs:
            rows.append(_run(spark, dataset, job, 60 * minutes))
            if stop and rows[-1][2] in ("failed", "threshold_exceeded"):
                return spark.createDataFrame(rows, RESULT)
    return spark.createDataFrame(rows, RESULT)
