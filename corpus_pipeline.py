"""Five stages over documents: quality rules, line dedup, near-dedup, decontamination, mixing."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from nightloom.llm.common import Workspace, documents, small_broadcasts
from nightloom.llm.decontaminate import clean_of_benchmark
from nightloom.llm.line_dedup import without_repeats
from nightloom.llm.mixing import to_weights
from nightloom.llm.near_dedup import one_of_each
from nightloom.llm.quality_rules import good_only



def lean(stage):
    """The stage with small broadcasts: five stages run hundreds of jobs in one driver."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        small_broadcasts(spark)
        return stage(spark, docs, sf_dir)

    return run_stage


STAGES = [
    ("quality_rules", lean(good_only)),
    ("line_dedup", lean(without_repeats)),
    ("near_dedup", lean(one_of_each)),
    ("decontaminate", lean(clean_of_benchmark)),
    ("mix_sources", lean(to_weights)),
]

#: Robust estimates, MinHash and Newton's iterations have no SQL form; tests hold the stages
#: against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's result is written to the shared folder and read again by the next."""
    docs, work = documents(spark, sf_dir), Workspace(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = work.keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
