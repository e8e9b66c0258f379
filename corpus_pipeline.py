"""From raw documents to a training mix: five stages, each an operator of ``codeloom.llm``.

    language ID -> toxicity -> near-duplicates -> benchmark decontamination -> mixing sources

Every stage gets the documents that the stage before kept, written as Parquet and read again, so that a lost executor
never costs more than one stage.  The last stage adds how often a document is taken (``copies``).

Defined results: what is said of nulls, empty and long texts, ties and repeated rows where the operators are defined
holds for the stages.  Texts that are null or have no letter go with the first stage; equal rows are one document from
the third on.  Further columns of any name are kept.  An empty table gives an empty mix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from codeloom.llm import decontaminate, langid, mixing, neardup, toxicity
from codeloom.llm.common import cut

STAGES = [
    ("language_id", langid.stage),
    ("toxicity", toxicity.stage),
    ("near_duplicates", neardup.stage),
    ("decontamination", decontaminate.stage),
    ("mixing", mixing.stage),
]

#: The classifiers and the rounding cannot be written in SQL; tests compare the kept ids of the stages with plain
#: recomputations of each stage on its own input.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of the mix with ``copies``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
