"""The corpus pipeline: five stages, each written as Parquet and read again as the next one's documents.

The folders lie under the session's spark.checkpoint.dir.  A stage works on all
that the one before kept; all but the last return the columns of documents.

Cases: language ID drops texts that are null, empty or without a letter; the later
stages, given such rows, keep them.  Repeated rows pass language ID, line dedup (rows of
one id and text are one document there) and decontamination alike; near-dedup keeps
one row of each group, repeated rows and rows without an id included: that with the
least id, or the first where no row has one.  Ties are settled as each operator's
docstring says.  Very long texts are worked on whole.  Columns beyond those of
documents pass through the first four stages, whatever their names.  An empty table
gives empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from countloom.llm import bpe, decontam, langid, linededup, neardup
from countloom.llm._spark import cut, forget, table

STAGES = [
    ("language_id", langid.stage),
    ("line_dedup", linededup.stage),
    ("near_dedup", neardup.stage),
    ("decontamination", decontam.stage),
    ("bpe", bpe.stage),
]

#: Segmentation sums, signatures and BPE have no SQL form; tests compare the stages with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, in order, over the whole of ``documents``."""
    docs = table(spark, sf_dir, "documents")
    written = None
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs)
            if written is not None:
                forget(written)
            written = docs
    return docs
