"""From raw documents to token ids: five stages, each written as Parquet before the next one reads it.

1. quality rules: documents that fail go;
2. MinHash near-dedup: one document of each group of near copies stays (five-word shingles, likeness 0.8 or more);
3. suffix-array dedup: passages of ``STAGE_LENGTH`` bytes or more that repeat are cut out of every document;
4. mixing: documents are repeated or left out so that the sources come near their target weights;
5. SentencePiece: the ids of every document that is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from footfall.llm import mixing
from footfall.llm._common import documents, written
from footfall.llm.minhash import minhash_stage
from footfall.llm.quality import quality_stage
from footfall.llm.spiece import pieces_stage
from footfall.llm.suffix_dedup import suffix_stage

STAGES = [
    ("quality_rules", quality_stage),
    ("minhash_near_dedup", minhash_stage),
    ("suffix_array_dedup", suffix_stage),
    ("source_mixing", mixing.mix_stage),
    ("sentencepiece", pieces_stage),
]

#: SQL can't express suffix-array verdicts, MinHash groups or piece ids; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
