"""From raw documents to token ids, in five stages.

Every stage takes (spark, docs, sf_dir) and returns a table that is written as Parquet and read
again as the next one's documents. All but the last return the columns of ``documents``. So when a
stage starts, the output of those before it is written, and their scratch tables are deleted.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pvseries.llm import decontaminate, pieces, pii, quality, simhash
from pvseries.llm.common import documents, tokenizer_path
from pvseries.session import delete, scope_dir, scratch_scope
from pvseries.sources.tables import materialise

_NAMES: list[str] = []


def stage(build: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """A stage with a scratch folder of its own, which the next stages delete."""
    name, earlier = build.__name__, list(_NAMES)
    _NAMES.append(name)

    @wraps(build)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        for other in earlier:
            delete(spark, scope_dir(spark, other))
        with scratch_scope(name):
            return build(spark, docs, sf_dir)
    return run_stage


@stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that fail the fixed rules or their group's limits go."""
    return quality.keep_good(docs)


@stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One text of each group of near-duplicates stays: SimHash of four-word shingles, at most four bits apart."""
    return simhash.keep_one(docs)


@stage
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with a passage of the benchmark go."""
    return decontaminate.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@stage
def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; no text goes."""
    masked = pii.mask_personal_data(docs)
    if "n_chars" not in docs.columns:
        return masked
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


@stage
def piece_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of the texts that are left, with checksums of ids and decoded texts."""
    coded = pieces.piece_ids(docs, tokenizer_path("piece_bpe_32k.model"))
    return pieces.digests(coded, keep=["ids"])


STAGES = [("quality_rules", quality_rules), ("near_dedup", near_dedup), ("decontamination", decontamination),
          ("personal_data", personal_data), ("piece_ids", piece_ids)]

# Stages use library tokenizers, hashes and graph rounds; the tests hold them against plain programs instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, build in STAGES:
        docs = materialise(build(spark, docs, sf_dir), f"stage-{name}")
    return docs
