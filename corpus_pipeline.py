"""The corpus pipeline: the stages that turn ``documents`` into packed sequences.

Each stage works on all rows that the one before kept, and all but the last
return the columns of ``documents``, whatever further columns are called.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.llm import decontaminate, linededup, packing, quality, simhash
from webloom.llm.common import table, unused
from webloom.session import fresh_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    model = quality.fit_on_rest(docs, table(spark, sf_dir, "labels"))
    score = unused(docs, "score")
    scored = quality.score(docs, model, score_col=score)
    return scored.where(F.col(score) >= quality.THRESHOLD).select(*docs.columns)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document holds are cut out; ``n_chars`` follows the text.

    A document of which no line is left goes.
    """
    lines, dropped = unused(docs, "n_lines"), unused(docs, "n_dropped")
    kept = linededup.drop_repeated(docs, linededup.build(docs), lines_col=lines, dropped_col=dropped)
    left = (F.col(dropped) == 0) | (F.trim("text") != "")
    return kept.where(left).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each near-duplicate group; rows of null id stay."""
    marked = simhash.near_duplicates(docs, words=4, distance=4)
    later = marked.where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(later, "doc_id", "left_anti").select(*docs.columns)


def without_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by a benchmark item."""
    # No column of the documents may begin like the new ones.
    prefix = "passages_"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix = f"_{prefix}"
    found = decontaminate.find_passages(docs, table(spark, sf_dir, "benchmark"), prefix=prefix)
    bad = decontaminate.contaminated(F.col(f"{prefix}n_hit"), F.col(f"{prefix}n_words"))
    return found.where(~bad).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents and their places in sequences."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=1)


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", good_documents),
    ("line dedup", without_repeated_lines),
    ("SimHash near-dedup", one_of_each_group),
    ("benchmark decontamination", without_benchmark_passages),
    ("packing", packed),
]

#: Scores, fingerprints and tokens have no SQL form; the tests hold a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply every stage to the whole of ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = fresh_path(spark, f"pipeline-{name.replace(' ', '-')}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
