"""From raw documents to token ids: toxic documents go, one of each group of near copies stays, benchmark leaks go, secrets
are masked, and what is left is encoded.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again as the next one's docs.
"""

from __future__ import annotations

import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))

from vecloom.llm.base import table  # noqa: E402
from vecloom.llm.bpe import bpe_encode  # noqa: E402
from vecloom.llm.decontaminate import without_leaks  # noqa: E402
from vecloom.llm.jaccard import one_of_each  # noqa: E402
from vecloom.llm.queries import tokenizer_path, toxicity_model  # noqa: E402
from vecloom.llm.secrets import find_secrets, redact  # noqa: E402
from vecloom.llm.toxicity import score_toxicity  # noqa: E402
from vecloom.session import written  # noqa: E402

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
# Words that a worker remembers in the last stage; the workers also serve other stages, whose memory theirs stands beside.
REMEMBERED_WORDS = 300_000


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model predicts to be toxic go.

    A null or empty text is scored as an empty one.  Repeated rows are scored alike; an empty table stays empty.  Columns that documents do not have are left out.
    """
    scored = score_toxicity(docs.select(*COLUMNS), toxicity_model(spark, sf_dir))
    return scored.where("predicted = 0").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays (a row without an id only if none has one).

    Null and blank texts are copies of nothing and all stay; of repeated rows with words one stays.
    """
    return one_of_each(docs.select(*COLUMNS))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; null and empty texts hold none and stay, repeated rows share their fate."""
    return without_leaks(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets become a mark; n_chars follows, null for a null text.  No row goes, repeated ones are masked alike."""
    masked = redact(find_secrets(docs.select(*COLUMNS)))
    return masked.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, one row for each document; a null or empty text has none."""
    encoded = bpe_encode(docs.select("doc_id", "text", "lang", "source", "n_chars"), tokenizer_path(), REMEMBERED_WORDS)
    return encoded.select("doc_id", "lang", "source", "n_chars", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secrets", secrets),
    ("encoding", encoding),
]

# A fitted model decides in the first stage, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
