"""From raw documents to packed sequences: language, near duplicates, benchmark leaks, secrets, packing.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and is written and read again.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import decontaminate, language, near_dup, packing, secrets
from tidewatch.llm.common import crc_mod, ship, stored, table

#: Share of a text's words that its language has to label.
LEAST_SHARE = 0.25
#: Near copies share 80 % of their word shingles; op2's query has its own bound of 85 %. Two sets at the bound share no band
#: with probability (1 - 0.8^5)^36 = 6e-7.
NEAR = near_dup.NearDup(percent=80, bands=36)
#: Bytes of text that a task labels together: texts pass through Python here, so less is held at a time than in op8's query.
LABELLED_AT_ONCE = 2_000_000
#: What a secret is replaced by.
MASK = "[secret]"


def stage(fn):
    """A stage that also runs on its own, whatever was called before."""

    @wraps(fn)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship(spark)
        return fn(spark, docs, sf_dir)

    return run


@stage
def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters and those no language labels in a quarter of their words; lang is the one found.

    Learnt from the given labels of the documents whose crc32 mod 5 is not 0, as in the query."""
    model = language.fit(docs.where(crc_mod("doc_id", 5) != 0))
    # the old labels are replaced, and the text is the one long column: it goes to Python once
    own = {c: "text" if c == "text" else f"_doc_{c}" for c in docs.columns if c != "lang"}
    found = language.predict(docs.select(*[F.col(c).alias(name) for c, name in own.items()]), model, list(own.values()), LABELLED_AT_ONCE)
    kept = found.where((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_SHARE))
    return kept.select(*[F.col(own.get(c, "lang_pred")).alias(c) for c in docs.columns])


@stage
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest doc_id of each group of near copies (similarity of 0.8 or more)."""
    gone = near_dup.near_duplicates(docs.select("doc_id", "text"), NEAR).where(~F.col("kept")).select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


@stage
def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    leaks = decontaminate.contaminated(docs.select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return docs.join(leaks.select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)


@stage
def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every reported span; n_chars follows the text. Documents stay."""
    return secrets.masked(docs, MASK)


@stage
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in sequences of 1024 tokens."""
    return packing.pack_documents(docs.select("doc_id", "text"))


STAGES = [("language", identify_language), ("near_duplicates", drop_near_duplicates), ("decontaminate", drop_benchmark_leaks),
          ("secrets", mask_secrets), ("packing", pack)]

#: Models, sets and a tokenizer are not expressible in SQL; the operators' tests hold near duplicates and secrets against brute
#: force, tests/llm/test_pipeline.py runs the language stage and the whole.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, step in STAGES[:-1]:
        docs = stored(step(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
