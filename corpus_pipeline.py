"""Cleans a corpus in five stages: toxicity, near copies, benchmark passages, secrets, token codes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.llm import decontaminate, pieces, secrets, shingle_join, toxicity
from flowlens.llm.queries import piece_digests, tokenizer_path
from flowlens.llm.tables import saved, table
from flowlens.session import ship_package

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.5; empty ones stay."""
    model = toxicity.fit_on(docs, table(spark, sf_dir, "labels"))
    return toxicity.score_documents(docs, model, whole_row=True).where("score < 0.5").select("row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones, that with the smallest id."""
    return shingle_join.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark. Each row is judged by its own text, whatever its id."""
    rows = docs.withColumn("__row", F.xxhash64(F.col("text").isNull(), *docs.columns))
    found = decontaminate.contaminated(rows, table(spark, sf_dir, "benchmark"), id_col="__row").select("__row").distinct()
    return rows.join(saved(found, "contaminated"), "__row", "left_anti").select(*docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret in the text replaced by a mark and n_chars counted anew where that changed it."""
    rows = docs.select("doc_id", "text", F.struct(*docs.columns).alias("row"))
    found = secrets.scan_secrets(rows, more=["row"])
    text = secrets.redacted(F.col("row.text"), F.col("spans"))
    changed = {"text": text, "n_chars": F.when(F.size("spans") > 0, F.length(text)).otherwise(F.col("row.n_chars"))}
    return found.select(*[
        (changed[f.name] if f.name in changed else F.col(f"row.{f.name}")).cast(f.dataType).alias(f.name) for f in docs.schema.fields
    ])


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token codes of what is left."""
    return piece_digests(pieces.encode_pieces(docs, tokenizer_path("piece_bpe_32k.model")))


def shipped(stage: Stage) -> Stage:
    """The stage, with this package sent to the executors first: stages are also called one by one."""

    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return stage(spark, docs, sf_dir)

    return run_stage


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", shipped(drop_toxic)),
    ("near_copies", shipped(drop_near_copies)),
    ("decontamination", shipped(drop_contaminated)),
    ("secrets", shipped(redact_secrets)),
    ("sentencepiece", shipped(encode)),
]

# Fitted weights and merges in score order cannot be stated in SQL; tests compare with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to the documents; each one's result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
