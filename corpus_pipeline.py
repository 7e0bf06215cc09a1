"""From raw documents to packed training sequences, in five stages.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and
returns a DataFrame that is written as Parquet and read again as the next one's
docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, functions as F

from casegrid.llm import best_fit_packing, exact_dedup, language_id, ngram_jaccard, source_mix
from casegrid.workspace import materialize

#: A text without letters, or whose rank distance to every language is above this share of the greatest, is rejected.
LEAST_SCORE = 0.1


def keep_known_languages(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    profiles = language_id.learn(docs.where(~language_id.held_out()))
    scored = language_id.predict(docs, profiles, into=("__lang", "__score"))
    return scored.where((F.col("__lang") != "und") & (F.col("__score") >= LEAST_SCORE)).select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_exact_copies(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_exact_duplicates(docs)


def drop_near_copies(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_jaccard.keep_one_of_each(docs, words=5, percent=80)


def mix_sources(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row as often as the mix takes it; rows that it leaves out go."""
    docs = materialize(docs.withColumn("__row", F.monotonically_increasing_id()), "keyed")
    mix = source_mix.mix_sources(docs, row_col="__row").where("taken > 0").select(F.col("__row").alias("__taken_row"), (F.col("taken") / F.col("size")).cast("int").alias("__copies"))
    repeated = docs.join(mix, F.col("__row") == F.col("__taken_row")).withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies"))))
    return repeated.select(*[F.col(f"`{c}`") for c in docs.columns if c != "__row"])


def pack_sequences(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    return best_fit_packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", keep_known_languages),
    ("exact_dedup", drop_exact_copies),
    ("ngram_jaccard", drop_near_copies),
    ("source_mix", mix_sources),
    ("best_fit_packing", pack_sequences),
]

#: SQL can express neither the rank-order profiles nor the packing.
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
