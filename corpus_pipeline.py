"""A training corpus in five stages: quality, language, near copies, mixture, pieces.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
it as Parquet in the shared folder and hands the stored rows to the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelantern.llm import langid, mixing, near_copies as copies, piece_dropout, quality_trees, simhash
from codelantern.llm.frames import held_out
from codelantern.llm.queries import PIECES
from codelantern.operators.sizing import durable

#: A document goes if its score is lower: the classifier is then rather sure that it is junk.
LEAST_QUALITY = 0.3
#: A text goes if its language wins by less than this share of the likelihood, or knows a smaller share of its words.
LEAST_LANGUAGE, LEAST_KNOWN = 0.5, 0.4
#: Near copies share 0.8 of their different five-word shingles.  Their fingerprints differ in about 39 of 256 bits, at
#: worst (four shingles of five) in 48 with a spread of 6, so the radius of the candidates loses next to none.
NEAR_COPIES = copies.NearCopies(simhash.SimHash(words=5, bits=256, radius=72, distinct=True), share=0.8)
#: No source is repeated more than four times on average.
MIXTURE = mixing.Mix(flatten=0.5, most=4.0)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality trees do not reject; learned as in op6."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    forest = quality_trees.fit_quality(docs, labels, ~held_out("doc_id", 4, 2))
    scored = quality_trees.score_quality(docs, forest, threshold=LEAST_QUALITY)
    return scored.where("predicted = 1").select(docs.columns)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language; those without letters and those that no language fits go."""
    model = langid.fit_languages(docs, ~held_out("doc_id", 5, 0) & F.col("doc_id").isNotNull())
    found = langid.predict_languages(docs, model)
    sure = (F.col("score") >= LEAST_LANGUAGE) & (F.col("known") >= LEAST_KNOWN)
    return found.where((F.col("lang_pred") != langid.UNDETERMINED) & sure).select(docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: of the smallest id, and of rows with that id the one with the smallest text.

    Rows without an id have no place in a group and stay.
    """
    return copies.first_copies(docs, NEAR_COPIES)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies of documents, so that large sources weigh less and small ones more."""
    return mixing.mix_sources(docs, MIXTURE).select(docs.columns)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document, and whether they decode to its text."""
    spec = piece_dropout.Dropout(PIECES)
    text = F.coalesce("text", F.lit(""))
    slim = docs.select("doc_id", "source", "text", F.xxhash64(text).alias("text_hash"))
    coded = piece_dropout.encode_pieces(slim, spec, decoded=True)
    return coded.select(
        "doc_id", "source", "pieces", F.size("pieces").alias("n_pieces"), (F.xxhash64("decoded") == F.col("text_hash")).alias("lossless"))


STAGES = [
    ("quality", quality),
    ("language", language),
    ("near_copies", near_copies),
    ("mixture", mixture),
    ("pieces", pieces),
]

#: A classifier, a language model and merges have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = durable(stage(spark, docs, sf_dir))
    return docs
