"""Documents to token counts: quality, near-duplicates, personal data, mix, tokens.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept. All but
the last return the columns of their input; columns beside those of documents are kept,
whatever their names.

Null texts count as empty: the classifier scores them by its bias, they have no
near-duplicates and no personal data (the text stays null), the mix takes none of them.
Null ids are ids like any other (none is in the held-out fold of the classifier's labels),
a null source is a source. Repeated rows are one group of near-duplicates, of which one row
stays; ties go to the smallest id. Texts are read whole, however long. Empty tables give
empty results.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfold.llm import bpe, jaccard, mixing, pii, quality
from nearfold.llm.common import crc_remainder, dropped, fresh, stored, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches 0.3; learnt from the labels outside the fold
    that is held out."""
    learn = crc_remainder("doc_id", 5) != 0
    model = quality.train(quality.sample(docs, table(spark, sf_dir, "labels"), learn))
    score, predicted = fresh("score", docs.columns), fresh("predicted", docs.columns)
    scored = quality.classify(docs, model, score_col=score, predicted_col=predicted)
    return scored.where(F.col(predicted) == 1).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of Jaccard similarity 0.8 over five words."""
    return jaccard.one_of_each(docs)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind in brackets; n_chars follows."""
    base, spans, redacted = (fresh(x, docs.columns) for x in ("base", "spans", "redacted"))
    found = pii.find_pii(docs, base_col=base, spans_col=spans)
    found = found.withColumn(redacted, pii.redact(F.col("text"), F.col(spans)))
    now = {"text": F.col(redacted), "n_chars": F.length(redacted).cast("long")}
    return found.select(*(now.get(c, F.col(c)).alias(c) for c in docs.columns))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; those it does not take, and those
    without a word, go."""
    # The rows travel as one column, so that none of theirs can clash with the mix's.
    packed = docs.select("doc_id", "text", "source", F.struct(*docs.columns).alias("document"))
    mixed = mixing.mix_by_source(packed, ["document"])
    times = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size"))).otherwise(0).cast("int")
    return mixed.select("document", F.explode(F.array_repeat(F.lit(1), times))).select("document.*")


def count_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number and digests of the tokens of every document's text."""
    return bpe.token_digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality_classifier", keep_quality),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("pii", redact_personal_data),
    ("mixing", mix_sources),
    ("byte_bpe", count_tokens),
]

#: No stage but the second can be put in SQL; tests hold all of them against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, stored(stage(spark, docs, sf_dir), name)
        dropped(before)
    return STAGES[-1][1](spark, docs, sf_dir)
