"""From raw documents to token ids: five stages over the corpus operators.

Each stage takes (spark, docs, sf_dir) and returns a frame; run() writes it as
Parquet and the next stage reads it again, so that a stage starts from files
whatever was lost before. A stage's files go when the next one's are written;
the last one's stay, for the frame that run() returns reads them. All stages
but the last return the columns of documents, in their order.

For all stages: columns of documents that the operators use for their own
results go through as they are; repeated rows are rows; an empty table gives
an empty one; texts of any length are worked on whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import bpe, minhash, mixing, substring, toxicity
from quillon.llm.common import remove, scratch, table
from quillon.llm.queries import WORD_VOCABULARY


def _beside(docs: DataFrame, names: set[str], stage: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """stage(docs), with docs' columns of these names under other ones meanwhile; columns as docs has them."""
    other = {c: f"__own{i}" for i, c in enumerate(docs.columns) if c.lower() in names}
    out = stage(docs.withColumnsRenamed(other))
    return out.select(*[F.col(f"`{other.get(c, c)}`").alias(c) for c in docs.columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine scores below 0.5.

    Null texts count as empty. Equal texts stay or go together; a score of
    exactly 0.5 goes. Without any label nothing can be learned and all stay.
    """
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return _beside(docs, {"score", "predicted"}, lambda own: toxicity.score(own, model).where("predicted = 0"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: the smallest id, all rows of it.

    Documents without words, null texts and rows of null id stay.
    """
    return minhash.keep_one(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 20 words that stand earlier; n_chars follows.

    Texts that lose nothing stay as they are, but null ones become empty. Rows
    of null id come last, rows of equal id count as one document.
    """
    size = F.length("text").cast(docs.schema["n_chars"].dataType)
    return _beside(docs, {"n_words", "n_removed"}, lambda own: substring.remove_repeats(own, into="text", as_is=True).withColumn("n_chars", size))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them.

    Documents without words have no size and are emitted as often as others of
    their source, for no words. Null sources form one source.
    """
    return mixing.emit(docs)


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens and the token ids of each row; null and empty texts have none.

    The worker's tables are smaller than alone, as earlier stages' tables stay with it.
    """
    return bpe.encode(docs.select("doc_id", "source", "text"), WORD_VOCABULARY, with_decoded=False, max_pieces=150_000, max_chunks=8_000).select("doc_id", "source", "n_tokens", "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("substrings", cut_repeats),
    ("mixing", mix_sources),
    ("bpe", encode_texts),
]

#: Learning, random permutations and token tables have no SQL; the tests hold run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = scratch(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            remove(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
