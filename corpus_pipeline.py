"""A training-corpus pipeline: five stages over the ``documents`` table, each written and read again.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that its predecessor
kept.  The filtering stages return the columns of their input; the last stage
returns ``doc_id``, the number of tokens, and digests of ids and decoded text.
Rows are judged, not ids: of several rows with one id each is kept or dropped
for its own text.  Null texts count as empty and an empty table passes through.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainlake.llm import quality, toxicity
from grainlake.llm.bpe import token_digests
from grainlake.llm.common import fresh_path, materialise, read_table
from grainlake.llm.decontaminate import contaminated, contamination
from grainlake.llm.queries import token_pattern, tokenizer_path, training_labels
from grainlake.llm.shingles import similar_documents


#: Rows in a batch between Spark and Python workers: texts and their sets of shingles are long.
BATCH = 1_000


@contextmanager
def _short_batches(spark: SparkSession) -> Iterator[None]:
    """Batches of at most ``BATCH`` rows in what runs meanwhile; after that the session has its own setting again."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    rows = int(before)
    spark.conf.set(name, str(min(rows, BATCH) if rows > 0 else BATCH))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _keyed(docs: DataFrame) -> DataFrame:
    """``(key, text)``: a row's id, nulls last, with a hash of its text, which tells rows of one id apart."""
    return docs.select(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", F.xxhash64("text").alias("mark")).alias("key"), "text")


def _same(docs: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """``docs`` semi- or anti-joined with a narrow table of keys, which alone moves while it is small.

    The keys are written first: a join of their known size is planned as a
    broadcast below Spark's threshold, and as a shuffle of both sides beyond it.
    """
    keys = keys.select(F.col("key.doc_id").alias("of_id"), F.col("key.mark").alias("of_mark")).distinct()
    keys = materialise(keys, "stage-keys")
    return docs.join(keys, docs.doc_id.eqNullSafe(keys.of_id) & (F.xxhash64(docs.text) == keys.of_mark), how)


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under 0.5; without labels of both kinds all stay, as do texts without a letter."""
    model = toxicity.fit(docs, training_labels(read_table(spark, sf_dir, "labels")))
    return toxicity.harmless(docs, model)


def remove_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the plain rules and the log-likelihood ratio; null and empty texts fail."""
    return quality.good(docs, quality.fit(docs, read_table(spark, sf_dir, "labels")))


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by a five-word Jaccard similarity of 0.8 or more the one with the smallest id stays.

    SimHash fingerprints in trees of vantage points propose the closest copies;
    shared shingles then propose all other pairs that can be similar.
    Null ids come last, rows of one id in order of a hash of their text, and of
    rows with the same id and text any one stays.
    """
    found = materialise(similar_documents(_keyed(docs), "key", width=5), "stage-duplicates")
    kept = _same(docs, found.where("id <> component_id").select(F.col("id").alias("key")), "left_anti")
    first = found.where("id = component_id").groupBy("id").count().where("count > 1")
    again = materialise(first.select(F.col("id").alias("key")), "stage-repeats")
    if again.isEmpty():
        return kept
    return _same(kept, again, "left_anti").unionByName(_same(kept, again, "left_semi").dropDuplicates(["doc_id", "text"]))


def remove_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of whose words less than a twentieth, or none, lie in 13-word windows of the benchmark."""
    found = contamination(_keyed(docs), read_table(spark, sf_dir, "benchmark"), "key")
    return _same(docs, found.where(contaminated()).select(F.col("id").alias("key")), "left_anti")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of each text's token ids and of what they decode to; a row for each row."""
    tokenizer = tokenizer_path("byte_bpe_50k.tiktoken"), token_pattern()
    return token_digests(docs, *tokenizer).withColumnRenamed("id", "doc_id")


STAGES = [
    ("toxicity", remove_toxic),
    ("quality rules", remove_poor),
    ("simhash near-dedup", remove_near_duplicates),
    ("benchmark decontamination", remove_contaminated),
    ("byte-level bpe", encode),
]

#: The stages learn models and compare bit patterns, which SQL can't express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = fresh_path(spark, "pipeline-" + name.replace(" ", "-"))
        with _short_batches(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
