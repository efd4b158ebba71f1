"""A corpus pipeline of five stages over documents: language, near duplicates, benchmark passages, secrets, token ids.

Each stage takes (spark, docs, sf_dir) and returns the documents that stay,
in the columns of documents; the last returns them as token ids. run() writes
each stage's result as Parquet in the shared folder and rereads it for the
next, so that a lost executor costs no earlier stage.

Rows are judged one by one, by all that a stage looks at, never by their id
alone: ids may repeat with different texts, or be null. Null or letterless
texts go with the first stage, as no language can be told, and so do texts in
none of the trained languages; a rejected row takes no other with it. Of each
group of near duplicates one row stays: that of least id, rows without an id
last, of least text digest among equal ids. Of rows that are equal in id,
text, lang and source one stays, of least digest over its other columns.
Rows without words stay, as they link with nothing. Passages of benchmark items
are cut out, and documents that are mostly such passages go. Secrets are
replaced by a mark. Extra columns, whatever their names, pass through all
stages but the last. An empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.bpe import encoded
from llm.decontaminate import decontaminated
from llm.language_id import document_languages, train
from llm.ngram_jaccard import jaccard_components
from llm.secrets import redacted
from llm.shared import dropped, named, scratch, shipped, small_batches, stashed

#: SQL cannot express the stages; tests hold run() against a brute-force version.
ORACLE_SQL = None


def _free(docs: DataFrame, name: str) -> str:
    """A name that no column of docs has, whatever its case."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def _keyed(docs: DataFrame) -> tuple[DataFrame, str, str]:
    """docs with two 64-bit digests of a row's id, text, lang and source, and their names."""
    one, two = _free(docs, "key_one"), _free(docs, "key_two")
    columns = [named(c) for c in ("doc_id", "text", "lang", "source")]
    nulls = [c.isNull() for c in columns]
    return docs.withColumn(one, F.xxhash64(F.lit(1), *columns, *nulls)).withColumn(two, F.xxhash64(F.lit(2), *nulls, *reversed(columns))), one, two


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which the language can be told: fused posterior of one half or more, and a text in a trained language."""
    shipped(spark)
    model = train(docs)
    keyed, one, two = _keyed(docs)
    verdicts = document_languages(keyed.select(F.struct(one, two).alias("doc_id"), "text", "lang", "source"), model)
    gone_one, gone_two = _free(docs, "gone_one"), _free(docs, "gone_two")
    gone = verdicts.where("not accepted").select(F.col(f"doc_id.{one}").alias(gone_one), F.col(f"doc_id.{two}").alias(gone_two)).distinct()
    # joined by a shuffle at every size: keys of rejected rows grow with the corpus
    return keyed.join(gone.hint("merge"), (F.col(one) == F.col(gone_one)) & (F.col(two) == F.col(gone_two)), "left_anti").select(*(named(c) for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of least id, of each group linked by a Jaccard similarity of 0.8 or more over 5-word shingles."""
    shipped(spark)
    keyed, one, two = _keyed(docs)
    narrow = keyed.select(F.col(one).alias("a"), F.col(two).alias("b"), F.col("doc_id").cast("long").alias("id"), "text")
    found = jaccard_components(narrow, id_col="a", keep=["b", "id"]).select(F.col("doc_id").alias("a"), "b", "id", "n_shingles", "component_id")
    first = found.where("n_shingles > 0").groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "a", "b")).alias("x"))
    kept = first.select("x.a", "x.b").union(found.where("n_shingles = 0").select("a", "b")).distinct()
    # equal rows become one before they meet, so that no row that repeats is one task's; joined by a shuffle at every size
    rest = [named(c) for c in docs.columns if c not in ("doc_id", "text", "lang", "source")]
    rank = F.xxhash64(F.lit(0), *rest)
    order = F.min_by(F.struct(*(named(c) for c in docs.columns)), rank).alias("row")
    single = keyed.groupBy(one, two).agg(order)
    return single.join(kept.hint("merge"), (F.col(one) == F.col("a")) & (F.col(two) == F.col("b")), "left_semi").select("row.*")


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of benchmark items; those that are mostly passages go."""
    shipped(spark)
    return decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with each secret replaced by a mark."""
    shipped(spark)
    return redacted(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids) of each document."""
    shipped(spark)
    return encoded(docs).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", benchmark),
    ("secret_scans", secrets),
    ("bpe_encoding", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents after all stages."""
    shipped(spark)
    small_batches(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        last, kept = docs, []
        with scratch(kept):  # what a stage writes on its way goes with it
            docs = stashed(stage(spark, last, sf_dir))
            kept.append(docs)
        dropped(last)
    return docs
