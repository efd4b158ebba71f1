"""Language identification by fusing evidence as Bayes has it: the text, the declared language, the address and its host.

log P(language | all) = log P(language | host) + log P(text | language)
    + log P(declared | language) + log P(suffix | language) + constant

Text likelihoods come from hashed character trigrams, tempered, since
neighbouring trigrams aren't independent. The prior of a host is smoothed by
that of its domain, and that by the whole corpus; all three, and the tables
of declared languages and suffixes, are sums of text posteriors by group. A
page's own posterior is taken out of its host's and its domain's sums. Whether
a text is in any trained language at all is asked of the text alone: the best
language competes with a background of equally likely trigrams.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from llm import vectext as vt
from llm.shared import stashed

BITS = 14
#: Labelled texts that training takes at most, drawn by a hash of their id.
MOST_TEXTS = 8_000
#: A trigram counts as a third of an independent sign; beyond so many the text says no more.
TEMPER, MOST_TRIGRAMS = 1 / 3, 300
SMOOTH_HOST, SMOOTH_DOMAIN, SMOOTH_TABLE = 5.0, 20.0, 2.0
LEAST_POSTERIOR = 0.5
#: Log probability of a trigram in a text of no trained language, where all buckets are alike, and the prior of such a text.
BACKGROUND, UNKNOWN = -BITS * math.log(2), 0.01
#: A key of more than this share of the rows is joined by broadcasting; there are at most 10,000 such keys at any size.
HOT_SHARE = 1e-4
NONE = "und"

# The language that a country's address suffix suggests.
SUFFIX_LANGUAGES = {"fr": "fr", "de": "de", "at": "de", "ch": "de", "es": "es", "mx": "es", "ar": "es", "uk": "en", "us": "en", "ie": "en", "au": "en", "it": "it", "pt": "pt", "br": "pt", "nl": "nl", "pl": "pl"}


@dataclass
class LanguageModel:
    """Log probabilities of trigram buckets, a column for each language."""

    languages: list[str]
    table: np.ndarray

    def likelihoods(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Tempered log likelihoods, a row for each text, and the number of trigrams."""
        key, bounds = trigrams(column)
        n = np.diff(bounds)
        out = np.zeros((len(n), len(self.languages)))
        for k in range(len(self.languages)):
            total = np.zeros(len(key) + 1)
            np.cumsum(self.table[key, k], out=total[1:])
            out[:, k] = total[bounds[1:]] - total[bounds[:-1]]
        return out * (TEMPER * np.minimum(n, MOST_TRIGRAMS) / np.maximum(n, 1))[:, None], n


def trigrams(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the trigrams of bytes that hold a letter, and the bounds of each text's."""
    data, offsets = vt.buffers(column)
    data = vt.lowered(data)
    letter = (data >= 97) & (data <= 122) | (data >= 128)
    plain = np.where(letter, data, 32).astype(np.uint32)
    if len(plain) < 3:
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    key = (plain[:-2] << 16 | plain[1:-1] << 8 | plain[2:]) * np.uint32(0x9E3779B1) >> np.uint32(32 - BITS)
    good = letter[:-2] | letter[1:-1] | letter[2:]
    for k in (1, 2):
        at = offsets[1:-1] - k
        good[at[(at >= 0) & (at < len(good))]] = False
    at = np.flatnonzero(good)
    return key[at].astype(np.int64), np.searchsorted(at, offsets)


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", most: int = MOST_TEXTS) -> LanguageModel:
    """Counts trigrams of at most `most` labelled texts, drawn by a hash of their id; null ids, labels and texts are left out.

    All rows of a drawn id count. A table without labelled rows gives a model
    of one language, `und`.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where("id is not null and lang is not null and text is not null")
    drawn = rows.select("id").distinct().orderBy(F.xxhash64("id"), "id").limit(most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in vt.pieces(batches):
            key, bounds = trigrams(batch.column(1))
            names, codes = np.unique(np.array(batch.column(0).to_pylist()), return_inverse=True)
            both = np.repeat(codes, np.diff(bounds)) << BITS | key
            count = np.bincount(both, minlength=len(names) << BITS)
            at = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array(names[at >> BITS].tolist(), pa.string()), pa.array(at & (1 << BITS) - 1, pa.int64()), pa.array(count[at], pa.int64())], ["lang", "bucket", "n"])

    counts = rows.join(F.broadcast(drawn), "id", "left_semi").select("lang", "text").mapInArrow(run, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    lang = np.array(counts["lang"].to_pylist(), object)
    languages = sorted(set(lang.tolist()))
    table = np.ones((1 << BITS, max(1, len(languages))))
    for k, name in enumerate(languages):
        at = lang == name
        table[counts["bucket"].to_numpy()[at], k] += counts["n"].to_numpy()[at]
    return LanguageModel(languages or [NONE], np.log(table / table.sum(axis=0)).astype(np.float32))


_DROP = re.compile(r"(?is)<(script|style|noscript)\b.*?</\1\s*>|<!--.*?-->")
_TAG = re.compile(r"<[^>]*>")
_ENTITY = re.compile(r"&#?\w{1,10};")


def plain_text(html: str | None) -> str | None:
    """The text of a page, without scripts, styles, comments, tags and entities."""
    return None if html is None else _ENTITY.sub(" ", _TAG.sub(" ", _DROP.sub(" ", html)))


def evidence(rows: DataFrame, model: LanguageModel, html: bool = False) -> DataFrame:
    """rows of (id, text, declared, url, host), with text replaced by its likelihoods and letters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in vt.pieces(batches):
            text = pa.array([plain_text(x) for x in batch.column(1).to_pylist()], pa.string()) if html else batch.column(1)
            ll, n = model.likelihoods(text)
            columns = [batch.column(0), *batch.columns[2:], pa.array(list(ll), pa.list_(pa.float64())), pa.array(n, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["id", *batch.schema.names[2:], "likelihoods", "letters"])

    fields = [f for f in rows.schema.fields if f.name != "text"]
    return rows.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", likelihoods array<double>, letters long")


def _softmax(x: Column) -> Column:
    top = F.array_max(x)
    e = F.transform(x, lambda v: F.exp(v - top))
    total = F.aggregate(e, F.lit(0.0), lambda a, v: a + v)
    return F.transform(e, lambda v: v / total)


def joined_by_weight(rows: DataFrame, table: DataFrame, key: str, weight: str) -> DataFrame:
    """rows with the columns of table (one row a key; weight: how many of rows have it), null where the key is or has none.

    Keys of over HOT_SHARE of all weight, of which there cannot be more than
    its inverse, are broadcast; the others, none of which is frequent, are
    joined by a shuffle, and rows without a key not at all. So it is at every
    size, and no task has more of one key than HOT_SHARE of the rows.
    """
    total = table.agg(F.coalesce(F.sum(weight), F.lit(0))).first()[0]
    hot = F.col(weight) > HOT_SHARE * float(total)
    names = [c for c in table.columns if c != key]
    out = rows.join(F.broadcast(table.where(hot).withColumn("hot", F.lit(True))), key, "left")
    settled = out.where(F.col("hot") | F.col(key).isNull())
    rest = out.where(F.col("hot").isNull() & F.col(key).isNotNull()).drop("hot", *names).join(table.where(~hot).hint("merge"), key, "left")
    columns = [*rows.columns, *names]
    return settled.select(*columns).union(rest.select(*columns))


def identified(rows: DataFrame, model: LanguageModel, least: float = LEAST_POSTERIOR) -> DataFrame:
    """(id, language, posterior, text_language, accepted) of every row of evidence().

    declared is a language tag, of which the first part counts; url's last
    part of the host name gives the suffix; host is any name, and its domain
    is its last two labels. Each may be null, unknown or odd, and says nothing
    then. language is `und` with posterior 0, and the row isn't accepted, where
    a text has no letters. The posterior is that among the trained languages.
    accepted: it reaches `least`, and the text is not more likely of an unknown
    language or junk than of the trained one that suits it best. Of equally
    likely languages the first by name wins. Repeated rows each get the result.
    """
    langs = model.languages
    sums = lambda prefix: [F.sum(F.get("p", F.lit(k))).alias(f"{prefix}{k}") for k in range(len(langs))]
    known = F.array(*(F.lit(x) for x in langs))
    declared = F.lower(F.split(F.trim("declared"), "[-_]")[0])
    countries = F.create_map(*(F.lit(x) for pair in SUFFIX_LANGUAGES.items() for x in pair))
    suffix = F.element_at(countries, F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z]+://(?:[^/@]*@)?[^/:?#]*\.([A-Za-z]+)", 1)))
    rows = rows.select(
        "id", "host", "letters", "likelihoods",
        F.when(F.array_contains(known, declared), declared).otherwise(F.lit("")).alias("declared"),
        F.coalesce(F.when(F.array_contains(known, suffix), suffix), F.lit("")).alias("suffix"),
        F.regexp_extract(F.coalesce("host", F.lit("")), r"([^.]+\.[^.]+)$", 1).alias("domain"),
    )
    rows = rows.withColumn("p", F.when(F.col("letters") > 0, _softmax(F.col("likelihoods"))).otherwise(F.array_repeat(F.lit(0.0), len(langs))))
    rows = stashed(rows)  # a few numbers a row; the texts are read once

    # tables of few rows, at most one for each language and one more: for the driver
    def table(column: str) -> dict[str, list[float]]:
        return {r[column]: [r[f"s{k}"] or 0.0 for k in range(len(langs))] for r in rows.groupBy(column).agg(*sums("s")).collect()}

    declared_table, suffix_table = table("declared"), table("suffix")
    whole = [sum(v[k] for v in declared_table.values()) for k in range(len(langs))]
    size = sum(whole)
    prior = [(whole[k] + 1) / (size + len(langs)) for k in range(len(langs))]

    def logs(tab: dict[str, list[float]], column: str, k: int) -> Column:
        """log P(value | language k), smoothed; nothing where no value is given."""
        out = F.lit(0.0)
        for value, s in sorted(tab.items()):
            if value:
                out = F.when(F.col(column) == value, F.lit(float(np.log((s[k] + SMOOTH_TABLE / (len(langs) + 1)) / (whole[k] + SMOOTH_TABLE))))).otherwise(out)
        return out

    hosts = stashed(rows.where("host is not null").groupBy("host", "domain").agg(F.count("*").alias("host_rows"), F.sum(F.when(F.col("letters") > 0, 1.0).otherwise(0.0)).alias("hn"), *sums("h")))
    domains = stashed(hosts.groupBy("domain").agg(F.count("*").alias("domain_hosts"), F.sum("hn").alias("dn"), *(F.sum(f"h{k}").alias(f"d{k}") for k in range(len(langs)))))
    hosts = stashed(joined_by_weight(hosts, domains, "domain", "domain_hosts").drop("domain"))
    rows = joined_by_weight(rows.drop("domain"), hosts, "host", "host_rows")
    own = F.when(F.col("letters") > 0, 1.0).otherwise(0.0)
    scores = []
    for k in range(len(langs)):
        p = F.get("p", F.lit(k))
        n_host, n_domain = F.coalesce("hn", own) - own, F.coalesce("dn", own) - own
        domain = (F.greatest(F.coalesce(f"d{k}", p) - p, F.lit(0.0)) + SMOOTH_DOMAIN * prior[k]) / (n_domain + SMOOTH_DOMAIN)
        host = (F.greatest(F.coalesce(f"h{k}", p) - p, F.lit(0.0)) + SMOOTH_HOST * domain) / (n_host + SMOOTH_HOST)
        scores.append(F.log(host) + F.get("likelihoods", F.lit(k)) + logs(declared_table, "declared", k) + logs(suffix_table, "suffix", k))
    rows = rows.select("id", "letters", "likelihoods", "p", _softmax(F.array(*scores)).alias("q"))
    best = lambda c: F.get(known, (F.array_position(c, F.array_max(c)) - 1).cast("int"))
    some = F.col("letters") > 0
    top = F.array_max("q")
    unknown = F.least("letters", F.lit(MOST_TRIGRAMS)) * (TEMPER * BACKGROUND) + math.log(UNKNOWN / (1 - UNKNOWN))
    trained = F.array_max("likelihoods") >= unknown
    return rows.select("id", F.when(some, best("q")).otherwise(NONE).alias("language"), F.when(some, top).otherwise(0.0).alias("posterior"), F.when(some, best("p")).otherwise(NONE).alias("text_language"), (some & (top >= least) & trained).alias("accepted"))


def host_of(url: Column) -> Column:
    """The host name of an address, or null."""
    name = F.lower(F.regexp_extract(url, r"^[a-zA-Z]+://(?:[^/@]*@)?([^/:?#]+)", 1))
    return F.when(name != "", name)


def page_languages(pages: DataFrame, model: LanguageModel) -> DataFrame:
    """(page_id, language, posterior, text_language, accepted) of every row of pages (page_id, url, html).

    A null or empty page, and one of tags alone, has no letters. Null or odd
    addresses say nothing. Repeated pages count as often as they come, and each
    gets its result; ids are not looked at. Other columns are ignored, and an
    empty table gives an empty result.
    """
    declared = F.regexp_extract("html", r"(?i)<html[^>]*\slang\s*=\s*[\"']?([A-Za-z-]+)", 1)
    rows = pages.select(F.col("page_id").alias("id"), F.col("html").alias("text"), declared.alias("declared"), "url", host_of(F.col("url")).alias("host"))
    return identified(evidence(rows, model, html=True), model).withColumnRenamed("id", "page_id")


def document_languages(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """(doc_id, language, posterior, text_language, accepted) of every row of docs (doc_id, text, lang, source): source is the host, lang the declared language.

    Each may be null. Repeated rows count as often as they come, and each gets
    its result; ids, of any type, are not looked at. Other columns are ignored,
    and an empty table gives an empty result.
    """
    rows = docs.select(F.col("doc_id").alias("id"), "text", F.col("lang").alias("declared"), F.lit(None).cast("string").alias("url"), F.col("source").alias("host"))
    return identified(evidence(rows, model), model).withColumnRenamed("id", "doc_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = train(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return page_languages(spark.read.parquet(f"{sf_dir}/pages.parquet"), model).withColumn("posterior", F.round("posterior", 6))


def documents_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over documents: source as host, lang as the declared language."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return document_languages(docs, train(docs)).withColumn("posterior", F.round("posterior", 6))
