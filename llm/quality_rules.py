"""Line-first cleaning in SQL expressions: rules judge lines, lines that fail go, and documents that lose too much go.

Everything is a narrow projection over arrays of words and lines, with no
shuffle and no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]"
SYMBOLS = "[^#*$%&|<>]+"
#: A line of fewer words is no prose.
LINE_WORDS = 3
#: Of a document's letters and signs, the share that its lines may lose.
MOST_LOST = 0.5

# The rules' patterns.
#: A sentence ends here, or, in longer lines, one ends somewhere.
ENDS = r"[.!?…。！？][\"'”’»)\]]*\s*$"
HAS_END = r"[.!?…。！？]"
#: Menus: three signs that part items; or a line that is one link.
PARTS = r"[|»›>·•]"
LINK = r"(?i)^\s*(?:home|menu|login|sign in|log in|next|previous|back to top|skip to content)\s*$"
#: Phrases of page furniture.
BOILERPLATE = r"(?i)all rights reserved|terms of (?:use|service)|privacy policy|cookie policy|uses cookies|enable javascript|lorem ipsum|click here|subscribe to our|powered by|page not found"
#: Signs in place of letters, and shouting: three words so marked.
MARKED = r"[#*$%&<>]{2,}"
SHOUTED = r"\p{Lu}\p{P}?!{2,}"


def line_fails(line: Column) -> Column:
    """Whether a line breaks the punctuation, navigation, boilerplate or noise rule."""
    words = F.size(F.split(F.trim(line), r"\s+"))
    prose = line.rlike(ENDS) | ((words >= 10) & line.rlike(HAS_END))
    times = lambda pattern: F.size(F.regexp_extract_all(line, F.lit(pattern), 0))
    return ~prose | (words < LINE_WORDS) | (times(PARTS) >= 3) | line.rlike(LINK) | line.rlike(BOILERPLATE) | (times(MARKED) >= 3) | (times(SHOUTED) >= 3)


def line_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_lost: float = MOST_LOST) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_lines, n_lines_removed, clean_text) of every row.

    Words are runs without ASCII space; lines are split at newlines and count
    where they hold a word. n_repeat_words counts words in 3-word windows that
    occur twice or more in the text, compared by 64-bit hashes. base_failed:
    under 50 words, or over half of the words repeated. kept: not base_failed,
    and the lines that fail line_fails() hold no more than most_lost of the
    characters of all lines. clean_text has the remaining lines.

    Null and empty texts have no words: base_failed, not kept. Repeated rows
    come as often as they stand; null ids stay null; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.select(
        "doc_id",
        F.length(F.regexp_replace("text", SYMBOLS, "")).cast("long").alias("n_symbols"),
        F.filter(F.split("text", SPACE), lambda w: w != "").alias("words"),
        F.filter(F.split("text", "\n"), lambda x: x.rlike(WORD)).alias("lines"),
    )
    # 3-word windows as (hash, place), sorted, so that equal ones are neighbours
    n = F.size("words")
    window = lambda w, i: F.struct(F.xxhash64(w, F.get("words", i + 1), F.get("words", i + 2)).alias("h"), i.alias("i"))
    rows = rows.select(
        "doc_id",
        "n_symbols",
        "lines",
        n.cast("long").alias("n_words"),
        F.length(F.concat_ws("", "words")).cast("long").alias("word_chars"),
        F.sort_array(F.transform(F.slice("words", F.lit(1), F.greatest(n - 2, F.lit(0))), window)).alias("windows"),
        F.filter("lines", lambda x: ~line_fails(x)).alias("good"),
    )
    same = lambda x, i: F.coalesce(x["h"] == F.get("windows", i - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get("windows", i + 1)["h"], F.lit(False))
    rows = rows.withColumn("places", F.sort_array(F.transform(F.filter("windows", same), lambda x: x["i"]))).drop("windows")
    covered = F.transform("places", lambda x, i: F.when(i == 0, 3).otherwise(F.least(F.lit(3), x - F.get("places", i - 1))))
    rows = rows.withColumn("n_repeat_words", F.aggregate(covered, F.lit(0).cast("long"), lambda a, x: a + x)).drop("places")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    size = lambda c: F.length(F.concat_ws("", c))
    # one struct per row, unfolded again: no filter on a result moves below this, where its arrays would be made anew for each element
    result = F.struct(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
        failed.alias("base_failed"),
        (~failed & (size("lines") - size("good") <= most_lost * size("lines"))).alias("kept"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size("good")).cast("long").alias("n_lines_removed"),
        F.concat_ws("\n", "good").alias("clean_text"),
    )
    return rows.select(F.inline(F.array(result)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_rules(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("clean_text")


_MARK = r"[.!?\x{2026}\x{3002}\x{FF01}\x{FF1F}]"
_PART = r"|\x{00BB}\x{203A}>\x{00B7}\x{2022}"
SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (
    SELECT *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
           list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
    FROM d
),
g AS (
    SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS n
    FROM (SELECT r, unnest(range(1, len(words) - 1)) AS i, words FROM w) t, LATERAL (SELECT words[i] AS a, words[i + 1] AS b, words[i + 2] AS c) x
),
p AS (SELECT r, count(DISTINCT i + k) AS n FROM g, (SELECT unnest([0, 1, 2]) AS k) k WHERE n > 1 GROUP BY r),
j AS (
    SELECT r, x,
        NOT (regexp_matches(x, '{_MARK}["''\x{{201D}}\x{{2019}}\x{{00BB}})\]]*\s*$') OR (n >= 10 AND regexp_matches(x, '{_MARK}')))
        OR n < {LINE_WORDS}
        OR len(regexp_extract_all(x, '[{_PART}]')) >= 3
        OR regexp_matches(x, '(?i)^\s*(?:home|menu|login|sign in|log in|next|previous|back to top|skip to content)\s*$')
        OR regexp_matches(x, '(?i)all rights reserved|terms of (?:use|service)|privacy policy|cookie policy|uses cookies|enable javascript|lorem ipsum|click here|subscribe to our|powered by|page not found')
        OR len(regexp_extract_all(x, '[#*$%&<>]{{2,}}')) >= 3
        OR len(regexp_extract_all(x, '\p{{Lu}}\p{{P}}?!{{2,}}')) >= 3 AS bad
    FROM (SELECT r, x, len(regexp_split_to_array(trim(x), '\s+')) AS n FROM (SELECT r, unnest(lines) AS x FROM w))
),
l AS (SELECT r, sum(length(x)) AS chars, coalesce(sum(length(x)) FILTER (bad), 0) AS lost, count(*) FILTER (bad) AS removed FROM j GROUP BY r),
b AS (
    SELECT w.doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
           length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
           len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(p.n, 0) AS n_repeat_words,
           len(lines) AS n_lines, coalesce(removed, 0) AS n_lines_removed, coalesce(chars, 0) AS chars, coalesce(lost, 0) AS lost
    FROM w LEFT JOIN p USING (r) LEFT JOIN l USING (r)
)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
       n_repeat_words::BIGINT AS n_repeat_words, base_failed, NOT base_failed AND lost <= {MOST_LOST} * chars AS kept,
       n_lines::BIGINT AS n_lines, n_lines_removed::BIGINT AS n_lines_removed
FROM (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b)
"""
