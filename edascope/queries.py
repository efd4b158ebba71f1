"""Registered queries over the test tables, and the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edascope.functions import columns as C
from edascope.functions import stats as S
from edascope.operators import correlation, duplicates, forest, lof, missing, outliers, profile, quality, schema
from edascope.sources.reader import union_by_name

LINE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to so many digits, as sums of doubles differ in their last ones between engines."""
    kinds = dict(df.dtypes)
    return df.select(*(F.round(C.quoted(c), digits).alias(c) if kinds[c] in ("double", "float") else C.quoted(c) for c in df.columns))


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def union(parts: list[str]) -> str:
    return " UNION ALL ".join(parts)


# -- profiles -------------------------------------------------------------
NUMERIC_SQL = """SELECT '{c}' AS column_name, count({c}) AS count, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, min({c})::DOUBLE AS min,
round(quantile_cont({c}, 0.25), 6) AS q1, round(quantile_cont({c}, 0.5), 6) AS median, round(quantile_cont({c}, 0.75), 6) AS q3, max({c})::DOUBLE AS max,
round(skewness({c}), 6) AS skewness, round(kurtosis({c}), 6) AS kurtosis, round(max({c}) - min({c}), 6) AS "range", round(quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25), 6) AS iqr,
round(stddev_samp({c}) / avg({c}), 6) AS cv, count(*) FILTER ({c} = 0) AS zeros_count, count(*) FILTER ({c} < 0) AS negatives_count FROM lineitem"""


@query("numeric_summary", union([NUMERIC_SQL.format(c=c) for c in LINE]))
def numeric_summary(spark, sf):
    return rounded(profile.numeric_summary_df(read(spark, sf, "lineitem"), LINE))


SUMMARY = [("o_orderkey", "bigint", 1), ("o_custkey", "bigint", 1), ("o_orderstatus", "string", 0), ("o_totalprice", "double", 1), ("o_orderpriority", "string", 0)]


@query("column_summary", union([f"""SELECT '{c}' AS column_name, '{k}' AS dtype, count({c}) AS non_null_count, count(*) - count({c}) AS null_count, round(100.0 * (count(*) - count({c})) / count(*), 2)::DOUBLE AS null_percentage,
count(DISTINCT {c}) AS unique_count, count(DISTINCT {c}) <= 1 AS is_constant, false AS is_highly_null, {f'round(avg({c}), 4)' if n else 'NULL::DOUBLE'} AS mean, {f'round(stddev_samp({c}), 4)' if n else 'NULL::DOUBLE'} AS std,
{f'min({c})::DOUBLE' if n else 'NULL::DOUBLE'} AS min, {f'max({c})::DOUBLE' if n else 'NULL::DOUBLE'} AS max FROM orders""" for c, k, n in SUMMARY]))
def column_summary(spark, sf):
    return profile.column_summary_df(read(spark, sf, "orders"), [c for c, _, _ in SUMMARY])


@query("datetime_summary", """SELECT 'o_orderdate' AS column_name, count(o_orderdate) AS count, min(o_orderdate) AS min, max(o_orderdate) AS max, date_sub('day', min(o_orderdate), max(o_orderdate)) AS range_days,
(SELECT y FROM (SELECT year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY 1) ORDER BY n DESC, y LIMIT 1) AS most_common_year,
(SELECT m FROM (SELECT month(o_orderdate) AS m, count(*) AS n FROM orders GROUP BY 1) ORDER BY n DESC, m LIMIT 1) AS most_common_month,
round(avg(CASE WHEN isodow(o_orderdate) >= 6 THEN 1.0 ELSE 0.0 END), 6) AS weekend_ratio FROM orders""")
def datetime_summary(spark, sf):
    out = rounded(profile.datetime_summary_df(read(spark, sf, "orders"), ["o_orderdate"]))
    return out.withColumns({c: F.col(c).cast("long") for c in ("most_common_year", "most_common_month")})


@query("categorical_summary", union([f"""SELECT '{c}' AS column_name, count(DISTINCT {c}) AS unique_count, (SELECT {c} FROM {t} GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS mode, (SELECT count(*) FROM {t} GROUP BY {c} ORDER BY 1 DESC LIMIT 1) AS mode_frequency,
round(avg(length({c})), 6) AS avg_length, max(length({c})) AS max_length, count(*) FILTER ({c} = '') AS empty_strings, count(*) FILTER (regexp_matches({c}, '^\\s+$')) AS whitespace_only, round(entropy({c}), 6) AS entropy FROM {t}""" for t, c in [("orders", "o_orderstatus"), ("orders", "o_orderpriority")]]))
def categorical_summary(spark, sf):
    return rounded(profile.categorical_summary_df(read(spark, sf, "orders"), ["o_orderstatus", "o_orderpriority"]))


@query("categorical_topk", """SELECT p_type AS value, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM part), 6)::DOUBLE AS percentage, row_number() OVER (ORDER BY count(*) DESC, p_type) AS place
FROM part GROUP BY p_type ORDER BY n DESC, value LIMIT 50""")
def categorical_topk(spark, sf):
    return rounded(profile.top_categories_df(read(spark, sf, "part"), "p_type", 50))


@query("entropy", union([f"SELECT '{c}' AS column_name, round(entropy({c}), 6) AS entropy FROM lineitem" for c in ("l_returnflag", "l_linestatus", "l_quantity", "l_suppkey")]))
def entropy(spark, sf):
    return rounded(S.entropies(read(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus", "l_quantity", "l_suppkey"]))


@query("boolean_summary", union([f"SELECT '{c}' AS column_name, count(*) FILTER ({c} = 1) AS true_count, count(*) FILTER ({c} = 0) AS false_count, round(avg({c}), 6) AS true_ratio FROM labels" for c in ("quality", "toxic")]))
def boolean_summary(spark, sf):
    return rounded(profile.boolean_summary_df(read(spark, sf, "labels"), ["quality", "toxic"]))


@query("distribution_label", union([f"""SELECT '{c}' AS column_name, CASE WHEN abs(skewness({c})) > 2 THEN 'highly_skewed_' || CASE WHEN skewness({c}) > 0 THEN 'right' ELSE 'left' END
WHEN abs(skewness({c})) > 1 THEN 'moderately_skewed_' || CASE WHEN skewness({c}) > 0 THEN 'right' ELSE 'left' END ELSE 'normal' END AS distribution_type, round(skewness({c}), 6) AS skewness, round(kurtosis({c}), 6) AS kurtosis FROM {t}""" for t, c in [("events", "value"), ("events", "user_id"), ("events", "event_id")]]))
def distribution_label(spark, sf):
    return rounded(profile.distribution_df(read(spark, sf, "events"), ["value", "user_id", "event_id"]).select("column_name", "distribution_type", "skewness", "kurtosis"))


@query("normality_k2", """WITH b AS (SELECT count(c_acctbal)::DOUBLE AS n, avg(c_acctbal) AS m FROM customer),
p AS (SELECT n, avg((c_acctbal - m) ** 2) AS m2, avg((c_acctbal - m) ** 3) AS m3, avg((c_acctbal - m) ** 4) AS m4 FROM customer, b GROUP BY n),
g AS (SELECT n, m3 / m2 ** 1.5 AS g1, m4 / m2 ** 2 AS b2 FROM p),
s AS (SELECT *, g1 * sqrt((n + 1) * (n + 3) / (6 * (n - 2))) AS y, 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9)) AS beta,
3 * (n - 1) / (n + 1) AS e, 24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5)) AS v, 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3))) AS t FROM g),
u AS (SELECT *, -1 + sqrt(2 * (beta - 1)) AS w2, (b2 - e) / sqrt(v) AS x, 6 + 8 / t * (2 / t + sqrt(1 + 4 / (t * t))) AS a FROM s),
z AS (SELECT asinh(y / sqrt(2 / (w2 - 1))) / sqrt(0.5 * ln(w2)) AS z1, 1 + x * sqrt(2 / (a - 4)) AS d, a FROM u)
SELECT 'c_acctbal' AS column_name, round(exp(-(z1 ** 2 + ((1 - 2 / (9 * a) - sign(d) * cbrt((1 - 2 / a) / abs(d))) / sqrt(2 / (9 * a))) ** 2) / 2), 6) AS normality_p FROM z""")
def normality_k2(spark, sf):
    return rounded(profile.distribution_df(read(spark, sf, "customer"), ["c_acctbal"]).select("column_name", "normality_p"))


@query("histogram20", """WITH b AS (SELECT min(l_extendedprice) AS a, max(l_extendedprice) AS z FROM lineitem), c AS (SELECT least(floor((l_extendedprice - a) / (z - a) * 20)::BIGINT, 19) + 1 AS bin, count(*) AS n FROM lineitem, b GROUP BY 1)
SELECT k AS bin, round(a + (z - a) / 20 * (k - 1), 6) AS low, round(a + (z - a) / 20 * k, 6) AS high, coalesce(n, 0) AS n FROM b, range(1, 21) t(k) LEFT JOIN c ON c.bin = k""")
def histogram20(spark, sf):
    return rounded(profile.histogram_df(read(spark, sf, "lineitem"), "l_extendedprice"))


@query("memory_bytes", "SELECT 'o_orderkey' AS column_name, 8 * count(*) AS bytes FROM orders UNION ALL SELECT 'o_orderpriority', sum(octet_length(encode(o_orderpriority)))::BIGINT FROM orders")
def memory_bytes(spark, sf):
    return profile.memory_df(read(spark, sf, "orders").select("o_orderkey", "o_orderpriority"))


@query("structural_flags", union([f"SELECT '{c}' AS column_name, count({c}) = 0 AS is_empty, count(DISTINCT {c}) <= 1 AS is_constant, count(*) - count({c}) > 0.8 * count(*) AS is_mostly_missing, {'count(DISTINCT ' + c + ') = count(*)' if n else 'false'} AS is_index_like FROM (SELECT p_partkey, p_size, p_brand, 7 AS seven, nullif(p_size, p_size) AS nothing FROM part)" for c, n in [("p_partkey", 1), ("p_size", 1), ("p_brand", 0), ("seven", 1), ("nothing", 1)]]))
def structural_flags(spark, sf):
    part = read(spark, sf, "part").selectExpr("p_partkey", "p_size", "p_brand", "7 AS seven", "nullif(p_size, p_size) AS nothing")
    return profile.structural_flags_df(part, "p_partkey")


@query("column_stats", "SELECT round(avg(p_retailprice), 6) AS mean, round(var_samp(p_retailprice), 4) AS variance, round(quantile_cont(p_retailprice, 0.5), 6) AS median FROM part")
def column_stats(spark, sf):
    one = profile.numeric_summary_df(read(spark, sf, "part"), ["p_retailprice"])
    return one.select(F.round("mean", 6).alias("mean"), F.round(F.col("std") * F.col("std"), 4).alias("variance"), F.round("median", 6).alias("median"))


@query("gini", "WITH r AS (SELECT c_acctbal + 1000 AS v, row_number() OVER (ORDER BY c_acctbal) AS i, count(*) OVER () AS n FROM customer) SELECT round(2 * sum(i * v) / (any_value(n) * sum(v)) - (any_value(n) + 1.0) / any_value(n), 6) AS gini FROM r")
def gini(spark, sf):
    return rounded(S.gini(read(spark, sf, "customer").selectExpr("c_acctbal + 1000 AS v"), "v"))


# -- schema ---------------------------------------------------------------
def _type_sql(table: str, column: str, kind: str) -> str:
    n, d = f"count({column})", f"count(DISTINCT {column})"
    rest = {"number": f"WHEN count(*) FILTER ({column} <> floor({column})) = 0 THEN 'integer' ELSE 'float'", "text": f"WHEN {d} <= 2 OR avg(length({column})) < 50 AND {d} / {n} < 0.5 THEN 'categorical' ELSE 'text'", "time": "ELSE 'datetime'"}[kind]
    ratio = f"({d} / {n}::DOUBLE)"
    return f"""SELECT '{column}' AS column_name, {d} AS unique_count, CASE WHEN {n} = 0 THEN 'empty' WHEN {d} <= 1 THEN 'constant' {rest} END AS inferred_type,
CASE WHEN {ratio} = 1 THEN 'unique' WHEN {ratio} > 0.9 THEN 'very-high' WHEN {ratio} > 0.5 THEN 'high' WHEN {d} <= 10 THEN 'low' WHEN {d} <= 100 THEN 'medium' ELSE 'high' END AS cardinality FROM {table}"""


LINEITEM = [("l_orderkey", "number"), ("l_partkey", "number"), ("l_suppkey", "number"), ("l_linenumber", "number"), ("l_quantity", "number"), ("l_extendedprice", "number"), ("l_discount", "number"), ("l_tax", "number"), ("l_returnflag", "text"), ("l_linestatus", "text"), ("l_shipdate", "time")]


@query("schema_types", union([_type_sql("lineitem", c, k) for c, k in LINEITEM]))
def schema_types(spark, sf):
    return schema.schema_df(read(spark, sf, "lineitem").select(*(c for c, _ in LINEITEM))).select("column_name", "unique_count", "inferred_type", "cardinality")


@query("type_distribution", f"SELECT inferred_type, count(*) AS n FROM ({union([_type_sql('lineitem', c, k) for c, k in LINEITEM])}) GROUP BY 1")
def type_distribution(spark, sf):
    return schema.type_distribution_df(read(spark, sf, "lineitem").select(*(c for c, _ in LINEITEM)))


@query("semantic_match", "SELECT count(url) AS n, count(*) FILTER (regexp_matches(url, '^https?://|^www\\.')) AS hits FROM pages")
def semantic_match(spark, sf):
    return schema.pattern_hits(read(spark, sf, "pages"), "url", dict((k, p) for k, _, p in schema.SEMANTIC_TYPES)["url"])


# -- missing values; the tables have none, so some are derived ------------
HOLED = "(SELECT nullif(o_orderstatus, 'P') AS status, CASE WHEN o_custkey % 7 = 0 THEN NULL ELSE o_totalprice END AS price, CASE WHEN o_custkey % 7 IN (0, 1) THEN NULL ELSE o_orderdate END AS day, CASE WHEN o_orderkey % 50 = 0 THEN 'N/A' ELSE o_orderpriority END AS priority, o_orderkey AS k FROM orders)"
CLEAN = HOLED.replace("'N/A'", "NULL")


def holed(spark, sf):
    return read(spark, sf, "orders").selectExpr("nullif(o_orderstatus, 'P') AS status", "CASE WHEN o_custkey % 7 = 0 THEN NULL ELSE o_totalprice END AS price", "CASE WHEN o_custkey % 7 IN (0, 1) THEN NULL ELSE o_orderdate END AS day", "CASE WHEN o_orderkey % 50 = 0 THEN 'N/A' ELSE o_orderpriority END AS priority", "o_orderkey AS k")


HOLES = ["status", "price", "day", "priority", "k"]
SEVERITY = "CASE WHEN null_count >= 0.5 * n THEN 'critical' WHEN null_count >= 0.2 * n THEN 'high' WHEN null_count >= 0.05 * n THEN 'moderate' ELSE 'low' END"


@query("missing_by_column", "SELECT column_name, null_count, round(null_count / n, 6)::DOUBLE AS null_ratio, n - null_count AS non_null_count, " + SEVERITY + " AS severity, CASE WHEN column_name = 'price' THEN CASE WHEN std / mean < 0.1 THEN 'mean' ELSE 'median' END WHEN column_name = 'day' THEN 'interpolate' ELSE 'mode' END AS suggested_strategy, round(mean, 6) AS mean, round(median, 6) AS median, round(std, 6) AS std FROM ("
       + union([f"SELECT '{c}' AS column_name, count(*) AS n, count(*) - count({c}) AS null_count, {'avg(price)' if c == 'price' else 'NULL::DOUBLE'} AS mean, {'quantile_cont(price, 0.5)' if c == 'price' else 'NULL::DOUBLE'} AS median, {'stddev_samp(price)' if c == 'price' else 'NULL::DOUBLE'} AS std FROM {CLEAN}" for c in HOLES]) + ") WHERE null_count > 0")
def missing_by_column(spark, sf):
    return rounded(missing.missing_by_column_df(holed(spark, sf)))


@query("missing_patterns", f"SELECT missing_columns, row_count, round(100.0 * row_count / total, 2)::DOUBLE AS percentage FROM (SELECT concat_ws(', ', {', '.join(f'CASE WHEN {c} IS NULL THEN {chr(39)}{c}{chr(39)} END' for c in HOLES)}) AS missing_columns, count(*) AS row_count, (SELECT count(*) FROM orders) AS total FROM {CLEAN} GROUP BY 1) WHERE missing_columns <> '' ORDER BY row_count DESC, missing_columns LIMIT 10")
def missing_patterns(spark, sf):
    return missing.missing_patterns_df(holed(spark, sf))


@query("row_null_counts", f"SELECT ({' + '.join(f'({c} IS NULL)::INT' for c in HOLES)})::BIGINT AS null_cells, count(*) AS row_count FROM {CLEAN} GROUP BY 1")
def row_null_counts(spark, sf):
    return missing.row_null_counts_df(holed(spark, sf))


@query("nullity_corr", union([f"SELECT '{a}' AS column_1, '{b}' AS column_2, coalesce(round(CASE WHEN stddev_samp(({a} IS NULL)::INT) * stddev_samp(({b} IS NULL)::INT) > 0 THEN corr(({a} IS NULL)::INT, ({b} IS NULL)::INT) END, 6), 0.0) AS correlation FROM {CLEAN}" for i, a in enumerate(HOLES) for b in HOLES[i + 1 :]]))
def nullity_corr(spark, sf):
    return rounded(missing.nullity_correlation_df(holed(spark, sf)))


@query("deletion_impact_row", f"SELECT 'row' AS strategy, n AS original_rows, k AS remaining_rows, n - k AS dropped_rows, round(k / n, 4)::DOUBLE AS retention_ratio, round(100.0 * (1 - k / n), 2)::DOUBLE AS data_loss_percentage FROM (SELECT count(*) AS n, count(*) FILTER ({' AND '.join(f'{c} IS NOT NULL' for c in HOLES)}) AS k FROM {HOLED})")
def deletion_impact_row(spark, sf):
    return missing.deletion_impact_df(holed(spark, sf), "row")


@query("deletion_impact_column", "SELECT 'column' AS strategy, 5::BIGINT AS original_columns, 2::BIGINT AS remaining_columns, 3::BIGINT AS dropped_columns, 0.4::DOUBLE AS retention_ratio, 'day, price, status' AS dropped_column_names")
def deletion_impact_column(spark, sf):
    return missing.deletion_impact_df(holed(spark, sf), "column")


# -- duplicates -----------------------------------------------------------
PAIR = ["user_id", "event_type"]


@query("dup_counts", "SELECT sum(n)::BIGINT AS rows, coalesce(sum(n) FILTER (n > 1), 0)::BIGINT AS all_members, sum(n - 1)::BIGINT AS beyond_first FROM (SELECT count(*) AS n FROM events GROUP BY user_id, event_type)")
def dup_counts(spark, sf):
    return duplicates.duplicate_counts_df(read(spark, sf, "events"), PAIR)


@query("dup_exact_keep_none", "SELECT coalesce(sum(n), 0)::BIGINT AS exact_duplicates FROM (SELECT count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1)")
def dup_exact_keep_none(spark, sf):
    return duplicates.duplicate_counts_df(read(spark, sf, "documents"), ["text"]).select(F.col("all_members").alias("exact_duplicates"))


@query("dup_keep_first", "SELECT (SELECT count(*) FROM part) - (SELECT count(*) FROM (SELECT DISTINCT p_brand, p_type, p_size FROM part)) AS duplicate_rows")
def dup_keep_first(spark, sf):
    return duplicates.duplicate_counts_df(read(spark, sf, "part"), ["p_brand", "p_type", "p_size"]).select(F.col("beyond_first").alias("duplicate_rows"))


@query("dup_key", union([f"SELECT '{c}' AS column_name, count(*) - count(DISTINCT {c}) AS duplicates FROM documents" for c in ("text", "source")]))
def dup_key(spark, sf):
    return duplicates.key_duplicates_df(read(spark, sf, "documents"), ["text", "source"])


@query("dup_groups_top20", "SELECT user_id, event_type, count(*) AS group_size FROM events GROUP BY 1, 2 HAVING count(*) > 1 ORDER BY group_size DESC, user_id, event_type LIMIT 20")
def dup_groups_top20(spark, sf):
    return duplicates.duplicate_groups_df(read(spark, sf, "events"), PAIR)


@query("dup_group_rows", """WITH g AS (SELECT p_brand, p_size, row_number() OVER (ORDER BY p_brand, p_size) - 1 AS __duplicate_group__ FROM part GROUP BY 1, 2 HAVING count(*) > 1)
SELECT p_partkey, p_brand, p_size, __duplicate_group__ FROM part JOIN g USING (p_brand, p_size)""")
def dup_group_rows(spark, sf):
    return duplicates.duplicate_rows_df(read(spark, sf, "part").select("p_partkey", "p_brand", "p_size"), ["p_brand", "p_size"])


@query("fuzzy_pairs")
def fuzzy_pairs(spark, sf):
    return duplicates.fuzzy_pairs_df(read(spark, sf, "part"), "p_partkey", ["p_name"]).withColumn("similarity", F.round("similarity", 4))


@query("fuzzy_blocks")
def fuzzy_blocks(spark, sf):
    return duplicates.fuzzy_blocks_df(read(spark, sf, "part"), "p_partkey", ["p_name", "p_type"]).withColumn("similarity", F.round("similarity", 4))


# -- outliers -------------------------------------------------------------
OUT = [("events", "value"), ("customer", "c_acctbal")]
IQR_SQL = """SELECT '{c}' AS column_name, any_value(n) AS n, count(*) FILTER (v < q1 - 1.5 * i OR v > q3 + 1.5 * i) AS outlier_count, round(count(*) FILTER (v < q1 - 1.5 * i OR v > q3 + 1.5 * i) / any_value(n), 6)::DOUBLE AS outlier_ratio,
count(*) FILTER (v < q1 - 3 * i OR v > q3 + 3 * i) AS extreme_count, round(any_value(q1), 6) AS q1, round(any_value(q3), 6) AS q3, round(any_value(i), 6) AS iqr, round(any_value(q1 - 1.5 * i), 6) AS lower, round(any_value(q3 + 1.5 * i), 6) AS upper, round(any_value(q1 - 3 * i), 6) AS extreme_lower, round(any_value(q3 + 3 * i), 6) AS extreme_upper
FROM (SELECT {c} AS v FROM {t}), (SELECT count({c}) AS n, quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3, q3 - q1 AS i FROM {t})"""


def _both(spark, sf, method):
    return union_by_name([outliers.outliers_df(read(spark, sf, t), [c], method) for t, c in OUT])


@query("outliers_iqr", union([IQR_SQL.format(t=t, c=c) for t, c in OUT]))
def outliers_iqr(spark, sf):
    return rounded(_both(spark, sf, "iqr"))


@query("outliers_z", union([f"""SELECT '{c}' AS column_name, any_value(n) AS n, count(*) FILTER (abs(v - a) / s > 3) AS outlier_count, round(count(*) FILTER (abs(v - a) / s > 3) / any_value(n), 6)::DOUBLE AS outlier_ratio, count(*) FILTER (abs(v - a) / s > 4.5) AS extreme_count, round(any_value(a), 6) AS mean, round(any_value(s), 6) AS std
FROM (SELECT {c} AS v FROM {t}), (SELECT count({c}) AS n, avg({c}) AS a, stddev_samp({c}) AS s FROM {t})""" for t, c in OUT]))
def outliers_z(spark, sf):
    return rounded(_both(spark, sf, "zscore"))


@query("outliers_mad", union([f"""SELECT '{c}' AS column_name, any_value(n) AS n, count(*) FILTER (0.6745 * abs(v - q) / m > 3) AS outlier_count, round(count(*) FILTER (0.6745 * abs(v - q) / m > 3) / any_value(n), 6)::DOUBLE AS outlier_ratio, count(*) FILTER (0.6745 * abs(v - q) / m > 4.5) AS extreme_count, round(any_value(q), 6) AS median, round(any_value(m), 6) AS mad
FROM (SELECT {c} AS v FROM {t}), (SELECT count({c}) AS n, quantile_cont({c}, 0.5) AS q, mad({c}) AS m FROM {t})""" for t, c in OUT]))
def outliers_mad(spark, sf):
    return rounded(_both(spark, sf, "modified_zscore"))


@query("outlier_rows", "SELECT event_id, value FROM events, (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM events) WHERE value < a - 1.5 * (b - a) OR value > b + 1.5 * (b - a)")
def outlier_rows(spark, sf):
    return outliers.outlier_rows_df(read(spark, sf, "events").select("event_id", "value"), "value")


@query("iforest_uni")
def iforest_uni(spark, sf):
    return forest.flagged(C.normalised(read(spark, sf, "events")), ["value"]).groupBy("is_outlier").agg(F.count("*").alias("n"))


@query("iforest_multi")
def iforest_multi(spark, sf):
    return forest.multivariate_df(read(spark, sf, "lineitem").select(*LINE)).groupBy("is_outlier").agg(F.count("*").alias("n"))


@query("lof_1d", """WITH v AS (SELECT s_acctbal AS v, row_number() OVER (ORDER BY s_acctbal) AS i, least(20, count(*) OVER () - 1) AS k FROM supplier),
d AS (SELECT a.i, a.v, b.i AS j, abs(a.v - b.v) AS d, row_number() OVER (PARTITION BY a.i ORDER BY abs(a.v - b.v), b.i) AS r, a.k FROM v a JOIN v b ON a.i <> b.i),
n AS (SELECT * FROM d WHERE r <= k), r AS (SELECT i, max(d) AS reach FROM n GROUP BY i),
l AS (SELECT n.i, 1.0 / (avg(greatest(n.d, r.reach)) + 1e-10) AS density FROM n JOIN r ON r.i = n.j GROUP BY n.i)
SELECT round(any_value(n.v), 6) AS value, round(avg(o.density) / any_value(s.density), 6) AS lof FROM n JOIN l o ON o.i = n.j JOIN l s ON s.i = n.i GROUP BY n.i""")
def lof_1d(spark, sf):
    return rounded(lof.lof_df(read(spark, sf, "supplier"), "s_acctbal"))


# -- correlations ---------------------------------------------------------
PAIRS = [(a, b) for i, a in enumerate(LINE) for b in LINE[i + 1 :]]


@query("corr_pearson", union([f"SELECT '{a}' AS column_1, '{b}' AS column_2, round(corr({a}, {b}), 6) AS correlation FROM lineitem" for a, b in PAIRS]))
def corr_pearson(spark, sf):
    return rounded(correlation.correlation_df(read(spark, sf, "lineitem"), LINE))


RANK = "(SELECT rank() OVER (ORDER BY {a}) + (count(*) OVER (PARTITION BY {a}) - 1) / 2.0 AS x, rank() OVER (ORDER BY {b}) + (count(*) OVER (PARTITION BY {b}) - 1) / 2.0 AS y FROM lineitem)"


@query("corr_spearman", union([f"SELECT '{a}' AS column_1, '{b}' AS column_2, round(corr(x, y), 6) AS correlation FROM {RANK.format(a=a, b=b)}" for a, b in PAIRS]))
def corr_spearman(spark, sf):
    return rounded(correlation.correlation_df(read(spark, sf, "lineitem"), LINE, "spearman"))


@query("corr_kendall", """WITH t AS (SELECT p_size::DOUBLE AS x, p_retailprice AS y, row_number() OVER () AS i FROM part),
s AS (SELECT sum(sign(a.x - b.x) * sign(a.y - b.y)) AS s, count(*)::DOUBLE AS n0 FROM t a JOIN t b ON a.i < b.i),
x AS (SELECT sum(n * (n - 1) / 2.0) AS t FROM (SELECT count(*) AS n FROM t GROUP BY x)), y AS (SELECT sum(n * (n - 1) / 2.0) AS t FROM (SELECT count(*) AS n FROM t GROUP BY y))
SELECT 'p_size' AS column_1, 'p_retailprice' AS column_2, round(s / sqrt((n0 - x.t) * (n0 - y.t)), 6) AS correlation FROM s, x, y""")
def corr_kendall(spark, sf):
    return rounded(correlation.correlation_df(read(spark, sf, "part"), ["p_size", "p_retailprice"], "kendall"))


ALIKE = "(SELECT l_quantity AS a, l_extendedprice AS b, l_quantity * 2 + l_discount AS c, -l_quantity + l_tax AS d FROM lineitem)"
FOUR = ["a", "b", "c", "d"]


def _alike(spark, sf):
    return read(spark, sf, "lineitem").selectExpr("l_quantity AS a", "l_extendedprice AS b", "l_quantity * 2 + l_discount AS c", "-l_quantity + l_tax AS d")


@query("corr_pairs_strong", "SELECT column_1, column_2, round(r, 6) AS correlation, abs(round(r, 6)) AS abs_correlation FROM (" + union([f"SELECT '{a}' AS column_1, '{b}' AS column_2, corr({a}, {b}) AS r FROM {ALIKE}" for i, a in enumerate(FOUR) for b in FOUR[i + 1 :]]) + ") WHERE abs(r) >= 0.7")
def corr_pairs_strong(spark, sf):
    return correlation.strong_pairs_df(_alike(spark, sf))


@query("corr_target", union([f"SELECT '{c}' AS feature, 'a' AS target, round(corr({c}, a), 6) AS correlation, round(abs(corr({c}, a)), 6) AS abs_correlation FROM {ALIKE}" for c in "bcd"]))
def corr_target(spark, sf):
    return correlation.target_df(_alike(spark, sf), "a")


# -- quality --------------------------------------------------------------
COMPLETE = f"(SELECT ({' + '.join(f'count({c})' for c in HOLES)}) / (5.0 * count(*)) FROM {HOLED})"


@query("quality_completeness", f"SELECT round({COMPLETE}, 6)::DOUBLE AS completeness")
def quality_completeness(spark, sf):
    return rounded(quality.completeness_df(holed(spark, sf)))


def _unique_sql(table: str, columns: str, keys: list[str]) -> str:
    worst = f"greatest({', '.join(f'n - count(DISTINCT {k})' for k in keys)}, 0)"
    return f"SELECT round(greatest(0, 1 - (n - (SELECT count(*) FROM (SELECT DISTINCT {columns} FROM {table}))) / n - 0.5 * ({worst}) / n), 6)::DOUBLE AS uniqueness FROM {table}, (SELECT count(*) AS n FROM {table}) GROUP BY n"


@query("quality_uniqueness", _unique_sql("customer", "c_custkey, c_nationkey, c_acctbal", ["c_custkey", "c_nationkey"]))
def quality_uniqueness(spark, sf):
    return rounded(quality.uniqueness_df(read(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_acctbal")))


RULES = {"p_size": {"min": 5, "max": 40}, "p_brand": {"pattern": "Brand#[12]"}}
VALID = [("customer", "c_acctbal", "CASE WHEN m > 0 THEN floor(n * (1 - 0.5 * m / n)) ELSE n END", "count(*) FILTER (c_acctbal < 0)"), ("part", "p_size", "least(n, (SELECT count(*) FROM part WHERE p_size >= 5), (SELECT count(*) FROM part WHERE p_size <= 40))", "0"), ("part", "p_brand", "(SELECT count(*) FROM part WHERE regexp_matches(p_brand, '^(?:Brand#[12])'))", "0")]


@query("quality_validity", union([f"SELECT '{c}' AS column_name, n, ({e})::BIGINT AS valid_count, round(({e}) / n, 6)::DOUBLE AS validity FROM (SELECT count({c}) AS n, {m} AS m FROM {t})" for t, c, e, m in VALID]))
def quality_validity(spark, sf):
    return rounded(quality.validity_by_column_df(read(spark, sf, "customer").select("c_acctbal")).union(quality.validity_by_column_df(read(spark, sf, "part").select("p_size", "p_brand"), RULES)))


@query("quality_consistency", """WITH s AS (SELECT count(*) FILTER (v = lower(v) AND v <> upper(v)) / count(*) AS l, count(*) FILTER (v = upper(v) AND v <> lower(v)) / count(*) AS u, count(*) FILTER (regexp_matches(v, '\\p{Lu}') AND NOT regexp_matches(v, '\\p{L}\\p{Lu}') AND NOT regexp_matches(v, '(^|[^\\p{L}])\\p{Ll}')) / count(*) AS t, count(*) FILTER (regexp_matches(v, '^\\s')) AS w, c
FROM (SELECT unnest([o_orderstatus, o_orderpriority]) AS v, unnest(['s', 'p']) AS c FROM orders) GROUP BY c)
SELECT round((3 + sum(greatest(CASE WHEN greatest(l, u, t) > 0.7 THEN greatest(l, u, t) ELSE 0.5 END - CASE WHEN w > 0 THEN 0.2 ELSE 0 END, 0))) / 5, 6)::DOUBLE AS consistency FROM s""")
def quality_consistency(spark, sf):
    return rounded(quality.consistency_df(read(spark, sf, "orders").select("o_orderstatus", "o_orderpriority", "o_totalprice")))


def _overall(t: str, b: str, key: str) -> str:
    return f"SELECT '{t}' AS name, round(100 * (0.3 + 0.2 * (1 - 0.5 * 0) + 0.25 * (1 + CASE WHEN m > 0 THEN floor(n * (1 - 0.5 * m / n)) / n ELSE 1 END) / 2 + 0.25), 6)::DOUBLE AS overall FROM (SELECT count(*) AS n, count(*) FILTER ({b} < 0) AS m FROM {t})"


@query("quality_compare", f"SELECT a.overall AS current_overall, b.overall AS previous_overall, round(a.overall - b.overall, 6) AS change FROM ({_overall('customer', 'c_acctbal', 'c_custkey')}) a, ({_overall('supplier', 's_acctbal', 's_suppkey')}) b")
def quality_compare(spark, sf):
    a = quality.quality_df(read(spark, sf, "customer").select("c_custkey", "c_acctbal")).select(F.round("overall", 6).alias("current_overall"))
    b = quality.quality_df(read(spark, sf, "supplier").select("s_suppkey", "s_acctbal")).select(F.round("overall", 6).alias("previous_overall"))
    return a.crossJoin(b).withColumn("change", F.round(F.col("current_overall") - F.col("previous_overall"), 6))


@query("quality_overall", f"SELECT overall FROM ({_overall('customer', 'c_acctbal', 'c_custkey')})")
def quality_overall(spark, sf):
    return rounded(quality.quality_df(read(spark, sf, "customer").select("c_custkey", "c_acctbal")).select("overall"))


# -- sources --------------------------------------------------------------
@query("union_by_name", "SELECT o_orderkey, o_totalprice, NULL::VARCHAR AS o_orderpriority, 'a' AS __source_file__ FROM orders UNION ALL SELECT o_orderkey, NULL, o_orderpriority, 'b' FROM orders")
def union_files(spark, sf):
    orders = read(spark, sf, "orders")
    return union_by_name([orders.select("o_orderkey", "o_totalprice", F.lit("a").alias("__source_file__")), orders.select("o_orderkey", "o_orderpriority", F.lit("b").alias("__source_file__"))])
