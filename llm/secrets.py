"""Secret scans in SQL expressions: three known shapes, and windows of high entropy in candidate strings.

A candidate is a run of at least WINDOW characters of the base64 alphabet with
a digit in it. Its Shannon entropy is followed over a window that slides by
one character: the window's counts, one for each character of the alphabet,
change in two places a step, and so does the sum of c log2 c over them. Each
class of characters has its own threshold. An allow-list keeps out what has
high entropy by nature.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.shared import named

WINDOW = 20
#: Running sums over matches go by blocks of 2^6.
_SHIFT = 6
#: Texts are cut at places within chunks of 2^10 code points.
_CHUNK = 10
#: Kinds in the order in which equal starts are listed.
KINDS = ["assign", "access", "hex", "entropy"]

# Patterns of secrets, and what is let pass.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}+"
HEX = r"(?<![0-9a-f])[0-9a-f]{32,}+"
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])[A-Za-z0-9+/_=-]{20,}+"
ALLOWED = [
    r"^[0-9]+$",  # numbers
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",  # UUIDs
    r"^[0-9]{4}-[0-9]{2}-[0-9]{2}(T[0-9]{2,6}[A-Z+-]?[0-9]*)?$",  # dates
    r"^/?(?:(?:[A-Z]?[a-z]+|[A-Z]+|[0-9]{1,4})(?:[_-](?:[A-Z]?[a-z]+|[A-Z]+|[0-9]{1,4}))*[0-9]{0,4}/)+(?:(?:[A-Z]?[a-z]+|[A-Z]+|[0-9]{1,4})(?:[_-](?:[A-Z]?[a-z]+|[A-Z]+|[0-9]{1,4}))*[0-9]{0,4})?$",  # paths of words and short numbers
    r"(?i)^.{0,54}(?:example|sample|placeholder|dummy|changeme|redacted).{0,54}$",  # stand-ins
    r"(?i)^.{0,54}(?:0123456789|abcdefghij|qwertyuiop).{0,54}$",  # runs of a keyboard or an alphabet
    r"^[A-Za-z]+(?:[_-][A-Za-z]*[0-9]{0,4})+$",  # names of words and short numbers
]
#: Bits a character in the most varied window, by class: hexadecimal digits, or letters and digits.
LEAST_BITS = {"hex": 3.0, "base64": 3.8}
_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"


def _let(value: Column, use) -> Column:
    """use(value), with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _running(numbers: Column, join, levels: int = 3) -> Column:
    """Of an array of numbers, the join of all up to each place: that of the blocks before, and of the place's own block.

    The blocks' joins run on in the same way, so that no list is carried
    through a fold and the work for a number is bounded.
    """

    def fold(part: Column) -> Column:
        return F.aggregate(F.slice(part, F.lit(2), F.size(part)), F.get(part, F.lit(0)), join)

    def placed(a: Column) -> Column:
        if not levels:
            return F.transform(a, lambda _, i: fold(F.slice(a, F.lit(1), i + 1)))
        blocks = F.transform(F.sequence(F.lit(0), F.shiftright(F.size(a) - 1, _SHIFT)), lambda b: fold(F.slice(a, F.shiftleft(b, _SHIFT) + 1, F.lit(1 << _SHIFT))))

        def within(upto: Column) -> Column:
            def one(_: Column, i: Column) -> Column:
                block = F.shiftright(i, _SHIFT)
                own = fold(F.slice(a, F.shiftleft(block, _SHIFT) + 1, i - F.shiftleft(block, _SHIFT) + 1))
                return F.when(block > 0, join(F.get(upto, block - 1), own)).otherwise(own)

            return F.transform(a, one)

        return F.when(F.size(a) > 0, _let(_running(blocks, join, levels - 1), within)).otherwise(a)

    return _let(numbers, placed)


def _matches(text: Column, pattern: str, kind: int) -> Column:
    """Structs (start, kind, stop, value) of all matches of the pattern, in code points.

    Starts follow from the lengths of the matches and of the pieces between.
    """
    pairs = F.arrays_zip(F.split(text, pattern, -1).alias("p"), F.regexp_extract_all(text, F.lit(pattern), 0).alias("m"))
    pairs = F.filter(pairs, lambda x: x["m"].isNotNull())

    def placed(all_: Column) -> Column:
        stops = _running(F.transform(all_, lambda x: F.length(x["p"]) + F.length(x["m"])), lambda x, y: x + y)
        both = F.arrays_zip(all_.alias("x"), stops.alias("stop"))
        return F.transform(both, lambda z: F.struct((z["stop"] - F.length(z["x"]["m"])).alias("start"), F.lit(kind).alias("kind"), z["stop"].alias("stop"), z["x"]["m"].alias("value")))

    none = F.array().cast("array<struct<start:int,kind:int,stop:int,value:string>>")
    return F.when(text.rlike(pattern), _let(pairs, placed)).otherwise(none)


def most_bits(value: Column, window: int = WINDOW) -> Column:
    """The entropy, in bits a character, of the window of the value that has most; null if the value is shorter.

    One step for each character: the one `window` before leaves, and it
    enters. The window's counts stand in six numbers, five bits to each of 12
    signs, so that a step changes two counts and its state never grows.
    """
    bits, each = 5, 12
    words = [f"w{k}" for k in range(-(-len(_ALPHABET) // each))]
    part = F.array(*(F.lit(c * math.log2(c) if c else 0.0) for c in range(window + 2)))  # c log2 c
    places = F.array(*(F.lit(k % each * bits) for k in range(len(_ALPHABET))))
    holders = F.array(*(F.lit(k // each) for k in range(len(_ALPHABET))))
    start = F.struct(*(F.lit(0).cast("long").alias(w) for w in words), F.lit(0.0).alias("sum"), F.lit(float(1 << 20)).alias("least"), F.lit(0).alias("n"))

    def count(a: Column, word: Column, place: Column) -> Column:
        held = a[words[-1]]
        for k, w in reversed(list(enumerate(words[:-1]))):
            held = F.when(word == k, a[w]).otherwise(held)
        return F.call_function("shiftright", held, place).bitwiseAND(F.lit((1 << bits) - 1).cast("long")).cast("int")

    def step(a: Column, x: Column) -> Column:
        # a sign that leaves as it enters changes nothing; before the window is full none leaves
        change = ~x["same"]
        out, into = count(a, x["lw"], x["lp"]), count(a, x["ew"], x["ep"])
        loss = F.when(x["full"], F.get(part, out) - F.get(part, out - 1)).otherwise(0.0)
        total = F.when(change, a["sum"] + F.get(part, into + 1) - F.get(part, into) - loss).otherwise(a["sum"])
        one = lambda place: F.call_function("shiftleft", F.lit(1).cast("long"), place)
        zero = F.lit(0).cast("long")
        changed = [(a[w] + F.when(change & (x["ew"] == k), one(x["ep"])).otherwise(zero) - F.when(change & x["full"] & (x["lw"] == k), one(x["lp"])).otherwise(zero)).alias(w) for k, w in enumerate(words)]
        return F.struct(*changed, total.alias("sum"), F.when(a["n"] + 1 >= window, F.least(a["least"], total)).otherwise(a["least"]).alias("least"), (a["n"] + 1).alias("n"))

    signs = F.transform(F.split(value, ""), lambda c: F.instr(F.lit(_ALPHABET), c) - 1)

    def pair(s: Column):
        def both(c: Column, i: Column) -> Column:
            left = F.get(s, F.greatest(i - window, F.lit(0)))
            return F.struct(F.get(holders, c).alias("ew"), F.get(places, c).alias("ep"), F.get(holders, left).alias("lw"), F.get(places, left).alias("lp"), (i >= window).alias("full"), ((i >= window) & (left == c)).alias("same"))

        return F.transform(s, both)

    return F.when(F.length(value) >= window, math.log2(window) - F.aggregate(_let(signs, pair), start, step)["least"] / window)


def suspicious(value: Column) -> Column:
    """Whether a candidate's entropy reaches its class's threshold and no entry of the allow-list fits."""
    allowed = F.lit(False)
    for pattern in ALLOWED:
        allowed = allowed | value.rlike(pattern.replace(")+", ")++").replace(")*", ")*+"))  # no list of places to go back to, however long the value
    least = F.when(value.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$"), LEAST_BITS["hex"]).otherwise(LEAST_BITS["base64"])
    return ~allowed & (most_bits(value) >= least)


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """(doc_id, text, spans, plus the columns in keep) of every row; spans are (start, kind, stop) sorted by start and kind.

    Starts and stops count code points; kind is a place in KINDS. assign:
    a name such as password or token, a sign and a value of 8 characters or
    more. access: AKIA and 12 or more capitals and digits. hex: 32 or more
    lower-case hexadecimal digits. entropy: see most_bits(). Spans of
    different kinds may overlap. A null text is empty and has none. Repeated
    rows come as often as they stand.
    """
    names = keep or []
    rows = docs.select(named(id_col).alias("doc_id"), F.coalesce(named(text_col).cast("string"), F.lit("")).alias("text"), *(named(c).alias(f"k{i}") for i, c in enumerate(names)))
    text, extra = F.col("text"), [f"k{i}" for i in range(len(names))]
    rows = rows.select(
        "doc_id", "text", *extra,
        _matches(text, ASSIGN, 0).alias("assign"),
        _matches(text, ACCESS, 1).alias("access"),
        _matches(text, HEX, 2).alias("hex"),
        _matches(text, CANDIDATE, 3).alias("entropy"),
    )
    long_value = lambda x: F.length(F.regexp_extract(x["value"], ASSIGN, 2)) >= 8
    spans = F.concat(F.filter("assign", long_value), "access", "hex", F.filter("entropy", lambda x: suspicious(x["value"])))
    spans = F.transform(F.sort_array(spans), lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["stop"].alias("stop")))
    # unfolded from one struct, so that no filter on spans moves the scan to where it would run twice
    return rows.select(F.inline(F.array(F.struct("doc_id", "text", spans.alias("spans"), *extra)))).withColumnsRenamed({f"k{i}": c for i, c in enumerate(names)})


def _piece(chunks: Column, begin: Column, end: Column) -> Column:
    """Code points begin to end (exclusive) of a text cut into chunks, at the cost of these alone and a chunk."""
    size = 1 << _CHUNK

    def of(k: Column) -> Column:
        low = F.shiftleft(k, _CHUNK)
        return F.substr(F.get(chunks, k), F.greatest(begin - low, F.lit(0)) + 1, F.least(end - low, F.lit(size)) - F.greatest(begin - low, F.lit(0)))

    whole = F.array_join(F.transform(F.sequence(F.shiftright(begin, _CHUNK), F.shiftright(end - 1, _CHUNK)), of), "")
    return F.when(end > begin, whole).otherwise(F.lit(""))


def cut_out(text: Column, spans: Column, mark: str) -> Column:
    """The text with all spans, sorted by start, replaced by the mark; overlapping ones by one mark together."""
    chunks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{1 << _CHUNK}}}"), 0)
    reach = _running(F.transform(spans, lambda x: x["stop"]), lambda x, y: F.greatest(x, y))

    def apart(both: Column) -> Column:
        return F.transform(both, lambda x, i: F.struct(x["span"]["start"].alias("start"), x["stop"].alias("stop"), F.when(i > 0, F.get(both, i - 1)["stop"]).otherwise(F.lit(0)).alias("last"), (i == 0).alias("first")))

    def joined(c: Column) -> Column:
        placed = _let(F.arrays_zip(spans.alias("span"), reach.alias("stop")), apart)

        def pieces(p: Column) -> Column:
            heads = F.filter(p, lambda x: x["first"] | (x["start"] >= x["last"]))
            kept = F.transform(heads, lambda x: F.concat(_piece(c, x["last"], x["start"]), F.lit(mark)))
            return F.concat(F.array_join(kept, ""), _piece(c, F.element_at(p, -1)["stop"], F.length(text)))

        return _let(placed, pieces)

    return _let(chunks, joined)


def redacted(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """docs with every span of a secret, overlapping ones together, replaced by the mark.

    Texts without secrets, null ones too, stay as they are; n_chars, where docs
    has it, follows the text. The columns are those of docs, whatever their
    names; repeated rows come as often as they stand, and ids are not looked at.
    """
    names = docs.columns
    held = [f"c{i}" for i in range(len(names))]
    at = held[names.index(text_col)]
    rows = secret_spans(docs.toDF(*held), id_col=at, text_col=at, keep=held)
    rows = rows.withColumn("done", F.when(F.size("spans") > 0, cut_out(F.col("text"), F.col("spans"), mark)))
    out = {c: F.col(h) for c, h in zip(names, held, strict=True)}
    kinds = dict(docs.dtypes)
    if "n_chars" in out:
        out["n_chars"] = F.when(F.col("done").isNotNull(), F.length("done")).otherwise(out["n_chars"]).cast(kinds["n_chars"])
    out[text_col] = F.coalesce("done", out[text_col])
    return rows.select(*out.values()).toDF(*names)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = secret_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    kinds = F.array(*(F.lit(k) for k in KINDS))
    listed = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", F.get(kinds, x["kind"]), x["start"], x["stop"])), ",")
    count = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long")
    return rows.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(listed(F.filter("spans", lambda x: x["kind"] < 3)), 256).alias("base_sha256"), listed("spans").alias("spans"))


def _sql() -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    # RE2 has no look-around: runs that are as long as can be need none
    patterns = [quoted(ASSIGN), quoted("AKIA[A-Z0-9]{12,}"), quoted("[0-9a-f]{32,}"), quoted("[A-Za-z0-9+/_=-]{20,}")]
    kinds = " UNION ALL ".join(f"SELECT r, {k} AS kind, regexp_extract_all(t, {p}) AS m, regexp_split_to_array(t, {p}) AS p FROM d WHERE regexp_matches(t, {p})" for k, p in enumerate(patterns))
    allowed = " OR ".join(f"regexp_matches(v, {quoted(p)})" for p in ALLOWED)
    signs = f"string_split(v[i : i + {WINDOW - 1}], '')"
    part = f"list_sum(list_transform(list_distinct({signs}), lambda c: len(list_filter({signs}, lambda y: y = c)) * log2(len(list_filter({signs}, lambda y: y = c)))))"
    bits = f"list_max(list_transform(range(1, length(v) - {WINDOW - 2}), lambda i: log2({WINDOW}) - {part} / {WINDOW}))"
    least = f"CASE WHEN regexp_matches(v, '^(?:[0-9a-f]+|[0-9A-F]+)$') THEN {LEAST_BITS['hex']} ELSE {LEAST_BITS['base64']} END"
    listed = "string_agg(name || ':' || s || ':' || e, ',' ORDER BY s, kind)"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
k AS ({kinds}),
u AS (SELECT r, kind, m[i] AS v, list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS s FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM k)),
f AS (
    SELECT r, kind, s::BIGINT AS s, (s + length(v))::BIGINT AS e, {KINDS!r}[kind + 1] AS name FROM u
    WHERE CASE kind WHEN 0 THEN length(regexp_extract(v, {patterns[0]}, 2)) >= 8 WHEN 3 THEN regexp_matches(v, '[0-9]') AND NOT ({allowed}) AND {bits} >= {least} ELSE true END
),
g AS (SELECT r, count(*) FILTER (kind = 0) AS a, count(*) FILTER (kind = 1) AS b, count(*) FILTER (kind = 2) AS c, {listed.replace("s, kind)", "s, kind) FILTER (kind < 3)")} AS base, {listed} AS spans FROM f GROUP BY r)
SELECT doc_id, coalesce(a, 0)::BIGINT AS n_assign, coalesce(b, 0)::BIGINT AS n_access, coalesce(c, 0)::BIGINT AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (r)
"""


SQL = _sql()
