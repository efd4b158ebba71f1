import hashlib
import math
import random
import re
import time

from pyspark.sql import functions as F

from llm.secrets import KINDS, most_bits, query, redacted, secret_spans

BASE = [
    ("assign", re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII), lambda m: len(m[2]) >= 8),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 16),
    ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 32),
]


def base(text):
    spans = [(m.start(), k, m.end()) for k, (_, p, ok) in enumerate(BASE) for m in p.finditer(text or "") if ok(m)]
    return sorted(spans)


def entropy_bits(value, window=20):
    best = 0
    for i in range(len(value) - window + 1):
        w = value[i : i + window]
        best = max(best, -sum(w.count(c) / window * math.log2(w.count(c) / window) for c in set(w)))
    return best


def ours(spark, texts):
    df = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, spans string")
    return {r.doc_id: [tuple(s) for s in r.spans] for r in secret_spans(df).collect()}


def test_base_spans(spark):
    rnd = random.Random(8)
    bits = ["password", "Token", "api_key", "APIKEY", "secret", '"', "'", " ", ":", "=", "abc", "deadbeef", "0123", "AKIA", "ABCD1234", "é", "😀", "\n", ".", "zz", "-_"]
    texts = ["".join(rnd.choice(bits) for _ in range(rnd.randint(0, 40))) for _ in range(400)]
    texts += [None, "", "token=secret=abcdefghijk", "token: secret: abcdefgh", "x" * 100_000 + " password = hunter2hunter2 " + "ab" * 20, "AKIA" * 5, "AKIAAKIA0000", "ſecret=abcdefgh", "toKen=abcdefgh"]
    got = ours(spark, texts)
    for i, t in enumerate(texts):
        assert [s for s in got[i] if s[1] < 3] == base(t), t
    assert ours(spark, []) == {}


def test_entropy(spark):
    rnd = random.Random(9)
    keys = ["".join(rnd.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(rnd.randint(20, 60))) for _ in range(30)]
    plain = ["thanoninhaonedererinreed", "12345678901234567890123", "123e4567-e89b-12d3-a456-426614174000", "aaaaaaaaaaaaaaaaaaaaaaaa1", "snake_case_name_number_12", "a/b12/c/d/e/f/g/h/i/j/k/l"]
    got = ours(spark, [f"on {k} and" for k in keys + plain])
    for i, k in enumerate(keys):
        found = [s for s in got[i] if s[1] == 3]
        if entropy_bits(k) >= 3.8 and re.search("[0-9]", k):
            assert found == [(3, 3, 3 + len(k))], k
    assert not any(got[len(keys) + i] for i in range(len(plain)))


def brute_redacted(text):
    spans = [(a, b) for a, _, b in base(text)]
    spans += [m.span() for m in re.finditer(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}", text) if re.search("[0-9]", m[0]) and not m[0].isdigit() and entropy_bits(m[0]) >= (3.0 if re.fullmatch("[0-9a-f]+|[0-9A-F]+", m[0]) else 3.8)]
    out, last = [], 0
    for a, b in sorted(spans):
        if a >= last:
            out += [text[last:a], "[SECRET]"]
        last = max(last, b)
    return "".join([*out, text[last:]])


def test_long_texts_take_time_in_proportion(spark):
    rnd = random.Random(3)
    signs = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    blob = "é " + "".join(rnd.choice(signs) for _ in range(1_000_000)) + " 😀"
    dull = "xy1" * 10_000
    many = " ".join(f"é token = {rnd.getrandbits(128):032x}" for _ in range(20_000))
    began = time.time()
    got = ours(spark, [blob, dull, many])
    assert got[0] == [(2, 3, 1_000_002)] and got[1] == []
    assert [s for s in got[2] if s[1] < 3] == base(many)
    df = spark.createDataFrame([(1, many)], "doc_id long, text string")
    assert redacted(df).first().text == brute_redacted(many)
    assert time.time() - began < 90


def test_entropy_of_long_runs_against_brute_force(spark):
    rnd = random.Random(5)
    signs = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
    values = ["".join(rnd.choice(signs[: rnd.choice([2, 3, 9, 67])]) for _ in range(n)) for n in (20, 21, 40, 500, 25_000, 25_000, 30_001)]
    values += ["".join(rnd.choice("ab1") for _ in range(20_000)) + "".join(rnd.choice(signs) for _ in range(25)) + "a" * 9_000, "x" * 19, "", None, "=" * 30]
    rows = spark.createDataFrame(list(enumerate(values)), "i int, v string").select("i", most_bits(F.col("v")).alias("b")).collect()
    for r in rows:
        if len(values[r.i] or "") < 20:
            assert r.b is None
        else:
            assert abs(r.b - entropy_bits(values[r.i])) < 1e-9, r.i


def test_keys_that_look_like_paths(spark):
    keys = ["/aB3dE5gH7jK9mN1pQ2rS4", "wJ4lrXU/nFEMI7K9/bPxRf2CYzq1k", "x9Kd8/Qm2Zp7Vb4/Lr6Tn3Wc5Yg1"]
    paths = ["/usr/local/lib/python3/site-packages", "src/main/java/App2/index_file12", "2024/01/02/some-report-12/data"]
    got = ours(spark, [f"on {k} and" for k in keys + paths])
    assert [bool(got[i]) for i in range(6)] == [True] * 3 + [False] * 3
    # a stand-in's word deep inside a long run frees nothing
    assert ours(spark, ["q7" + "Zx9Kd8Qm2Zp7Vb4Lr6Tn3" * 4 + "sample" + "Zx9Kd8Qm2Zp7Vb4Lr6Tn3" * 4])[0]


def test_names_with_dots(spark):
    rows = [("p", 1, "a token = hunter2hunter2", "x")]
    got = redacted(spark.createDataFrame(rows, "`a.b` string, doc_id long, text string, `c``d.e` string"))
    assert got.columns == ["a.b", "doc_id", "text", "c`d.e"] and [tuple(r) for r in got.collect()] == [("p", 1, "a [SECRET]", "x")]


def test_redacted(spark):
    rows = [(1, "a token = '0641917ea4e9feb9cda83477b57ac2654884f485' b é", 3, "k"), (2, "clean", 9, "k"), (3, None, None, "k")]
    got = {r.doc_id: (r.text, r.n_chars, r.spans) for r in redacted(spark.createDataFrame(rows, "doc_id long, text string, n_chars long, spans string")).collect()}
    assert got == {1: ("a [SECRET]' b é", 15, "k"), 2: ("clean", 9, "k"), 3: (None, None, "k")}


def test_documents(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in query(spark, sf).collect():
        spans = base(texts[r.doc_id])
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s[1] == k for s in spans) for k in range(3))
        assert r.base_sha256 == hashlib.sha256(",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans).encode()).hexdigest()
