import random
import re

from llm.quality_rules import line_rules


def base(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    where = {}
    for i in range(len(w) - 2):
        where.setdefault(tuple(w[i : i + 3]), []).append(i)
    hit = {i + k for v in where.values() if len(v) > 1 for i in v for k in range(3)}
    failed = len(w) < 50 or 100 * len(hit) > 50 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit), failed


def ours(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "'x' as words", "1 as lines")
    return {r.doc_id: r for r in line_rules(df).collect()}


def test_base(spark):
    rnd = random.Random(4)
    texts = ["".join(rnd.choice(["a", "b ", "c\n", "\t", "é", "# ", "|", " ", "\x0b", "　"]) for _ in range(rnd.randint(0, 400))) for _ in range(80)]
    texts += [None, "", " \n\n ", "same same same same", "x " * 60_000, "\n".join(["one line."] * 5), "😀 ☃ y " * 30]
    got = ours(spark, texts)
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base(t), t
        assert not (r.base_failed and r.kept)
    assert ours(spark, []) == {}


def test_lines(spark):
    prose = [" ".join(f"w{i}x{j}" for j in range(20)) + "." for i in range(6)]
    nav = " | ".join(f"item{j}" for j in range(120))
    texts = [
        "\n".join(prose),
        "\n".join([*prose, "Home", "All rights reserved. Powered by us.", "short"]),
        nav,
        "\n".join([nav, prose[0]]),
        " ".join(f"{chr(65 + j % 26)}{chr(65 + j // 26)}E!!" for j in range(80)) + ".",
        " ".join(f"w{j}***" for j in range(80)) + ".",
    ]
    got = ours(spark, texts)
    assert [got[i].kept for i in range(6)] == [True, True, False, False, False, False]
    assert got[1].n_lines_removed == 3 and got[1].clean_text == "\n".join(prose)


def test_against_sql(spark):
    import duckdb

    from llm.quality_rules import SQL, query

    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS FROM '{sf}/documents.parquet'")
    want = con.sql(SQL)
    names = want.columns
    rows = query(spark, sf)
    assert rows.columns == names
    assert sorted(tuple(r) for r in rows.collect()) == sorted(want.fetchall())


def test_clean_documents_stay(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = line_rules(spark.read.parquet(f"{sf}/documents.parquet")).join(labels, "doc_id").where("not base_failed").groupBy("quality").agg({"kept": "count"}, ).collect()
    kept = line_rules(spark.read.parquet(f"{sf}/documents.parquet")).join(labels, "doc_id").where("not base_failed and kept").groupBy("quality").count().collect()
    total = {r[0]: r[1] for r in got}
    share = {r["quality"]: r["count"] / total[r["quality"]] for r in kept}
    assert share[1] > 0.99 and share.get(0, 0) < 0.1
