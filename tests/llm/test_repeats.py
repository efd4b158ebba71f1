import random

import pytest

from llm.repeats import without_repeats


def brute(rows, length):
    seen, out = {}, []
    docs = sorted({(-1 if d is None else d, t or "") for d, t in rows})
    for d, t in docs:
        raw = t.encode()
        cover = bytearray(len(raw))
        for i in range(len(raw) - length + 1):
            w = raw[i : i + length]
            if w in seen:
                cover[i : i + length] = b"\1" * length
            else:
                seen[w] = (d, i)
        runs = sum(1 for i in range(len(raw)) if cover[i] and (i == 0 or not cover[i - 1]))
        out.append((d, len(raw), sum(cover), runs, bytes(b for b, c in zip(raw, cover, strict=True) if not c)))
    by = {(d,): x for d, *x in out}
    return sorted((-1 if d is None else d, *by[(-1 if d is None else d,)]) for d, _ in rows)


def ours(spark, rows, length, **options):
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, id int").repartition(3)
    return sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_bytes - len(r.kept), len(r.removed), bytes(r.kept)) for r in without_repeats(df, length=length, **options).collect())


@pytest.mark.parametrize("length, gram, part", [(40, 16, 20_000), (100, 32, 20_000), (100, 32, 3), (64, 9, 5)])
def test_against_brute_force(spark, length, gram, part):
    rnd = random.Random(length + part)
    word = lambda: "".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 9)))
    passage = [" ".join(word() for _ in range(n)) for n in (10, 20, 40, 60)]
    rows = []
    for i in range(90):
        parts = []
        for _ in range(rnd.randint(0, 4)):
            parts.append(rnd.choice(passage) if rnd.random() < 0.5 else " ".join(word() for _ in range(rnd.randint(1, 40))))
        rows.append((500 - i * 3, " ".join(parts)))
    rows += [(7, rows[3][1]), (9, rows[3][1]), (2000, rows[4][1][5:] + "x"), (11, "ab" * 300), (12, "b" + "ab" * 200), (13, "z" * 400), (14, "z" * 99), (15, "z" * 100)]
    assert ours(spark, rows, length, gram=gram, part=part) == brute(rows, length)


def test_edges(spark):
    rnd = random.Random(2)
    long = "".join(rnd.choice("abcdefgh ") for _ in range(700_000))
    rows = [(1, None), (2, ""), (3, "short"), (4, "short"), (5, long), (6, long[1000:400_000] + "!"), (None, long[5:300]), (8, long[:150]), (8, long[:150])]
    assert ours(spark, rows, 100) == brute(rows, 100)
    assert ours(spark, [], 100) == []


@pytest.mark.parametrize("part", [20_000, 1])
def test_repeated_row_that_is_first(spark, part):
    rnd = random.Random(6)
    text = "".join(rnd.choice("abcdefgh ") for _ in range(3000))
    near = text[:1400] + "!" + text[1400:]
    rows = [(1, text)] * 5 + [(2, near), (3, text[200:]), (4, "x" + text[700:900])]
    assert ours(spark, rows, 100, part=part) == brute(rows, 100)


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = sorted((r.doc_id, r.n_bytes, r.n_bytes - len(r.kept), len(r.removed), bytes(r.kept)) for r in without_repeats(docs).collect())
    assert got == brute(rows, 100)
