import random
import re

import numpy as np
import pytest

from llm import ngram_jaccard
from llm.ngram_jaccard import Region, _Forest, jaccard_components

SCHEMA = "doc_id long, text string, leader string, set_id int"


def brute(rows):
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted((d, len(s), least.get(find(i))) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True)) if d is not None)


def result(spark, rows, **kw):
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], SCHEMA)
    return sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_components(df, **kw).collect() if r.doc_id is not None)


@pytest.mark.parametrize("region_shingles, block_shingles", [(3_000_000, 40_000), (2_000, 500)])
def test_against_brute_force(spark, region_shingles, block_shingles):
    rnd = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    intro = [rnd.choice(words) for _ in range(12)]
    rows = []
    base = [rnd.choice(words) for _ in range(120)]
    for i in range(260):
        kind = i % 4
        if kind == 0:
            t = intro + [rnd.choice(words) for _ in range(rnd.randint(20, 80))]
        elif kind < 3:
            t = list(base)
            for _ in range(rnd.randint(0, 4)):
                t[rnd.randrange(len(t))] = rnd.choice(words)
        else:
            t = [rnd.choice("ab") for _ in range(rnd.randint(0, 7))]
        rows.append((1000 - i, " ".join(t)))
    assert result(spark, rows, region_shingles=region_shingles, block_shingles=block_shingles) == brute(rows)


def test_regions_against_brute_force():
    rnd = random.Random(7)
    for _ in range(300):
        m, u = rnd.randint(2, 60), rnd.randint(5, 60)
        sets = []
        for _ in range(m):
            x = rnd.sample(range(u), rnd.randint(1, u)) if rnd.random() < 0.4 else [k for k in range(u) if rnd.random() > rnd.choice([0, 0.03, 0.1])]
            sets.append(np.array(sorted(x) or [0], np.uint64))
        forest = _Forest(m)
        for i in range(m):
            for j in range(i):
                a, b = set(sets[i].tolist()), set(sets[j].tolist())
                if 100 * len(a & b) >= 80 * len(a | b):
                    forest.tie(i, j)
        region = Region(sets, 80)
        region.TILE, region.COLUMNS = rnd.choice([(2048, 2048), (7, 5)])
        assert region.join() == [(i, forest.find(i)) for i in range(m) if forest.find(i) != i]


def test_regions_part_what_pivots_can_part():
    # along a line each set is near its neighbours only: few pairs are left for comparing one by one
    for m in (500, 2000):
        region = Region([np.arange(10 * i, 10 * i + 100).astype(np.uint64) for i in range(m)], 80)
        assert len(region.join()) == m - 1
        assert region.offered < m * (m - 1) // 20 and region.by_pivot > 10 * region.by_pair


@pytest.mark.parametrize("level", [0, 64])
def test_leaders(spark, level, monkeypatch):
    monkeypatch.setattr(ngram_jaccard, "HOT_LEVEL", level)
    rnd = random.Random(level)
    rows = [(rnd.randrange(40) << 42, rnd.randrange(300)) for _ in range(2000)]
    rows = sorted({*rows, (99 << 42, 5)})
    by, want = {}, {}
    for p, x in rows:
        by.setdefault(p, set()).add(x)
    for p, x in rows:
        if len(by[p]) > 1:
            want[x, min(by[p])] = want.get((x, min(by[p])), 0) + 1
    got = ngram_jaccard.leaders(spark.createDataFrame(rows, "pivot long, set_id long")).collect()
    assert {(r.set_id, r.leader): r.n for r in got} == want


def test_words_with_equal_polynomial_hashes(spark):
    word = "a"
    for _ in range(11):
        word += word.translate(str.maketrans("ab", "ba"))
    rows = [(1, word), (2, word.translate(str.maketrans("ab", "ba"))), (3, word[:1024]), (4, word[:1024].translate(str.maketrans("ab", "ba")))]
    assert result(spark, rows) == brute(rows)


def test_ids_that_repeat_and_names_with_dots(spark):
    text = " ".join(f"v{i}" for i in range(30))
    rows = [(7, text, "p"), (7, "another one of five words here", "q"), (3, text + " x", "r"), (3, text + " x", "r")]
    df = spark.createDataFrame(rows, "doc_id long, text string, `a.b` string")
    got = sorted(tuple(r) for r in jaccard_components(df, keep=["a.b"]).collect())
    assert got == [(3, 27, 3, "r"), (3, 27, 3, "r"), (7, 2, 7, "q"), (7, 26, 3, "p")]


def test_edges(spark):
    long = " ".join(f"q{i}" for i in range(150_000))
    rows = [(5, None), (4, ""), (3, " \n\t"), (9, "A b"), (7, "a\nB"), (8, "b a"), (2, long), (1, long.upper()), (6, "x y"), (6, "x y"), (11, "É a b c d"), (10, "é a b c d")]
    assert result(spark, rows) == brute(rows)
    assert result(spark, []) == []
    got = jaccard_components(spark.createDataFrame([(None, "a b"), (3, "a b"), (None, "c d")], "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in got) == [(0, 0), (0, 3), (3, 3)]


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_components(docs).collect())
    assert got == brute(rows)
