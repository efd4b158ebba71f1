import random
import re

import pyarrow as pa
import pytest

from llm.decontaminate import _hashed, automaton, contamination, decontaminated

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text):
    return re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, window):
    out = []
    for d, text in docs:
        w = words(text)
        hit, found = set(), set()
        for item, t in items:
            x = words(t)
            if not x:
                continue
            k = min(window, len(x))
            wins = {tuple(x[i : i + k]) for i in range(len(x) - k + 1)}
            for i in range(len(w) - k + 1):
                if tuple(w[i : i + k]) in wins:
                    hit |= set(range(i, i + k))
                    found |= set() if item is None else {str(item)}
        out.append((d, len(w), len(hit), sorted(found)))
    return sorted(out)


def ours(spark, docs, items, **options):
    a = spark.createDataFrame([(d, t, "z") for d, t in docs], "doc_id long, text string, `a.b` string")
    b = spark.createDataFrame(items, "item_id long, text string")
    rows = contamination(a, b, **options).collect()
    return sorted((r.doc_id, r.n_words, sum(s.end - s.start for s in r.hit_spans), list(r.hit_items)) for r in rows)


def test_against_brute_force(spark):
    rnd = random.Random(5)
    for alphabet, window in ((3, 5), (40, 10), (2, 4)):
        text = lambda n: " ".join(rnd.choice("abcdefghijklmnopqrstuvwxyzéABC0123456789ÖÄ"[:alphabet]) for _ in range(n))  # noqa: B023, E731
        items = [(i, text(rnd.randint(0, 14))) for i in range(14)]
        docs = [(i, text(rnd.randint(0, 60)) + ". " + (items[rnd.randrange(14)][1] if rnd.random() < 0.5 else "")) for i in range(60)]
        assert ours(spark, docs, items, window=window) == brute(docs, items, window)
        assert ours(spark, docs, items, window=window, block_chars=60) == brute(docs, items, window)


def test_edges(spark):
    long = "w " * 200_000
    docs = [(1, None), (2, ""), (3, long + "one two three"), (3, "One, two-three!"), (4, "x")]
    items = [(9, "one two three"), (10, "one two three"), (11, None), (12, " . "), (9, "two three"), (None, "w w w w"), (None, "x")]
    assert ours(spark, docs, items) == brute(docs, items, 10)
    assert ours(spark, docs, []) == brute(docs, [], 10)
    assert ours(spark, [], items) == []


def test_words_with_equal_polynomial_hashes(spark):
    word = "a"
    for _ in range(11):
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    docs, items = [(1, word), (2, other), (3, word[:1024]), (4, other[:1024])], [(1, word), (2, word[:1024])]
    assert ours(spark, docs, items) == brute(docs, items, 10)


def test_automaton_stays_small():
    import pickle

    rnd = random.Random(1)
    vocabulary = ["".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randint(2, 8))) for _ in range(20_000)]
    texts = [" ".join(rnd.choice(vocabulary) for _ in range(60)) for _ in range(3_000)]
    texts += [" ".join(t.split()[:30] + texts[k + 1].split()[:30]) for k, t in enumerate(texts[:500])]
    own = automaton([str(i) for i in range(len(texts))], texts, 10)
    size = len(pickle.dumps(own))
    assert size < 12 * sum(map(len, texts)) + (1 << 20)
    spans, found = own.stream(automaton_words(texts[7]))
    assert spans == [(0, 60)] and 7 in found


def automaton_words(text):
    return _hashed(pa.array([text]))[3].tolist()


def test_clash_of_names_is_an_error(spark):
    docs = spark.createDataFrame([(1, "x", "y")], "doc_id long, text string, N_words string")
    with pytest.raises(ValueError):
        contamination(docs, spark.createDataFrame([(1, "x")], "item_id long, text string"))


def test_cleaned(spark):
    ten = " ".join(f"k{i}" for i in range(12))
    rest = " ".join(f"r{i}" for i in range(40))
    docs = spark.createDataFrame([(1, f"Ünter {ten}! {rest}", 5, "s"), (2, ten, 5, "s"), (3, rest, 7, "s"), (4, None, None, "s")], "doc_id long, text string, n_chars long, hit_spans string")
    items = spark.createDataFrame([(1, ten)], "item_id long, text string")
    got = {r.doc_id: (r.text, r.n_chars, r.hit_spans) for r in decontaminated(docs, items).collect()}
    again = {r.doc_id: (r.text, r.n_chars, r.hit_spans) for r in decontaminated(docs, items.union(spark.createDataFrame([(2, "x y z " * 20)], items.schema)), block_chars=60).collect()}
    assert again == got
    assert got == {1: (f"Ünter ! {rest}", len(f"Ünter ! {rest}"), "s"), 3: (rest, 7, "s"), 4: (None, None, "s")}


def test_documents(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert ours(spark, docs, items) == brute(docs, items, 10)
