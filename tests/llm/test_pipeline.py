import random
import re

import pytest

pipeline = pytest.importorskip("corpus_pipeline")
tokenizers = pytest.importorskip("tokenizers")

SF = "/root/testdata/sf0.001"


def brute(spark):
    """The kept ids and texts, by plain Python, for all stages after the first."""
    import public_tokenizers

    from tests.llm.test_decontaminate import WORD
    from tests.llm.test_ngram_jaccard import brute as groups
    from tests.llm.test_secrets import base, entropy_bits

    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    docs = [(d, t) for d, t in docs if t and re.search(r"[^\W\d_]", t)]
    keep = {d for d, _, c in groups(docs) if d == c}
    docs = [(d, t) for d, t in docs if d in keep]
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    low = lambda s: re.sub("[A-Z]", lambda m: m[0].lower(), s)
    wins = set()
    for t in items:
        x = re.findall(WORD, low(t))
        k = min(10, len(x))
        wins |= {tuple(x[i : i + k]) for i in range(len(x) - k + 1)}
    sizes = {len(w) for w in wins}
    theirs = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out = {}
    for d, t in docs:
        spans = [m.span() for m in re.finditer(WORD, low(t))]
        w = [low(t)[a:b] for a, b in spans]
        hit = {i + j for k in sizes for i in range(len(w) - k + 1) if tuple(w[i : i + k]) in wins for j in range(k)}
        if len(hit) > 0.5 * max(1, len(w)):
            continue
        runs, i = [], 0
        while i < len(w):
            if i in hit:
                j = i
                while j + 1 in hit:
                    j += 1
                runs.append((spans[i][0], spans[j][1]))
                i = j
            i += 1
        for a, b in reversed(runs):
            t = t[:a] + t[b:]
        found = [(a, b) for a, _, b in base(t)]
        found += [m.span() for m in re.finditer(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}", t) if re.search("[0-9]", m[0]) and not m[0].isdigit() and entropy_bits(m[0]) >= (3.0 if re.fullmatch("[0-9a-f]+", m[0]) else 3.8)]
        merged = []
        for a, b in sorted(found):
            if merged and a < merged[-1][1]:
                merged[-1][1] = max(b, merged[-1][1])
            else:
                merged.append([a, b])
        for a, b in reversed(merged):
            t = t[:a] + "[SECRET]" + t[b:]
        out[d] = theirs.encode(t, add_special_tokens=False).ids
    return out


def test_run_against_brute_force(spark):
    got = {r.doc_id: list(r.ids) for r in pipeline.run(spark, SF).collect()}
    assert got == brute(spark)


def test_stages_keep_columns_and_odd_rows(spark):
    prose = "the and of that this with from which have were " * 8
    rows = [(1, prose + "one", "en", "s", 5, "x"), (2, prose + "one", "en", None, None, "x"), (3, None, "en", "s", 5, None), (4, "", None, None, 5, None), (None, prose + "two zz", None, None, 5, "x"), (7, prose + "three yy qq ww password = hunter2hunter2", "en", "s", 5, "x"), (7, prose + "three yy qq ww password = hunter2hunter2", "en", "s", 5, "x")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, key string"
    docs = spark.createDataFrame(rows, schema)
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name != "bpe_encoding":
            assert out.columns == docs.columns
            assert stage(spark, docs.limit(0), SF).count() == 0
    ids = lambda df: sorted((r.doc_id or 0) for r in df.collect())
    stages = dict(pipeline.STAGES)
    assert ids(stages["language_id"](spark, docs, SF)) == [0, 1, 2, 7, 7]
    # 1 and 2 are copies, and so are the rows of 7; rows without words link with nothing
    assert ids(stages["ngram_jaccard_join"](spark, docs, SF)) == [0, 1, 3, 4, 7]
    texts = [r.text for r in stages["secret_scans"](spark, docs, SF).where("doc_id = 7").collect()]
    assert len(texts) == 2 and all(t.endswith("[SECRET]") for t in texts)


PROSE = "the and of that this with from which have were " * 8
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, `a.b` string, KEY_ONE string, row string, a string"


def texts_of(stage, spark, rows):
    docs = spark.createDataFrame([(d, t, "en", "s", 5, f"{d}", "k", "r", "a") for d, t in rows], SCHEMA).repartition(3)
    out = dict(pipeline.STAGES)[stage](spark, docs, SF)
    assert out.columns == docs.columns
    got = out.collect()
    assert all((r["a.b"], r.KEY_ONE, r.row, r.a) == (f"{r.doc_id}", "k", "r", "a") for r in got)
    return sorted(((r.doc_id, r.text) for r in got), key=str)


def test_no_row_goes_for_another_of_its_id(spark):
    junk = "123 !!"
    rows = [(7, PROSE), (7, junk), (8, PROSE), (None, PROSE), (None, junk), (None, None), (9, junk), (9, junk), (10, PROSE), (10, PROSE)]
    want = [(7, PROSE), (8, PROSE), (None, PROSE), (10, PROSE), (10, PROSE)]
    assert texts_of("language_id", spark, rows) == sorted(want, key=str)
    assert texts_of("language_id", spark, []) == []


def test_one_row_of_each_group_stays(spark):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(60)) for x in "abcd")
    rows = [(3, a), (7, a), (7, b), (7, b), (5, c), (5, c + " z"), (None, d), (None, d), (None, a + " y"), (None, b), (4, ""), (4, None), (4, " "), (6, a + " x")]
    got = texts_of("ngram_jaccard_join", spark, rows)
    assert [r for r in got if r[0] != 5] == sorted([(3, a), (7, b), (None, d), (4, ""), (4, None), (4, " ")], key=str)
    assert [r[1] in (c, c + " z") for r in got if r[0] == 5] == [True]
    rnd = random.Random(4)
    rows = [(rnd.choice([None, 1, 2, 3, 4, 5, 6, 7]), " ".join(rnd.choice([a, b, c, d]).split()[rnd.randrange(3) : 58])) for _ in range(120)]
    got = texts_of("ngram_jaccard_join", spark, rows)
    least = {}
    for i, t in rows:
        least[t[0]] = min(least.get(t[0], 99), 99 if i is None else i)
    assert sorted((99 if i is None else i, t[0]) for i, t in got) == sorted((i, x) for x, i in least.items())


def test_scratch_leaves_no_tables(spark):
    import glob

    folder = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    before = set(glob.glob(f"{folder}/stash-*"))
    out = pipeline.run(spark, SF)
    left = set(glob.glob(f"{folder}/stash-*")) - before
    assert len(left) == 1 and out.count() > 0
