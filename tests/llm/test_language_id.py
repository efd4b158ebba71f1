import math
import random

import pytest
from pyspark.sql import functions as F

from llm import language_id as L
from llm.language_id import document_languages, documents_query, evidence, identified, joined_by_weight, page_languages, plain_text, query, train

SF = "/root/testdata/sf0.01"


def test_pages(spark):
    rows = query(spark, SF)
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = rows.join(pages.select("page_id", F.regexp_extract("html", 'lang="(..)"', 1).alias("want")), "page_id").collect()
    assert len(got) == pages.count()
    assert sum(r.language == r.want for r in got) >= 0.95 * len(got)


def test_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = train(docs.where("doc_id % 2 = 0"))
    rest = docs.where("doc_id % 2 = 1")
    # without the declared language
    got = document_languages(rest.withColumn("lang", F.lit(None).cast("string")), model).join(rest.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r.language == r.lang for r in got) >= 0.97 * len(got)
    assert all(r.accepted for r in document_languages(rest, model).collect())


def test_evidence_tips_the_scales(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = train(docs)
    rows = [(i, f"http://a.example.fr/{i}", f'<html lang="fr"><body>{t}</body></html>') for i, t in enumerate(docs.where("lang = 'fr'").limit(30).toPandas()["text"])]
    rows += [(100, "http://a.example.fr/x", "<p>xq</p>"), (101, "ftp:bad url", "<p>xq</p>")]
    got = {r.page_id: r for r in page_languages(spark.createDataFrame(rows, "page_id long, url string, html string"), model).collect()}
    assert got[100].language == "fr" and got[100].posterior > 0.9 and got[101].posterior < got[100].posterior


def test_foreign_and_junk_texts_are_not_accepted(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = [
        "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью",
        "人人生而自由在尊严和权利上一律平等他们赋有理性和良心并应以兄弟关系的精神相对待",
        "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto",
        "xkcd bvrtq zzpln wrtgh kjhgf qwrtp mnbvx ztrwq plkjh gfdsx cvbnm",
        "All human beings are born free and equal in dignity and rights. They are endowed with reason and conscience",
    ]
    rows = [(i, t, "en", "s") for i, t in enumerate(texts)]
    got = {r.doc_id: r.accepted for r in document_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), train(docs)).collect()}
    assert got == {0: False, 1: False, 2: False, 3: False, 4: True}


def test_edges(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = train(docs)
    rows = [(1, None, None, None, 7), (2, "", "fr", "", 7), (3, "123 !!", "zz", "s", 7), (4, "the and " * 100_000, "en-GB", None, 7), (4, "the and " * 100_000, "en-GB", None, 7), (None, "die und der", "de", "s", 7)]
    got = document_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, p int"), model).collect()
    assert len(got) == 6
    by = {r.doc_id: r for r in got}
    assert [by[k].accepted for k in (1, 2, 3, 4)] == [False, False, False, True] and by[1].language == "und" and by[4].language == "en"
    empty = spark.createDataFrame([], docs.schema)
    assert document_languages(empty, model).count() == 0
    assert document_languages(empty, train(empty)).count() == 0
    assert plain_text("a<script>b</script><!-- c --><p>d&amp;e") == "a   d e" and plain_text(None) is None


def plain(rows, model):
    """(language, posterior, text_language, accepted) of each row (text, declared, url, host), in plain Python."""
    langs, table = model.languages, model.table.tolist()

    def softmax(x):
        e = [math.exp(v - max(x)) for v in x]
        return [v / sum(e) for v in e]

    seen = []
    for text, declared, url, host in rows:
        raw = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())
        raw = [b if 97 <= b <= 122 or b >= 128 else 32 for b in raw]
        keys = [((a << 16 | b << 8 | c) * 0x9E3779B1 & 0xFFFFFFFF) >> 32 - L.BITS for a, b, c in zip(raw, raw[1:], raw[2:]) if (a, b, c) != (32, 32, 32)]
        n = len(keys)
        ll = [sum(table[k][j] for k in keys) * L.TEMPER * min(n, L.MOST_TRIGRAMS) / max(n, 1) for j in range(len(langs))]
        tag = (declared or "").strip().replace("_", "-").split("-")[0].lower()
        name = (url or "").split("://")[-1].split("/")[0].split("@")[-1].split(":")[0].split("?")[0] if "://" in (url or "") else ""
        suffix = L.SUFFIX_LANGUAGES.get(name.rsplit(".", 1)[1].lower() if "." in name else "", "")
        parts = (host or "").split(".")
        domain = ".".join(parts[-2:]) if len(parts) > 1 and all(parts[-2:]) else ""
        seen.append((n, ll, softmax(ll) if n else [0.0] * len(langs), tag if tag in langs else "", suffix if suffix in langs else "", host, domain))

    def sums(at, value, kinds=range(len(langs))):
        return [sum(x[2][k] for x in seen if x[at] == value) for k in kinds]

    whole = [sum(x[2][k] for x in seen) for k in range(len(langs))]
    prior = [(w + 1) / (sum(whole) + len(langs)) for w in whole]
    out = []
    for n, ll, p, declared, suffix, host, domain in seen:
        own = 1.0 if n else 0.0
        score = []
        for k in range(len(langs)):
            at_host = [x for x in seen if x[5] == host] if host is not None else []
            at_domain = [x for x in seen if x[5] is not None and x[6] == domain] if host is not None else []
            of = lambda xs: max(sum(x[2][k] for x in xs) - p[k], 0.0) if xs else 0.0  # noqa: B023, E731
            size = lambda xs: sum(x[0] > 0 for x in xs) - own if xs else 0.0  # noqa: B023, E731
            d = (of(at_domain) + L.SMOOTH_DOMAIN * prior[k]) / (size(at_domain) + L.SMOOTH_DOMAIN)
            h = (of(at_host) + L.SMOOTH_HOST * d) / (size(at_host) + L.SMOOTH_HOST)
            total = math.log(h) + ll[k]
            for at, value in ((3, declared), (4, suffix)):
                if value:
                    total += math.log((sums(at, value)[k] + L.SMOOTH_TABLE / (len(langs) + 1)) / (whole[k] + L.SMOOTH_TABLE))
            score.append(total)
        q = softmax(score)
        unknown = min(n, L.MOST_TRIGRAMS) * L.TEMPER * L.BACKGROUND + math.log(L.UNKNOWN / (1 - L.UNKNOWN))
        first = lambda x: langs[x.index(max(x))] if n else "und"  # noqa: B023, E731
        out.append((first(q), max(q) if n else 0.0, first(p), n > 0 and max(q) >= L.LEAST_POSTERIOR and max(ll) >= unknown))
    return out


@pytest.mark.parametrize("share", [1e-4, 0.08, 2.0])
def test_posteriors_against_plain_python(spark, share, monkeypatch):
    monkeypatch.setattr(L, "HOT_SHARE", share)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = train(docs)
    rnd = random.Random(2)
    texts = [r.text for r in docs.select("text").limit(60).collect()]
    rows = []
    for _ in range(120):
        words = rnd.choice(texts).split()
        text = rnd.choice([" ".join(words[: rnd.randint(1, 30)]), " ".join(words), None, "", "12 !", "Это", "x"]) if rnd.random() < 0.4 else " ".join(words[:8])
        host = rnd.choice(["a.example.fr", "b.example.fr", "c.other.de", "web", "web", "web", "", None, "x..y"])
        rows.append((text, rnd.choice([None, "en", "fr-FR", "DE_at", "zz", "", " es "]), rnd.choice([None, "http://u@a.b.FR:80/x", "https://q.de/", "ftp:x", "http://h.mx?z"]), host))
    rows.append(rows[0])
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id long, text string, declared string, url string, host string")
    got = {r.id: r for r in identified(evidence(df, model), model).collect()}
    assert len(got) == len(rows)
    for i, (language, posterior, text_language, accepted) in enumerate(plain(rows, model)):
        r = got[i]
        assert (r.language, r.text_language, r.accepted) == (language, text_language, accepted), rows[i]
        assert abs(r.posterior - posterior) < 1e-4


@pytest.mark.parametrize("share", [1e-4, 0.2, 2.0])
def test_joined_by_weight(spark, share, monkeypatch):
    monkeypatch.setattr(L, "HOT_SHARE", share)
    rows = [(i, k) for i, k in enumerate(["a"] * 30 + ["b"] * 5 + [None] * 7 + ["c", "none"])]
    table = [("a", 30, 1), ("b", 5, 2), ("c", 1, 3)]
    got = joined_by_weight(spark.createDataFrame(rows, "i int, k string"), spark.createDataFrame(table, "k string, w long, v int"), "k", "w").collect()
    assert sorted((r.i, r.v) for r in got) == [(i, {"a": 1, "b": 2, "c": 3}.get(k)) for i, k in rows]


def test_documents_query_accepts_nearly_all(spark):
    rows = documents_query(spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert sum(r.accepted for r in rows) >= 0.99 * len(rows)


def test_page_edges(spark):
    model = train(spark.read.parquet(f"{SF}/documents.parquet"))
    schema = "page_id long, url string, html string, host string, `a.b` int"
    rows = [(1, None, None, "z", 1), (2, "", "", None, 1), (3, "http://x.de/", "<p></p>", "z", 1), (4, "http://x.de/", "<p>die und der das</p>" * 50_000, "z", 1), (4, "http://x.de/", "<p>die und der das</p>" * 50_000, "z", 1), (None, "http://x.de/", "<html lang=de>die und der das ist nicht</html>", "z", 1)]
    got = page_languages(spark.createDataFrame(rows, schema), model).collect()
    assert sorted((r.page_id or 0, r.language) for r in got) == [(0, "de"), (1, "und"), (2, "und"), (3, "und"), (4, "de"), (4, "de")]
    assert page_languages(spark.createDataFrame([], schema), model).count() == 0
