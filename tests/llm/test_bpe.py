import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

tokenizers = pytest.importorskip("tokenizers")
public_tokenizers = pytest.importorskip("public_tokenizers")
from hypothesis import given, settings  # noqa: E402
from hypothesis import strategies as st  # noqa: E402

from llm import vectext as vt  # noqa: E402
from llm.bpe import VOCABULARY, codec, decoded, encoded, round_trip  # noqa: E402

THEIRS = tokenizers.Tokenizer.from_file(public_tokenizers.path(VOCABULARY))


def ours(texts):
    ids, bounds = codec().encode(pa.array(texts, pa.string()))
    return [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def theirs(texts):
    return [THEIRS.encode(t or "", add_special_tokens=False).ids for t in texts]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=40), st.text(alphabet="ab' \n\tsrtvelm1.<|>endoftx", max_size=60)), max_size=6))
def test_random_texts(texts):
    assert ours(texts) == theirs(texts)


def test_odd_texts():
    texts = ["it's we'll I'd 've  'tis\n\n x", "a<|endoftext|>b <|endoftext|><|endoftext|> \n", "   ", " \n 　x", "z" * 5000, "É" * 300, "ab" * 200_000, "", None, "😀" * 50, "don't'll", " 's 's", " a b"]
    assert ours(texts) == theirs(texts)
    rnd = random.Random(1)
    mixed = ["".join(chr(rnd.choice([rnd.randrange(32, 127), rnd.randrange(0x80, 0x3000), 32, 10])) for _ in range(400)) for _ in range(200)]
    assert ours(mixed) == theirs(mixed)


def test_equal_hashes_of_different_words(monkeypatch):
    # Thue and Morse's words have equal polynomial hashes modulo 2^64, whatever the base
    word = "a"
    for _ in range(11):
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    texts = [word, other, f"{other} {word}", word[:1024], other[:1024], "abba baab"]
    assert ours(texts) == theirs(texts)
    rnd = random.Random(4)
    texts += [" ".join(rnd.choice(["the", "teh", "cat", "tac", "x" * 70, "y" * 70, "é"]) for _ in range(60)) for _ in range(20)]
    hashes = vt.span_hashes
    for bits in (0, 2, 5):
        monkeypatch.setattr(vt, "span_hashes", lambda *a, bits=bits: hashes(*a) & np.uint64((1 << bits) - 1))
        assert ours(texts) == theirs(texts)


def test_stored_documents_at_a_larger_size():
    import pyarrow.parquet as pq

    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet")["text"].to_pylist()
    assert ours(texts) == theirs(texts)


def test_all_code_points():
    texts = ["".join(chr(c) for c in range(a, a + 256) if not 0xD800 <= c < 0xE000) for a in range(0, 0x30000, 256)]
    bad = [k for k, (a, b) in enumerate(zip(ours(texts), theirs(texts), strict=True)) if a != b]
    assert not bad


def test_frames(spark):
    texts = ["The cat's   meow", None, "", "x" * 1000, "Ünï <|endoftext|>", "The cat's   meow"]
    df = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    got = {r.doc_id: r for r in round_trip(df).collect()}
    for i, t in enumerate(texts):
        ids = theirs([t])[0]
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(THEIRS.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert {r.doc_id: r.text for r in decoded(encoded(df)).collect()} == {i: t or "" for i, t in enumerate(texts)}
    assert round_trip(df.limit(0)).count() == 0


def test_documents():
    import pyarrow.parquet as pq

    texts = pq.read_table("/root/testdata/sf0.001/documents.parquet")["text"].to_pylist()
    assert ours(texts) == theirs(texts)
    ids = np.array(theirs(texts[:1])[0])
    assert codec().decode(ids).decode() == texts[0]
