import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from conftest import AWKWARD

from emberline.llm import piecebpe as b

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def codec():
    return b.Codec(b.read_model(PATH))


def same(codec, library, texts):
    for text, got in zip(texts, codec.encode(texts)):
        want = library.encode(text)
        assert got.tolist() == want, text[:100]
        assert codec.decode(got) == library.decode(want), text[:100]


def test_equals_the_library(codec, library):
    rng = random.Random(5)
    letters = ("abc  e\n.▁é漢thinr-=", "ab", "aehinorst", "=-_ ", "🙂x\t\0 ")
    texts = ["".join(rng.choices(rng.choice(letters), k=rng.randint(1, 200))) for _ in range(1500)]
    same(codec, library, [t or "" for t in AWKWARD] + texts)


def test_runs_of_spaces(codec, library):
    assert codec.run == 16
    for n in range(1, 130):
        same(codec, library, [" " * n + "ab", "q" + " " * n + "é", " " * n + "漢" + " " * n])
    same(codec, library, [" " * 200_000, "x" * 50_000, "the the" * 3000])


def test_long_word_of_many_pairs(codec, library):
    same(codec, library, ["".join(random.Random(1).choices("ABCDEFabcdef0123456789+/", k=20_000))])


def test_words_beyond_the_memo(library, monkeypatch):
    monkeypatch.setattr(b, "MEMO", 3)
    monkeypatch.setattr(b, "FLAT", 10)
    codec = b.Codec(b.read_model(PATH))
    for _ in range(3):
        same(codec, library, ["one two three four", "a " + "long" * 40 + " b", "one two"])


def test_ids_that_no_text_gives(codec, library):
    rng = random.Random(2)
    for _ in range(1000):
        ids = [rng.choice([0, rng.randrange(3, 259), rng.randrange(259, 32000)]) for _ in range(rng.randint(0, 12))]
        assert codec.decode(np.array(ids, "i4")) == library.decode(ids), ids


def test_documents(spark, documents, library):
    model, docs = b.read_model(PATH), documents([*AWKWARD, "one", "one"], ids=[*range(len(AWKWARD)), None, 1])
    encoded = b.encode(docs, model)
    texts = [t or "" for t in AWKWARD] + ["one", "one"]
    got = [list(r["ids"]) for r in encoded.collect()]
    assert got == [library.encode(t) for t in texts]
    assert [r["text"] for r in b.decode(encoded, model).collect()] == [library.decode(library.encode(t)) for t in texts]
    rows = b.digests(docs, model).collect()
    for row, text in zip(rows, texts):
        ids = library.encode(text)
        decoded = hashlib.sha256(library.decode(ids).encode()).hexdigest()
        assert tuple(row)[1:] == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), decoded)
    assert rows[-2]["doc_id"] is None
    assert b.encode(docs.filter("false"), model).count() == b.digests(docs.filter("false"), model).count() == 0


def test_query_equals_the_library(spark, library):
    import __spark_entry__ as entry_module

    folder = "/root/testdata/sf0.001"
    got = {r["doc_id"]: r["ids_sha256"] for r in entry_module.queries()["op11_pieces"](spark, folder).collect()}
    for row in spark.read.parquet(f"{folder}/documents.parquet").collect():
        ids = library.encode(row["text"] or "")
        assert got[row["doc_id"]] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
