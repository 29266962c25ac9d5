import zlib

import numpy as np
import public_tokenizers
import pytest
from conftest import AWKWARD
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as entry_module
from emberline.llm import records as r

PATH = public_tokenizers.path("byte_bpe_50k.json")


def want(rows):
    tokenizer, start, found = Tokenizer.from_file(PATH), 0, []
    for doc_id, text in sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or "")):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        found.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return found


def test_whole_texts_come_back(spark, documents):
    docs = documents(AWKWARD, ids=[5, None, 3, 8, 1, 1, 2, 9, 10, 10, -4, 7])
    manifest = r.write_records(docs, PATH)
    got = [tuple(x) for x in r.read_digests(manifest).orderBy("start").collect()]
    assert got == want([(x["doc_id"], x["text"]) for x in docs.collect()])
    ids = {(x["doc_id"], zlib.crc32(np.array(x["ids"], "<u4").tobytes())) for x in r.shuffled(manifest, 7, 3).collect()}
    assert ids == {(a, d) for a, _, _, d in got}
    order = [x["doc_id"] for x in r.shuffled(manifest, 7, 1).collect()]
    assert order == [x["doc_id"] for x in r.shuffled(manifest, 7, 1).collect()] and sorted(map(str, order)) == sorted(str(x[0]) for x in got)
    empty = r.write_records(docs.filter("false"), PATH)
    assert empty.count() == 0 and r.read_digests(empty).count() == 0


def test_query_on_the_small_tables(spark):
    folder = "/root/testdata/sf0.001"
    rows = [tuple(x) for x in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    got = [tuple(x) for x in entry_module.queries()["op2_records"](spark, folder).orderBy("doc_id").collect()]
    assert got == want(rows)


def test_damage_is_found(spark, documents, tmp_path):
    manifest = r.write_records(documents(["a b", "c d"]), PATH, folder=str(tmp_path / "f"))
    for file in (x["file"] for x in manifest.collect()):
        with open(file + ".rec", "r+b") as out:
            out.seek(13)
            out.write(b"\xff")
    with pytest.raises(Exception, match="damaged"):
        r.read_digests(manifest).agg(F.sum("n_tokens")).collect()


def test_pieces_join_to_the_text():
    for text in [t for t in AWKWARD if t] + ["a  b", "a   b \n c ", " x", "x \t y"]:
        assert "".join(r.pieces(text)) == text


def test_encoder_gathers_what_the_tokenizer_gives(monkeypatch):
    import pyarrow as pa

    texts = [t for t in AWKWARD if t is not None] + ["a  b", " x", "x \t y", "x\u00a0 y \u3000z", " ", "a <|endoftext|> b", "one two", "two one", "漢字" * 3000]
    tokenizer = Tokenizer.from_file(PATH)
    expected = [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    for limits in ({}, {"MEMO": 2, "JOINED": 5}, {"KEPT_IDS": 3, "SLICE": 10}):
        for name, value in limits.items():
            monkeypatch.setattr(r, name, value)
        encoder, found = r.Encoder(PATH), []
        batch = pa.RecordBatch.from_pydict({"text": texts * 2})
        for some in r.slices(batch):
            ids, stops = encoder.encode(some["text"])
            found += [ids[a:b].tolist() for a, b in zip([0, *stops], stops)]
        assert found == expected * 2


def test_words_leave_arrow_at_once(monkeypatch):
    import pyarrow as pa
    import pyarrow.compute as pc

    class Words:  # ``to_pylist`` makes an object of Arrow's for every word
        def __init__(self, coded):
            self.indices, self.dictionary = coded.indices, self
            self.to_numpy = coded.dictionary.to_numpy

    class Cut:
        def __init__(self, cut):
            self.offsets, self.cut = cut.offsets, cut

        def flatten(self):
            return self

        def dictionary_encode(self):
            return Words(self.cut.flatten().dictionary_encode())

    class Compute:
        def split_pattern(self, texts, pattern):
            return Cut(pc.split_pattern(texts, pattern))

    monkeypatch.setattr(r, "pc", Compute())
    texts = ["one two one", "", "a  b é"]
    ids, stops = r.Encoder(PATH).encode(pa.array(texts))
    expected = [e.ids for e in Tokenizer.from_file(PATH).encode_batch(texts, add_special_tokens=False)]
    assert [ids[a:b].tolist() for a, b in zip([0, *stops], stops)] == expected


def test_large_ids_take_four_bytes(spark, documents):
    docs = documents(["a b", None])
    wide = r.write_records(docs, PATH, end_id=70_000)
    got = {x["doc_id"]: list(x["ids"]) for x in r.shuffled(wide, 1, 1).collect()}
    a_b = Tokenizer.from_file(PATH).encode("a b", add_special_tokens=False).ids
    assert got == {0: [*a_b, 70_000], 1: [70_000]}
