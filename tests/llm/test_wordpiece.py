import random

import public_tokenizers
from conftest import AWKWARD
from tokenizers import models

import __spark_entry__ as entry_module
from emberline.llm import wordpiece as w


def greedy(word, starts, goes_on):
    n, at = 0, 0
    while at < len(word):
        known = starts if at == 0 else goes_on
        stop = next((e for e in range(len(word), at, -1) if word[at:e] in known), None)
        if stop is None:
            return 0
        at, n = stop, n + 1
    return n


def test_automaton_equals_longest_match():
    rng = random.Random(3)
    for _ in range(60):
        starts = {"".join(rng.choices("abc", k=rng.randint(1, 5))) for _ in range(rng.randint(1, 12))}
        goes_on = {"".join(rng.choices("abc", k=rng.randint(1, 5))) for _ in range(rng.randint(1, 12))}
        automaton = w.Automaton(sorted(starts), sorted(goes_on))
        for _ in range(80):
            word = "".join(rng.choices("abc", k=rng.randint(1, 14)))
            assert automaton.length(word) == greedy(word, starts, goes_on), (starts, goes_on, word)


def test_documents(spark, documents):
    starts, goes_on = w.pieces_of(public_tokenizers.path("piece_bpe_32k.model"))
    got = {r["doc_id"]: tuple(r)[1:] for r in w.token_counts(documents(AWKWARD), starts, goes_on).collect()}
    s, g = set(starts), set(goes_on)
    for i, text in enumerate(AWKWARD):
        words = [x.decode() for x in (text or "").encode().split()]
        lengths = [greedy(x, s, g) if len(x) < 1000 else w.Automaton(starts, goes_on).length(x) for x in words]
        assert got[i] == (len(words), lengths.count(0), sum(x or 1 for x in lengths))
    assert w.token_counts(documents(AWKWARD).filter("false"), starts, goes_on).count() == 0


def test_query_equals_the_library(spark):
    folder = "/root/testdata/sf0.001"
    starts, goes_on = w.pieces_of(public_tokenizers.path("piece_bpe_32k.model"))
    vocab = {p: i for i, p in enumerate(dict.fromkeys(["[UNK]", *starts, *("##" + p for p in goes_on)]))}
    model = models.WordPiece(vocab, unk_token="[UNK]", max_input_chars_per_word=1_000_000)
    got = {r["doc_id"]: r["n_pieces"] for r in entry_module.queries()["op3_token_counts"](spark, folder).collect()}
    for row in spark.read.parquet(f"{folder}/documents.parquet").collect():
        assert got[row["doc_id"]] == sum(len(model.tokenize(x.decode())) for x in row["text"].encode().split())
