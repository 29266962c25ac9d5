import hashlib
from collections import Counter

import pytest
from conftest import AWKWARD

from emberline.llm import placement as p


def number(text):
    return int(hashlib.md5(text.encode()).hexdigest()[:13], 16)


def filled(shards, slots):
    owner, taken, at = [-1] * slots, 0, [0] * len(shards)
    while taken < slots:
        for i, name in enumerate(shards):
            offset, skip = number(f"{name}/offset") % slots, number(f"{name}/skip") % (slots - 1) + 1
            while owner[(offset + at[i] * skip) % slots] >= 0:
                at[i] += 1
            owner[(offset + at[i] * skip) % slots] = i
            taken += 1
            if taken == slots:
                return owner
    return owner


@pytest.mark.parametrize("n,slots", [(1, 2), (3, 3), (5, 7), (7, 211), (16, 1601)])
def test_shards_claim_in_turn(spark, n, slots):
    shards = tuple(f"s{i}" for i in range(n))
    got = [r["shard_no"] for r in p.lookup_table(spark, shards, slots).orderBy("slot").collect()]
    assert got == filled(shards, slots)
    assert max(Counter(got).values()) - min(Counter(got).values()) <= 1


def test_few_slots_move_when_a_shard_comes(spark):
    a, b = filled(p.SHARDS, p.SLOTS), filled((*p.SHARDS, "shard-16"), p.SLOTS)
    assert sum(x != y and y != 16 for x, y in zip(a, b)) < 0.15 * p.SLOTS
    with pytest.raises(ValueError):
        p.owners(("a", "b"), 9)


def test_documents_keep_their_columns(spark, documents, tmp_path):
    docs = documents(AWKWARD, ids=[1, 1, None, None, 4, 5, 6, 7, 8, 9, 10, 11])
    placed = p.place(docs)
    assert set(placed.columns) == {*docs.columns, "shard"} and placed.count() == len(AWKWARD)
    table = filled(p.SHARDS, p.SLOTS)
    for r in placed.collect():
        assert r["slot"] == number("" if r["doc_id"] is None else str(r["doc_id"])) % p.SLOTS and r["shard"] == p.SHARDS[table[r["slot"]]]
    p.write_shards(placed, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(AWKWARD)
    assert p.place(docs.filter("false")).count() == 0
    plan = placed._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_clashing_columns_stay(spark):
    docs = spark.createDataFrame([(1, "a", "b", "c"), (None, None, None, None)], "doc_id long, _shard string, _slot string, shard string")
    rows = {r["doc_id"]: r for r in p.place(docs).collect()}
    assert (rows[1]["_shard"], rows[1]["_slot"]) == ("a", "b") and rows[1]["shard"].startswith("shard-") and len(rows) == 2
