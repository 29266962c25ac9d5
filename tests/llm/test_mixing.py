import random

import duckdb
from conftest import AWKWARD

from emberline.llm import mixing as m


def test_mix_keeps_the_contract(spark, documents):
    rng = random.Random(4)
    texts = ["w " * rng.choice([0, 1, 3, 50, 400]) for _ in range(300)] + AWKWARD
    sources = [rng.choice(["a", "b", "c", "d", None, "é", "z"] + ["big"] * 4) for _ in texts]
    ids = [None if rng.random() < 0.05 else rng.randint(0, 250) for _ in texts]
    docs = documents(texts, sources, ids)
    rows = m.mix(docs).select("doc_id", "size", "source_size", "target", "taken").collect()
    assert len(rows) == len(texts) and all(0 <= r["taken"] <= 2 * r["size"] for r in rows)
    by = {}
    for r in rows:
        by.setdefault((r["source_size"], r["target"]), []).append(r["taken"])
    assert all(abs(sum(taken) - target) <= 1 and target <= 2 * size for (size, target), taken in by.items())
    assert abs(sum(t for _, t in by) - 1.5 * sum(s for s, _ in by)) < 1e-6
    db = duckdb.connect()
    db.register("documents", docs.toArrow())
    twin = db.sql(m.OP9_SQL).fetchall()
    key = lambda r: tuple((x is not None, x or 0) for x in r)
    assert sorted(map(tuple, rows), key=key) == sorted(twin, key=key)
    copies = m.mixed_documents(docs)
    assert copies.columns == docs.columns
    words = sum(len(r["text"].encode().split()) for r in copies.collect() if r["text"])
    assert abs(words - sum(t for _, t in by)) <= 20_000 * len(by)
    clashing = docs.withColumns({name: docs["lang"] for name in ("row", "cuts", "time", "here", "_cut0", "source_name", "key")})
    assert m.mixed_documents(clashing).columns == clashing.columns
    assert m.mixed_documents(clashing).count() == copies.count()
    assert m.mix(docs.filter("false")).count() == 0 and m.mixed_documents(docs.filter("false")).count() == 0
    nothing = m.mix(documents([None, "", " "]))
    assert [(r["taken"], r["target"]) for r in nothing.collect()] == [(0, 0.0)] * 3


def test_any_prefix_of_the_schedule_is_close(spark):
    shares = spark.createDataFrame([(0, 700.0), (1, 200.0), (2, 90.0), (3, 10.0), (4, 0.0)], "source_no long, target double")
    slots = sorted(map(tuple, m.schedule(shares, 5000).collect()))
    assert [s[0] for s in slots] == list(range(5000))
    for stop in (10, 100, 1000, 5000):
        for source, share in ((0, 0.7), (1, 0.2), (2, 0.09), (3, 0.01)):
            assert abs(sum(s[1] == source for s in slots[:stop]) - share * stop) <= 4
    assert all(rank == sum(b == s for _, b, _ in slots[:i]) for i, (_, s, rank) in list(enumerate(slots))[:800])


def test_slots_decide_what_is_taken(spark):
    sources = spark.createDataFrame([(0, 1000.5), (1, 1000.5), (2, 1000.5), (3, 5.5)], "source_no long, target double")
    slots = spark.createDataFrame([(s, 0, n) for n, s in enumerate([0] * 10 + [1] * 9 + [2] * 4)], "source_no long, rank long, slot long")
    found = {r["source_no"]: (r["n_slots"], r["ends"]) for r in m.words_of_slots(sources, slots, 100).collect()}
    # trimmed at the target, filled up to it, filled by one block, and less than a block without a slot
    assert found == {0: (10, 1000), 1: (9, 1000), 2: (4, 500), 3: (0, 5)}


def test_first_slots_follow_the_shuffled_order(spark, documents):
    rows = m.mix(documents(["w " * 90 for _ in range(200)], ["a", "b"] * 100)).orderBy("source_no", "key").collect()
    for source in (0, 1):
        places = [r["first_slot"] for r in rows if r["source_no"] == source and r["first_slot"] is not None]
        assert places and places == sorted(places)


def test_sources_give_their_whole_target_whatever_their_slots(spark, documents):
    # 400 small sources whose targets take several blocks, and often fewer slots than that
    sources = [f"s{i % 400:03d}" for i in range(2000)]
    docs = documents([f"w{i} " * (40 + i % 400 % 90) for i in range(2000)], sources)
    rows = m.mix(docs).collect()
    given, wanted = {}, {}
    for r in rows:
        given[r["source_no"]] = given.get(r["source_no"], 0) + r["taken"]
        wanted[r["source_no"]] = int(r["target"] // 1)
    assert len(wanted) == 400 and given == wanted
    assert all((r["first_slot"] is not None) == (r["taken"] > 0) for r in rows)


def test_closing_slots_follow_the_schedule(spark):
    sources = spark.createDataFrame([(0, 1000.5), (1, 1000.5), (2, 5.5), (3, 0.0)], "source_no long, target double")
    slots = spark.createDataFrame([(n, 0, n) for n in range(10)] + [(n, 1, n - 10) for n in range(10, 18)], "slot long, source_no long, rank long")
    found = sorted(map(tuple, m.closing(sources, slots, 100, 18).collect()))[18:]
    assert found == [(19, 1, 8), (20, 2, 0), (23, 1, 9)]
