import random

from conftest import AWKWARD

import __spark_entry__ as entry_module
from emberline.llm import decontaminate as d

ITEM = "A farmer sells 12 kg of apples to Maria and then Maria sells 5 kg of them to her neighbour for 30 dollars in total."
SAME = "A farmer sells 40 kg of apples to Linda and then Linda sells 7 kg of them to her neighbour for 99 dollars in total."
MIXED = "A farmer sells 40 kg of apples to Linda and then Oskar sells 7 kg of them to her neighbour for 99 dollars in total."


def bench(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")


def test_words_and_slots(spark):
    row = spark.createDataFrame([("We paid 3.50 euros, and Anna (not Bob) ran 5 km. Then 7km; 'x' %%",)], "text string")
    words = row.select(d.marked_words(row["text"]).alias("w")).first()["w"]
    n, u, p = d.NUMBER, d.UNIT, d.NAME
    assert words == ["we", "paid", n + "3.50", u + "euros", "and", p + "anna", "not", p + "bob", "ran", n + "5", u + "km", "then", n + "7km", "x", "%%"]


def test_changed_questions_are_found(spark, documents):
    filler = "some quiet words that stand before and behind it. " * 3
    short = " ".join(ITEM.split()[:12])
    texts = [ITEM, filler + ITEM + filler, filler + SAME, MIXED, filler + short, *AWKWARD, filler, None, ITEM]
    docs = documents(texts)
    got = {r["doc_id"]: r for r in d.contaminated(docs, bench(spark, ITEM, None, "", "too short")).collect()}
    assert set(got) == {0, 1, 2, 20 - 1}, got
    assert got[1]["matched_words"] == got[0]["matched_words"] == 25 and got[0]["n_changed"] == 0
    assert got[2]["n_changed"] == 5 and got[2]["n_slots"] == 8
    kept = d.decontaminated(docs, bench(spark, ITEM))
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == set(range(len(texts))) - set(got)
    assert d.contaminated(docs.filter("false"), bench(spark, ITEM)).count() == 0 and d.decontaminated(docs, bench(spark, None)).count() == len(texts)
    same = documents([ITEM, ITEM, "x"], ids=[None, None, None])
    assert d.contaminated(same, bench(spark, ITEM)).count() == 1 and d.decontaminated(same, bench(spark, ITEM)).count() == 1


def brute(docs, items):
    """All pairs: longest common runs of plain words at every offset."""
    found = {}
    for doc_id, words in docs.items():
        for item_id, item in items.items():
            for offset in range(-len(item), len(words)):
                same = [0 <= j + offset < len(words) and words[j + offset] == w for j, w in enumerate(item)]
                total, run = 0, 0
                for hit in [*same, False]:
                    if not hit and run >= d.RUN:
                        total += run
                    run = run + 1 if hit else 0
                if total:
                    found[doc_id] = max(found.get(doc_id, 0), total)
    return found


def test_runs_equal_brute_force(spark, documents):
    rng = random.Random(5)
    items = {i: rng.choices("abcdefgh", k=rng.randint(8, 40)) for i in range(6)}
    docs = {}
    for i in range(60):
        words = rng.choices("ijklmnop", k=rng.randint(0, 30))
        for _ in range(rng.randint(0, 2)):
            item = items[rng.randrange(6)]
            start = rng.randrange(len(item))
            words += item[start : start + rng.randint(5, 40)] + rng.choices("ijklmnop", k=rng.randint(0, 9))
        docs[i] = words
    got = d.contaminated(documents([" ".join(docs[i]) for i in range(60)]), bench(spark, *(" ".join(items[i]) for i in range(6))))
    assert {r["doc_id"]: r["matched_words"] for r in got.collect()} == brute(docs, items)


def test_query_finds_whole_items_and_stays_native(spark):
    folder = "/root/testdata/sf0.01"
    df = entry_module.queries()["op1_decontaminate"](spark, folder)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "BroadcastNestedLoop" not in plan
    items = [r["text"] for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    hold = {r["doc_id"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect() if any(t in r["text"] for t in items)}
    assert hold <= {r["doc_id"] for r in df.collect()}


def test_names_at_starts_of_sentences(spark, documents):
    item = "Maria buys 12 pens for 3 dollars each. Maria sells 5 of them to a friend at noon."
    filler = "some quiet words that stand before and behind it. " * 3
    texts = [item.replace("Maria", "Linda"), filler + '"' + item.replace("Maria", "Linda") + '" ' + filler, item.lower(), filler]
    texts += [item.replace("Maria", "Linda").replace("each. Linda", "each; Linda"), item.replace("Maria", "she")]
    got = {r["doc_id"]: r for r in d.contaminated(documents(texts), bench(spark, item)).collect()}
    assert set(got) == {0, 1, 2, 4}, got
    assert got[0]["n_changed"] == got[1]["n_changed"] == 2 and got[2]["n_changed"] == 0
    assert all(r["matched_words"] == 18 for r in got.values())


def test_evidence_is_not_dropped_with_what_stands_beside_it(spark, documents):
    verbatim = "the tank takes 5 litres while " + " ".join(f"word{chr(97 + i)}" for i in range(20)) + " and then 5 more litres go out again"
    pears = "take 3 apples and 4 pears from the old basket and put them into the large blue one"
    table = "we list 3 kg 4 kg 5 km 6 km 7 hours 8 hours 9 days 10 days 11 days"
    long = " ".join(f"say {i} of them{chr(97 + i)} here" for i in range(9))
    items = [verbatim, pears, table, long]
    texts = [verbatim.replace("then 5", "then 6"), pears.replace("3", "5").replace("4", "5"), table, long.replace("say 1 ", "say 71 ") + " x", table.replace("kg", "mg")]
    texts += [pears.replace("3", "5").replace("basket", "box"), table.translate(str.maketrans("3456789", "9876543")).replace("days", "weeks").replace("kg", "mg")]
    items.append("now 2 boys and 2 girls carry the wood over the bridge to the mill where 2 men cut it into boards for 9 new boats at the quay by the old church")
    texts.append(items[-1].replace("2 boys", "6 boys").replace("2 girls", "6 girls").replace("2 men", "7 men").replace("9 new", "4 new"))
    got = {r["doc_id"]: r for r in d.contaminated(documents(texts), bench(spark, *items)).collect()}
    assert set(got) == {0, 1, 2, 3, 4, 7}, got
    assert got[2]["n_changed"] == 0 and got[2]["matched_words"] == 20 and got[1]["n_changed"] == 2


def test_short_items_match_whole(spark, documents, tmp_path):
    question, chinese = "How many legs do 4 cats and Anna have in all?", "小明有三个苹果吃了一个还剩几个"
    filler = "some quiet words that stand before and behind it. "
    texts = [question, filler * 3 + question + filler, question.replace("4", "7").replace("Anna", "Linda"), chinese, filler + chinese + "。" + filler]
    texts += [question.replace("legs", "arms"), question[:-8], filler, None, "", "rivers flow", "Rivers flow down", "rivers flew"]
    docs, items = documents(texts), bench(spark, question, chinese, "Rivers flow", None, "", ITEM)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r["doc_id"]: r for r in entry_module.queries()["op1_decontaminate"](spark, str(tmp_path)).collect()}
    assert set(got) == {0, 1, 2, 3, 4, 10, 11}, got
    assert got[1]["matched_words"] == 11 and got[2]["n_changed"] == 2 and got[3]["matched_words"] == 1
    assert {r["doc_id"] for r in d.decontaminated(docs, items).collect()} == set(range(len(texts))) - set(got)
