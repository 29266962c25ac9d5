import random
from itertools import product

import __spark_entry__ as entry_module
from emberline.llm import roles as r

SCHEMA = "conv_id long, turn long, role string, text string, piece int"


def least(roles):
    """Least cost by trying all roles for all turns."""
    found = []
    for new in product((1, 2, 3), repeat=len(roles)):
        p, cost = 0, 0
        for old, q in zip(map(r.code, roles), new):
            cost += r.step_cost(p, q, old, 0)
            p = q
        found.append(cost // r.FINE + (0 if p in r.ENDS else r.INSERT))
    return min(found)


def rendered(rows):
    found = {}
    for row in sorted(rows, key=lambda x: (x["turn"] is not None, x["turn"] or 0, x["tie"])):
        found[row["conv_id"]] = found.get(row["conv_id"], "") + row["piece"]
    return found


def legal(text):
    blocks = [b.split("\n", 1)[0] for b in text.split(r.START)[1:]]
    assert text.startswith(r.START) and text.endswith(r.STOP) and text.count(r.START) == text.count(r.STOP)
    states = [r.ROLES.index(b) for b in blocks]
    return all(q in r.MOVES[p] for p, q in zip([0, *states], states)) and states[-1] in r.ENDS


def test_least_cost_and_legal(spark):
    rng = random.Random(7)
    rows, roles = [], {}
    for conv in [None, *range(60)]:
        n = rng.randint(1, 7)
        said = [rng.choice(["user", "assistant", "system", "Human", None, "tool", " bot "]) for _ in range(n)]
        roles[conv] = [x and x.strip().lower() for x in said]
        rows += [(conv, t, x, rng.choice([None, "", "hi", "some text"]), 1) for t, x in enumerate(said)]
    rng.shuffle(rows)
    got = r.repaired(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    costs = {}
    for x in got:
        costs[x["conv_id"]] = costs.get(x["conv_id"], 0) + x["cost"]
    assert costs == {conv: least(said) for conv, said in roles.items()}
    assert all(legal(text) for text in rendered(got).values())


def test_one_conversation_over_many_parts(spark):
    rng = random.Random(8)
    rows = [(5, rng.randint(0, 50), rng.choice(["user", "assistant", "system", "x"]), rng.choice(["a", "b"]), 1) for _ in range(800)] + [(6, 0, "user", "q", 1)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    results = []
    for n in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got = r.repaired(df).collect()
        results.append(sorted((x["turn"], x["tie"], x["role"], x["action"], x["piece"]) for x in got))
        assert legal(rendered(got)[5])
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert sum(x["cost"] for x in got) > 0 and len(got) == 801
    assert results[0] == results[1] or [x[:2] for x in results[0]] == [x[:2] for x in results[1]]


def test_kept_where_legal(spark):
    rows = [(1, 0, "system", "s", 1), (1, 1, "user", "u", 1), (1, 2, "assistant", "a", 1), (2, 3, "user", None, 1)]
    got = r.repaired(spark.createDataFrame(rows, SCHEMA))
    assert {x["action"] for x in got.collect()} == {"keep"}
    texts = rendered(got.collect())
    assert texts[1] == "<|im_start|>system\ns<|im_end|>\n<|im_start|>user\nu<|im_end|>\n<|im_start|>assistant\na<|im_end|>\n"
    assert r.repaired(spark.createDataFrame([], SCHEMA)).count() == 0


def test_query(spark):
    folder = "/root/testdata/sf0.01"
    got = entry_module.queries()["op10_roles"](spark, folder).collect()
    assert len(got) == spark.read.parquet(f"{folder}/conversations.parquet").count()
    assert all(legal(text) for text in rendered(got).values())
