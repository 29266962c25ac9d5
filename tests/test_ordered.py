"""Ordered operators over sliced sessions against plain loops."""

import random

import pandas as pd
from pyspark.sql import functions as F

from emberline.operators import speech as sp
from emberline.operators.dialogue import assemble_transcripts, with_context
from emberline.operators.sliced import carry, ordered_concat, positions, with_halo

SCHEMA = "session long, frame_id long, t_us long, rms double, text string"


def random_frames(seed, sessions=4, n=120, step=20_000_000):
    """Session 0 holds most rows; gaps are such that slices of a minute hold a few rows each."""
    rng = random.Random(seed)
    rows, frame = [], 0
    for session in range(sessions):
        t = 0
        for _ in range(n * 3 if session == 0 else n):
            t += rng.choice([0, 1000, 300_000, 600_000, 700_000, step])
            rows.append((session, frame, t, rng.choice([0.001, 0.5]), rng.choice(["aa", "aa", "b", "cc"])))
            frame += 1
    rng.shuffle(rows)
    return rows


def by_session(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        out.setdefault(r[0], []).append(r)
    return out


def test_carry_against_pandas(spark):
    rng = random.Random(1)
    rows = [(rng.choice([0, 0, 0, 1, 2]), i, rng.choice([None, 1, 2, 5]), rng.randint(-3, 9)) for i in range(400)]
    df = spark.createDataFrame(rows, "k int, at int, v int, w int").withColumn("s", F.expr("at div 7"))
    specs = {"a": ("sum", F.col("w")), "b": ("max", F.col("w")), "c": ("last", F.col("v")), "d": ("before", F.col("v")), "e": ("prev", F.col("v"))}
    got = carry(df, ["k"], "s", ["at"], specs).toPandas().sort_values(["k", "at"]).reset_index(drop=True)
    pdf = pd.DataFrame(rows, columns=["k", "at", "v", "w"]).sort_values(["k", "at"]).reset_index(drop=True)
    by = pdf.groupby("k")
    assert (got["a"] == by["w"].cumsum()).all() and (got["b"] == by["w"].cummax()).all()
    last = by["v"].ffill()
    assert got["c"].equals(last.astype("float64"))
    assert got["d"].equals(last.groupby(pdf["k"]).shift(1).astype("float64"))
    assert got["e"].equals(by["v"].shift(1).astype("float64"))
    places = positions(df, ["k"], "s", ["at"]).toPandas().sort_values(["k", "at"])
    assert (places["pos"].to_numpy() == by.cumcount().to_numpy()).all()


def test_halo_gives_each_slice_what_it_looks_back_to(spark):
    rows = with_halo(spark.range(50).withColumnRenamed("id", "at"), "at", 10, 3).collect()
    homes = [r for r in rows if r["home"]]
    assert sorted(r["at"] for r in homes) == list(range(50))
    assert sorted(r["at"] for r in rows if not r["home"]) == [s * 10 + d for s in range(5) for d in (7, 8, 9)]


def test_context_over_a_slice_border(spark):
    rows = spark.createDataFrame([(1, i, f"m{i}") for i in range(2010)], "session_id long, turn long, text string")
    got = {r["turn"]: r["context"] for r in with_context(rows, 3, 10, "hint").collect()}
    assert got[0] == "hint" and got[1000] == "hint m997 m998 m999" and got[2001] == "hint m1998 m1999 m2000" and len(got) == 2010


def test_ordered_concat(spark):
    rows = spark.createDataFrame([(1, i, str(i)) for i in (3, 1, 2, 12, 11)], "k int, at int, t string").withColumn("s", F.expr("at div 10"))
    assert ordered_concat(rows, ["k"], "s", ["at"], "t", "out", "-").first()["out"] == "1-2-3-11-12"


def test_transcripts(spark):
    rows = [(1, "10", 0, "c"), (1, "2", 1, "old"), (1, "x", 2, "z"), (1, "2", 3, "b"), (1, "2", 4, "")]
    df = spark.createDataFrame(rows, "session_id int, seg_id string, arrival int, text string")
    assert assemble_transcripts(df).first()["transcript"] == "bcz"


def test_throttle_over_many_slices(spark):
    rows = random_frames(2)
    want = set()
    for frames in by_session(rows).values():
        ready = None
        for r in frames:
            if ready is None or r[2] >= ready:
                want.add((r[0], r[1]))
                ready = r[2] + 700_000
    df = spark.createDataFrame(rows, SCHEMA)
    for width in (60_000_000, 1_000_000, 900_000_000_000):
        got = sp.throttled(df.select("session", "frame_id", "t_us"), slice_us=width).collect()
        assert {(r["session"], r["frame_id"]) for r in got} == want, width


def machine(frames, above, loud_needed, quiet_needed):
    out, speaking, loud, quiet, opened = [], False, 0, 0, None
    for pos, r in enumerate(frames):
        if r[3] > above:
            loud, quiet = loud + 1, 0
            if not speaking and loud >= loud_needed:
                speaking, opened = True, pos
        elif speaking:
            quiet += 1
            if quiet >= quiet_needed:
                out.append((opened, pos))
                speaking, loud, quiet = False, 0, 0
        else:
            loud = 0
    return out + ([(opened, None)] if speaking else [])


def test_energy_segments_equal_the_counter_machine(spark):
    rows = random_frames(3)
    df = spark.createDataFrame(rows, SCHEMA)
    for needed, quiet in ((2, 3), (3, 5), (1, 1)):
        got = {(r["session"], r["open_pos"], r["close_pos"]) for r in sp.energy_segments(df, 0.012, needed, quiet).collect()}
        want = {(s, a, b) for s, frames in by_session(rows).items() for a, b in machine(frames, 0.012, needed, quiet)}
        assert got == want


def test_stable_triggers_and_changes(spark):
    rows = random_frames(4)
    want_changes, want_triggers = set(), set()
    for s, frames in by_session(rows).items():
        runs = []
        for r in frames:
            if not runs or runs[-1][0][4] != r[4]:
                runs.append([r])
            else:
                runs[-1].append(r)
        for i, run in enumerate(runs):
            want_changes.add((s, run[0][1]))
            until = runs[i + 1][0][2] if i + 1 < len(runs) else run[-1][2]
            if len(run[0][4]) >= 2 and until - run[0][2] >= 550_000:
                want_triggers.add((s, run[0][2]))
    df = spark.createDataFrame(rows, SCHEMA)
    assert {(r["session"], r["frame_id"]) for r in sp.changes(df).collect()} == want_changes
    assert {(r["session"], r["start_us"]) for r in sp.stable_triggers(df).collect()} == want_triggers


def test_trailing_window(spark):
    rows = random_frames(5)
    got = {r["frame_id"]: r["trailing_frames"] for r in sp.trailing(spark.createDataFrame(rows, SCHEMA)).collect()}
    for frames in by_session(rows).values():
        for r in frames:
            assert got[r[1]] == sum(r[2] - 10_000_000 <= x[2] <= r[2] for x in frames)


def test_barge_ins(spark):
    outputs = spark.createDataFrame([(1, 1, 0, 130_000_000), (1, 2, 200, 300), (2, 3, 0, 50)], "session int, output_id int, start_us long, end_us long")
    speech = spark.createDataFrame([(1, 125_000_000), (1, 129_000_000), (1, 300), (2, 50)], "session int, t_us long")
    got = {r["output_id"]: r["cut_us"] for r in sp.barge_ins(outputs, speech).collect()}
    assert got == {1: 300, 2: None, 3: None}


def test_reach_beyond_a_slice(spark):
    frames = spark.createDataFrame([(1, n, n * 10_000_000, 0.5, "x") for n in range(30)], SCHEMA)
    got = {r["frame_id"]: r["trailing_frames"] for r in sp.trailing(frames, seconds=90).collect()}
    assert got == {n: min(n, 9) + 1 for n in range(30)}


def test_context_over_gaps_in_turns(spark):
    from emberline.operators import dialogue as dl

    rows = [(1, 10 * n, f"m{n}") for n in range(2500)]
    df = spark.createDataFrame(rows, "session_id long, turn long, text string")
    got = {r["turn"]: r["context"] for r in dl.with_context(df, back=1500, hint=None).collect()}
    assert got == {10 * n: " ".join(f"m{k}" for k in range(max(0, n - 1500), n)) for n in range(2500)}
    assert sorted(r["turn"] for r in dl.recent_history(df, 8).collect()) == [10 * n for n in range(2492, 2500)]
    with_ids = [(1, "12345678901234567890", 1, "D"), (1, "x", 2, "E"), (1, "7", 3, "B"), (1, "007", 9, "C"), (1, "1", 5, "A")]
    segments = spark.createDataFrame(with_ids, "session_id long, seg_id string, arrival long, text string")
    assert dl.assemble_transcripts(segments).first()["transcript"] == "ABCDE"


def test_routing_reads_unicode_white_space(spark):
    from emberline.functions import routing as ro

    df = spark.createDataFrame([(1, "你好\u3000"), (2, "查看\r的煤样"), (3, "其他")], "n int, q string")
    assert [r["a"] for r in df.select("n", ro.keyword_agent(df["q"]).alias("a")).orderBy("n").collect()] == ["simple_chat", "data_management", None]
