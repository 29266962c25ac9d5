"""Streams in several micro-batches give what their batch twins give."""

import pandas as pd
from pyspark.sql import functions as F

from emberline.operators import speech as sp
from emberline.streaming import operators as st
from test_ordered import SCHEMA, by_session, machine, random_frames


def written_in_parts(spark, rows, path, parts=3):
    """Files in time order, one micro-batch each."""
    ordered = sorted(rows, key=lambda r: (r[2], r[1]))
    size = -(-len(ordered) // parts)
    for n in range(parts):
        spark.createDataFrame(ordered[n * size : (n + 1) * size], SCHEMA).coalesce(1).write.mode("append").parquet(str(path))
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(path))


def same(a, b):
    return sorted(map(tuple, a)) == sorted(map(tuple, b))


def test_changes_throttle_and_segments(spark, tmp_path):
    rows = random_frames(21, sessions=3, n=40)
    batch = spark.createDataFrame(rows, SCHEMA)
    stream = written_in_parts(spark, rows, tmp_path / "frames")
    assert same(st.run_once(st.changed_rows(stream), "c").collect(), sp.changes(batch).select("session", "frame_id", "t_us", "text").collect())
    assert same(
        st.run_once(st.throttled(stream), "t").collect(), sp.throttled(batch.select("session", "frame_id", "t_us")).select("session", "frame_id", "t_us").collect()
    )
    got = st.run_once(st.energy_segments(stream, loud_frames=2, quiet_frames=3), "s").collect()
    want = [(s, a, "speech_start", a) for s, f in by_session(rows).items() for a, _ in machine(f, 0.012, 2, 3)]
    want += [(s, a, "speech_end", b) for s, f in by_session(rows).items() for a, b in machine(f, 0.012, 2, 3) if b is not None]
    assert same(got, want)


def test_stable_text_fires_by_timer(spark, tmp_path):
    rows = [(1, 1, 1_000_000, 0.0, "aa"), (2, 2, 1_100_000, 0.0, "bb"), (2, 3, 1_200_000, 0.0, "cc"), (3, 4, 60_000_000, 0.0, "dd")]
    stream = written_in_parts(spark, rows, tmp_path / "frames", 2)
    got = st.run_once(st.stable_texts(stream), "x").collect()
    assert sorted(r["text"] for r in got) == ["aa", "cc"]


def test_clauses_carry_over_batches(spark, tmp_path):
    schema = "session_id long, turn long, text string, is_last boolean"
    for n, (text, last) in enumerate([("今天", False), ("天气好，明", False), ("天呢", True), ("好的。", True)]):
        spark.createDataFrame([(1, n, text, last)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "d"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "d"))
    got = st.run_once(st.clauses(stream), "cl").orderBy("sentence_id").collect()
    assert [(r["sentence_id"], r["clause"]) for r in got] == [(1, "今天天气好，"), (2, "明天呢"), (3, "好的。")]


def test_late_rows_are_dropped(spark, tmp_path):
    # the watermark of one micro-batch makes rows of the next but one late
    first = [(1, 1, 30_000_000, 0.1, "a"), (1, 2, 90_000_000, 0.1, "b")]
    second, third = [(1, 4, 200_000_000, 0.1, "d")], [(1, 3, 31_000_000, 0.1, "c"), (1, 5, 300_000_000, 0.1, "e")]
    for part in (first, second, third):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "l"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "l"))
    stream = stream.withColumns({"bad": F.lit(False), "bytes": F.lit(1024)})
    got = st.run_once(st.second_diagnostics(stream), "late").collect()
    assert sorted(r["second"] for r in got) == [30, 90, 200]


def test_user_supplied_vectors(spark):
    from emberline.operators.textvectors import embedded

    def lengths(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [float(len(t)), 1.0])

    rows = spark.createDataFrame([("ab",), ("abc",)], "t string")
    assert [r["vec"] for r in embedded(rows, "t", lengths).orderBy("t").collect()] == [[2.0, 1.0], [3.0, 1.0]]


def fed(spark, parts, schema, path):
    """One micro-batch per part, in the given order."""
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(path))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(path))


def in_parts(rows, n, at=2):
    ordered = sorted(rows, key=lambda r: (r[at], r[1]))
    size = -(-len(ordered) // n)
    return [ordered[i * size : (i + 1) * size] for i in range(n)]


def later(rows):
    """Times after the epoch, as the watermark begins there."""
    return [(s, f, t + 1_000_000, *rest) for s, f, t, *rest in rows]


def test_files_in_reverse_order_and_a_hot_session(spark, tmp_path):
    # session 0 holds more than a third of all rows
    rows = later(random_frames(31, sessions=3, n=60, step=900_000))
    batch = spark.createDataFrame(rows, SCHEMA)
    stream = fed(spark, in_parts(rows, 3)[::-1], SCHEMA, tmp_path / "back")
    late = "1 hour"
    assert same(st.run_once(st.changed_rows(stream, late=late), "c").collect(), sp.changes(batch).select("session", "frame_id", "t_us", "text").collect())
    want = sp.throttled(batch.select("session", "frame_id", "t_us")).select("session", "frame_id", "t_us").collect()
    assert same(st.run_once(st.throttled(stream, late=late), "t").collect(), want)
    settings = {"loud_frames": 2, "quiet_frames": 3}
    want = [(s, a, "speech_start", a) for s, f in by_session(rows).items() for a, _ in machine(f, 0.012, 2, 3)]
    want += [(s, a, "speech_end", b) for s, f in by_session(rows).items() for a, b in machine(f, 0.012, 2, 3) if b is not None]
    assert same(st.run_once(st.energy_segments(stream, late=late, **settings), "s").collect(), want)
    got = st.run_once(st.speech_partials(stream, late=late, every_ms=600, after_ms=96, **settings), "p").collect()
    assert got and same(got, partials_by_hand(rows, 600, 96, **settings))
    assert same(sp.speech_partials(batch, every_ms=600, after_ms=96, **settings).select("session", "open_pos", "frame_id", "t_us").collect(), got)


def partials_by_hand(rows, every_ms, after_ms, loud_frames, quiet_frames):
    """Frame by frame: speech begins, is counted, and is heard again after enough of it and of time."""
    out = []
    for session, frames in by_session(rows).items():
        segments = machine(frames, 0.012, loud_frames, quiet_frames)
        for opened, closed in segments:
            last, speech = None, 0
            for pos in range(opened, len(frames) if closed is None else closed):
                speech += 32
                t = frames[pos][2]
                if speech >= after_ms and (last is None or t - last >= every_ms * 1000):
                    out.append((session, opened, frames[pos][1], t))
                    last = t
    return out


def test_rows_wait_for_the_watermark(spark, tmp_path):
    """Without a mark of the end, rows that could still be overtaken are held back."""
    parts = [[(1, 1, 1_000_000, 0.0, "a"), (1, 3, 3_000_000, 0.0, "a")], [(1, 2, 2_000_000, 0.0, "b")], [(1, 4, 60_000_000, 0.0, "c")]]
    stream = st.changed_rows(fed(spark, parts, SCHEMA, tmp_path / "w"))
    del stream._end_marks
    assert sorted(r["frame_id"] for r in st.run_once(stream, "w").collect()) == [1, 2, 3]


def test_forgotten_state_begins_anew(spark, tmp_path):
    parts = [[(1, 1, 1_000_000, 0.0, "a")], [(2, 2, 100_000_000, 0.0, "x")], [(2, 3, 200_000_000, 0.0, "x")], [(1, 4, 201_000_000, 0.0, "a")]]
    stream = fed(spark, parts, SCHEMA, tmp_path / "f")
    assert sorted(r["frame_id"] for r in st.run_once(st.changed_rows(stream), "f").collect()) == [1, 2]
    got = st.run_once(st.changed_rows(stream, forget_us=20_000_000), "g").collect()
    assert {1, 2, 4} <= {r["frame_id"] for r in got}


SEGMENTS = "session long, frame_id long, t_us long, seg_id string, text string"


def idle_by_hand(rows):
    from emberline.operators.dialogue import LAST_PLACE

    out = []
    for session in {r[0] for r in rows}:
        spans = []
        for r in sorted((r for r in rows if r[0] == session), key=lambda r: (r[2], r[1])):
            if not spans or r[2] - spans[-1][-1][2] >= 5_000_000:
                spans.append([])
            spans[-1].append(r)
        for span in spans:
            texts = {}
            for n, (_, _, _, seg, text) in enumerate(span):
                if text:
                    texts[seg] = (texts.get(seg, (n,))[0], text)

            def place(item):
                seg, (first, _) = item
                if seg is not None and seg.isdigit():
                    digits = seg.lstrip("0")
                    return (int(digits or 0), 0, "", first) if len(digits) <= 9 else (LAST_PLACE, len(digits), digits, first)
                return (LAST_PLACE, 1 << 30, "", first)

            out.append((session, span[0][2], span[-1][2] + 5_000_000, "".join(t for _, (_, t) in sorted(texts.items(), key=place)).strip()))
    return out


def test_idle_transcripts_lose_no_segment(spark, tmp_path):
    import random

    from emberline.operators.dialogue import idle_transcripts

    rng = random.Random(8)
    ids = ["x", "y", "7", "007", "12345678901234567890", "12345678901234567891", "0", None, "10", "9"]
    rows = [(1, 1, 1_000_000, "x", "A"), (1, 2, 1_100_000, "y", "B"), (1, 3, 1_200_000, "7", "C"), (1, 4, 1_300_000, "007", "D"), (1, 5, 1_400_000, "x", "")]
    t, frame = 0, 10
    for session in (2, 2, 2, 3, 4):  # session 2 is hot
        for _ in range(40):
            t += rng.choice([0, 100_000, 900_000, 4_999_999, 5_000_000, 9_000_000])
            rows.append((session, frame, t + 1_000_000, rng.choice(ids), rng.choice(["p", "q", " r", "", None])))
            frame += 1
    batch = spark.createDataFrame(rows, SEGMENTS)
    want = idle_by_hand(rows)
    assert same(idle_transcripts(batch).collect(), want)
    assert next(w[3] for w in want if w[0] == 1) == "CDAB"
    parts = in_parts(rows, 3)
    for name, order in (("there", parts), ("back", parts[::-1])):
        path = tmp_path / name
        end = [(9, 1, 9_000_000_000_000, "x", "end")]
        got = st.run_once(st.idle_transcripts(fed(spark, [*order, end], SEGMENTS, path), late="1 hour"), "idle").collect()
        assert same(got, want)


def test_barge_ins_of_long_and_uncut_outputs(spark, tmp_path):
    outputs = [(1, 1, 1_000_000, 11_000_000), (1, 2, 2_000_000, 3_000_000), (1, 3, 20_000_000, 80_000_000), (2, 4, 1_000_000, 900_000_000), (2, 5, 5_000_000, None)]
    said = [(1, 6_000_000), (1, 6_500_000), (1, 3_000_000), (1, 79_000_000), (3, 4_000_000), (2, 899_000_000), (2, 950_000_000)]
    out_schema, said_schema = "session long, output_id long, start_us long, end_us long", "session long, t_us long"
    batch = sp.barge_ins(spark.createDataFrame(outputs[:4], out_schema), spark.createDataFrame(said, said_schema)).select("session", "output_id", "start_us", "end_us", "cut_us")
    want = [*map(tuple, batch.collect()), (2, 5, 5_000_000, 5_000_000, None)]
    assert {w[1]: w[4] for w in want} == {1: 3_000_000, 2: None, 3: 79_000_000, 4: 899_000_000, 5: None}
    for name, step in (("there", 1), ("back", -1)):
        o = fed(spark, [outputs[:2][::step], outputs[2:]][::step], out_schema, tmp_path / f"o{name}")
        s = fed(spark, [said[:3], said[3:]][::step], said_schema, tmp_path / f"s{name}")
        got = st.run_once(st.barge_ins(o, s, late="1 hour"), "barge").collect()
        assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_stable_text_is_compared_stripped(spark, tmp_path):
    rows = [(1, 1, 1_000_000, 0.0, "aa"), (1, 2, 1_200_000, 0.0, " aa "), (1, 3, 1_300_000, 0.0, "  "), (1, 4, 1_600_000, 0.0, "aa"), (1, 5, 1_700_000, 0.0, "b")]
    assert [tuple(r) for r in sp.stable_triggers(spark.createDataFrame(rows, SCHEMA)).collect()] == [(1, 1_000_000, 1_550_000, "aa")]
    got = st.run_once(st.stable_texts(written_in_parts(spark, rows, tmp_path / "frames", 2)), "x").collect()
    assert [tuple(r) for r in got] == [(1, 1_000_000, 1_550_000, "aa")]


def test_clauses_and_history_in_reverse_order(spark, tmp_path):
    schema = "session_id long, turn long, text string, is_last boolean"
    rows = [(1, 0, "今天", False), (1, 1, "天气好，明", False), (1, 2, "天呢", True), (1, 3, "好的。再说一句话吧！好", False), (1, 4, None, True)]
    stream = fed(spark, [[r] for r in rows[::-1]], schema, tmp_path / "d")
    got = st.run_once(st.clauses(stream), "cl").orderBy("sentence_id").collect()
    assert [r["clause"] for r in got] == ["今天天气好，", "明天呢", "好的。再说一句话吧！", "好"]
    got = st.run_once(st.recent_texts(stream.drop("is_last"), 2), "h").orderBy("turn").collect()
    assert [r["context"] for r in got] == ["", "今天", "今天 天气好，明", "天气好，明 天呢", "天呢 好的。再说一句话吧！好"]


def test_sessions_share_a_lane(spark, tmp_path, monkeypatch):
    """Many sessions in one key of the stream stay apart, also over releases; rows without a session stay out."""
    monkeypatch.setattr(st, "LANES", 1)
    rows = later(random_frames(41, sessions=9, n=30, step=900_000))
    batch = spark.createDataFrame(rows, SCHEMA)
    stream = fed(spark, in_parts([*rows, (None, 10_000, 5_000_000, 0.5, "a")], 3), SCHEMA, tmp_path / "lanes")
    assert same(st.run_once(st.changed_rows(stream), "c").collect(), sp.changes(batch).select("session", "frame_id", "t_us", "text").collect())
    want = sp.throttled(batch.select("session", "frame_id", "t_us")).select("session", "frame_id", "t_us").collect()
    assert same(st.run_once(st.throttled(stream), "t").collect(), want)
    got = st.run_once(st.speech_partials(stream, every_ms=600, after_ms=96, loud_frames=2, quiet_frames=3), "p").collect()
    assert got and same(got, partials_by_hand(rows, 600, 96, loud_frames=2, quiet_frames=3))
    segments = [(s, f, t * 7, str(f % 4) if f % 5 else None, text) for s, f, t, _, text in rows]
    end = [(9_999, 1, 9_000_000_000_000, "x", "end")]
    got = st.run_once(st.idle_transcripts(fed(spark, [*in_parts(segments, 3), end], SEGMENTS, tmp_path / "idle")), "i").collect()
    assert same(got, idle_by_hand(segments))
