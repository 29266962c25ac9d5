"""Keyed state for streams of frames and messages.

Rows arrive in any order within the watermark.  ``Ordered`` keeps them until the watermark has passed
them and then hands them on in order, once each; what stays in the state of a lane of sessions is the rows that can
still be overtaken and per session a small summary of those that cannot.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from emberline.functions.text import CLAUSE_BREAK, CLAUSE_CHARS
from emberline.operators.speech import (
    EMIT_AFTER_MS, EMIT_EVERY_MS, EMIT_FLOOR_MS, FRAME_MS, LOUD_ABOVE, LOUD_FRAMES, QUIET_FRAMES, STABLE_CHARS, STABLE_US,
)

NEVER = -(2**62)
LAYOUT = {"bigint": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string()}
BLOCK_ROWS = 50_000


def _ordered(batches: Iterator[pd.DataFrame], order: list[str]) -> pd.DataFrame:
    return pd.concat(list(batches), ignore_index=True).sort_values(order, ignore_index=True)


class Ordered(StatefulProcessor):
    """Rows of the sessions of a lane, each session's in the order of ``order``, whose first column is the event time in microseconds.

    A task pays for each key of a stream, far more than for a row; so many sessions share one key, their lane,
    and its rows wait in blocks.  A subclass names its columns (all of them, with types, the session first), the summary
    that it keeps per session and its default, and turns the rows that are released together into output in
    ``step``.  With ``forget_us`` the summary of a session is dropped once the watermark is so far beyond its last row;
    its next row then is like a first one.
    """

    columns: dict[str, str]
    schema: str
    default: tuple
    output: list[str]
    order = ["t_us", "frame_id"]
    forget_us: int | None = None

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.session = next(iter(self.columns))
        self.layout = pa.schema([(name, LAYOUT[kind]) for name, kind in self.columns.items()])
        self.waiting = handle.getListState("waiting", "block binary")
        self.state = handle.getMapState("state", f"{self.session} bigint", self.schema)
        self.last = handle.getMapState("last", f"{self.session} bigint", "t_us bigint")

    def load(self, session: int) -> tuple:
        found = self.state.getValue((session,))
        return self.default if found is None else tuple(found)

    def step(self, rows: pd.DataFrame, watermark_us: int) -> pd.DataFrame | None:
        """Output for rows in order, session by session; there may be none when a timer of the subclass has fired."""
        raise NotImplementedError

    def spans(self, rows: pd.DataFrame) -> Iterator[tuple[int, int, int]]:
        """Each session with the places where its rows begin and end."""
        keys = rows[self.session].to_numpy()
        begins = [*np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]][: len(keys)]).tolist(), len(keys)]
        return zip(keys[begins[:-1]].tolist(), begins, begins[1:])

    def _keep(self, rows: pd.DataFrame) -> None:
        for begin in range(0, len(rows), BLOCK_ROWS):
            block = pa.RecordBatch.from_pandas(rows.iloc[begin : begin + BLOCK_ROWS], self.layout, preserve_index=False)
            self.waiting.appendValue((block.serialize().to_pybytes(),))

    def _kept(self) -> pd.DataFrame:
        blocks = [pa.ipc.read_record_batch(pa.py_buffer(bytes(row[0])), self.layout) for row in self.waiting.get()] if self.waiting.exists() else []
        rows = pa.Table.from_batches(blocks, self.layout).to_pandas()
        for name, kind in self.columns.items():
            if kind in ("string", "boolean"):
                rows[name] = rows[name].astype(object).where(rows[name].notna(), None)
        return rows

    def handleInputRows(self, key, rows, timerValues):
        batch = pd.concat(list(rows), ignore_index=True)[list(self.columns)]
        if pd.isna(key[0]):  # the lane of the rows without a session
            batch[self.session] = 0
        self._keep(batch)
        self.handle.registerTimer(int(batch[self.order[0]].min()) // 1000 + 1)
        yield pd.DataFrame(columns=self.output)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        through = timerValues.getCurrentWatermarkInMs() * 1000
        rows = self._kept()
        ready = rows[self.order[0]].astype("int64") <= through
        if ready.any():
            later = rows[~ready]
            self.waiting.clear()
            if len(later):
                self._keep(later)
                self.handle.registerTimer(int(later[self.order[0]].min()) // 1000 + 1)
        released = rows[ready].astype({c: "int64" for c in self.order}).sort_values([self.session, *self.order], ignore_index=True)
        out = self.step(released, through)
        if self.forget_us is not None:
            self._forget(released, through)
        if out is None or not len(out):  # columns without rows have lost their types
            out = pd.DataFrame(columns=self.output)
        yield out.assign(**{self.session: None}) if pd.isna(key[0]) else out

    def _forget(self, released: pd.DataFrame, through: int) -> None:
        times = released[self.order[0]].to_numpy()
        for session, _, end in self.spans(released):
            self.last.updateValue((session,), (int(times[end - 1]),))
        seen = [(session[0], last[0] + self.forget_us) for session, last in self.last.iterator()]
        for session, until in seen:
            if until <= through:
                self.state.removeKey((session,))
                self.last.removeKey((session,))
        if waiting := [until for _, until in seen if until > through]:
            self.handle.registerTimer(min(waiting) // 1000 + 1)

    def close(self) -> None:
        pass


class Changes(Ordered):
    """Rows whose value differs from the one before."""

    schema, default = "seen boolean, value string", (False, None)

    def __init__(self, column: str = "text", forget_us: int | None = None):
        self.column, self.forget_us = column, forget_us
        self.columns = {"session": "bigint", "frame_id": "bigint", "t_us": "bigint", column: "string"}
        self.output = list(self.columns)

    def step(self, rows, watermark_us):
        values = rows[self.column].to_numpy(object)
        before, first = np.r_[np.array([None], object), values[:-1]][: len(values)], np.zeros(len(values), bool)
        for session, begin, end in self.spans(rows):
            seen, before[begin] = self.load(session)
            first[begin] = not seen
            self.state.updateValue((session,), (True, values[end - 1]))
        return rows[(values != before) | first]


def spaced(times: np.ndarray, ready: int, step_us: int) -> tuple[list[int], int]:
    """Places of the first time from ``ready`` on, then of each first one a step later; and from when the next may come."""
    picked = []
    at = int(times.searchsorted(ready))
    while at < len(times):
        picked.append(at)
        ready = int(times[at]) + step_us
        at = int(times.searchsorted(ready))
    return picked, ready


class Throttle(Ordered):
    """The first row, then each first row at least the interval later."""

    columns = {"session": "bigint", "frame_id": "bigint", "t_us": "bigint"}
    schema, default, output = "ready_us bigint", (NEVER,), ["session", "frame_id", "t_us"]

    def __init__(self, every_ms: int = EMIT_EVERY_MS, forget_us: int | None = None):
        self.step_us, self.forget_us = max(EMIT_FLOOR_MS, every_ms) * 1000, forget_us

    def step(self, rows, watermark_us):
        times, every = rows["t_us"].to_numpy(), []
        for session, begin, end in self.spans(rows):
            picked, ready = spaced(times[begin:end], self.load(session)[0], self.step_us)
            self.state.updateValue((session,), (ready,))
            every += [begin + place for place in picked]
        return rows.iloc[every]


def follow_segments(state: tuple[int, int, int, int], loud: np.ndarray, loud_frames: int, quiet_frames: int):
    """Segments of one more stretch of frames.

    The state is the number of frames so far and, of the cluster that may go on, its last loud position, the
    start of its last run of loud frames and where its segment opened; -1 where there is none.  A cluster
    goes on while fewer than ``quiet_frames`` quiet frames lie between loud ones.  Returns the new state
    and three arrays, one entry per segment that is open somewhere in the stretch: where it
    opened, whether that was in this stretch, and where it closed (-1: not yet).
    """
    pos, last, run, opened = state
    at = pos + np.flatnonzero(loud)
    total = pos + len(loud)
    before = np.r_[last, at[:-1]][: len(at)]
    parted = (before < 0) | (at - before > quiet_frames)
    broken = parted | (at - before > 1)
    runs = np.maximum.accumulate(np.r_[run, np.where(broken, at, -1)])[1:]
    cluster = np.cumsum(parted)
    count = int(cluster[-1]) + 1 if len(at) else 1
    opens, lasts = np.full(count, -1), np.full(count, -1)
    full = at - runs + 1 == loud_frames
    opens[cluster[full][::-1]] = at[full][::-1]  # of each cluster the first stays
    lasts[0] = last
    lasts[cluster] = at
    old = opened >= 0
    if old:
        opens[0] = opened
    over = (lasts >= 0) & (lasts + quiet_frames < total)
    kept = opens >= 0
    fresh = np.ones(count, bool)
    fresh[0] = not old
    closes = np.where(over, lasts + quiet_frames, -1)
    goes_on = not over[-1] and lasts[-1] >= 0
    new = (total, int(lasts[-1]), int(runs[-1]) if len(at) else run, int(opens[-1])) if goes_on else (total, -1, -1, -1)
    return new, opens[kept], fresh[kept], closes[kept]


class EnergySegments(Ordered):
    """Speech segments by energy; a row at each opening and each closing."""

    columns = {"session": "bigint", "frame_id": "bigint", "t_us": "bigint", "rms": "double"}
    schema, default = "pos bigint, last_loud bigint, run_start bigint, open_pos bigint", (0, -1, -1, -1)
    output = ["session", "open_pos", "event", "pos"]

    def __init__(self, loud_above: float = LOUD_ABOVE, loud_frames: int = LOUD_FRAMES, quiet_frames: int = QUIET_FRAMES, forget_us: int | None = None):
        self.loud_above, self.loud_frames, self.quiet_frames, self.forget_us = loud_above, loud_frames, quiet_frames, forget_us

    def step(self, rows, watermark_us):
        loud, out = rows["rms"].astype("float64").to_numpy() > self.loud_above, []
        for session, begin, end in self.spans(rows):
            state, opens, fresh, closes = follow_segments(self.load(session), loud[begin:end], self.loud_frames, self.quiet_frames)
            self.state.updateValue((session,), state)
            out += [(session, opened, "speech_start", opened) for opened in opens[fresh].tolist()]
            out += [(session, opened, "speech_end", closed) for opened, closed in zip(opens.tolist(), closes.tolist()) if closed >= 0]
        return pd.DataFrame(out, columns=self.output)


class SpeechPartials(Ordered):
    """Frames of a speech segment at which a partial result is due: after enough speech, then at intervals; each segment begins anew."""

    columns = EnergySegments.columns
    schema, default = EnergySegments.schema + ", ready_us bigint", (*EnergySegments.default, NEVER)
    output = ["session", "open_pos", "frame_id", "t_us"]

    def __init__(
        self, every_ms: int = EMIT_EVERY_MS, after_ms: int = EMIT_AFTER_MS, loud_above: float = LOUD_ABOVE, loud_frames: int = LOUD_FRAMES,
        quiet_frames: int = QUIET_FRAMES, frame_ms: int = FRAME_MS, forget_us: int | None = None,
    ):
        self.step_us, self.after = max(EMIT_FLOOR_MS, every_ms) * 1000, -(-max(0, after_ms) // frame_ms)
        self.loud_above, self.loud_frames, self.quiet_frames, self.forget_us = loud_above, loud_frames, quiet_frames, forget_us

    def step(self, rows, watermark_us):
        loud, times = rows["rms"].astype("float64").to_numpy() > self.loud_above, rows["t_us"].to_numpy()
        places, opened_at = [], []
        for session, begin, end in self.spans(rows):
            *machine, ready = self.load(session)
            state, opens, fresh, closes = follow_segments(tuple(machine), loud[begin:end], self.loud_frames, self.quiet_frames)
            at = begin - machine[0]  # the place of the session's frame 0, were it among the rows
            for opened, is_new, closed in zip(opens.tolist(), fresh.tolist(), closes.tolist()):
                first = max(opened + max(0, self.after - 1) + at, begin)
                stop = closed + at if closed >= 0 else end
                picked, ready = spaced(times[first:stop], NEVER if is_new else ready, self.step_us)
                places += [first + place for place in picked]
                opened_at += [opened] * len(picked)
            self.state.updateValue((session,), (*state, ready))
        return rows.iloc[places].assign(open_pos=opened_at)[self.output]


class IdleTranscripts(Ordered):
    """Sessions that end after a pause, each with the latest text of its segments.

    The state of an open session is its span, the names of its segments by number, and per segment the first arrival and
    the latest text that is not empty.  A session that begins and ends in rows released together leaves none.
    """

    columns = {"session": "bigint", "t_us": "bigint", "frame_id": "bigint", "seg_id": "string", "text": "string"}
    schema, default = "start_us bigint, last_us bigint, named bigint", (None, None, 0)
    output = ["session", "start_us", "end_us", "pieces"]

    def __init__(self, idle_us: int):
        self.idle_us = idle_us

    def init(self, handle):
        super().init(handle)
        # a missing segment id is a segment of its own
        self.names = handle.getMapState("names", "session bigint, number bigint", "named boolean, seg_id string")
        self.segments = handle.getMapState("segments", "session bigint, named boolean, seg_id string", "t_us bigint, frame_id bigint, text string")

    def _store(self, session: int, named: int, told: dict) -> int:
        """Add what was told since to the state of an open session; returns how many segments it has."""
        for name, (first, text) in told.items():
            known = self.segments.getValue((session, *name))
            if known is None:
                self.names.updateValue((session, named), name)
                named += 1
            self.segments.updateValue((session, *name), (*(first if known is None else known[:2]), text))
        return named

    def _end(self, session: int, start: int, last: int, named: int, told: dict) -> tuple:
        pieces = dict(told)
        for number in range(named):
            name = tuple(self.names.getValue((session, number)))
            *first, text = self.segments.getValue((session, *name))
            pieces[name] = first, told[name][1] if name in told else text
            self.names.removeKey((session, number))
            self.segments.removeKey((session, *name))
        found = [{"seg_id": name[1] if name[0] else None, "t_us": first[0], "frame_id": first[1], "text": text} for name, (first, text) in pieces.items()]
        return (session, start, last + self.idle_us, found)

    def step(self, rows, watermark_us):
        known = {session[0]: tuple(value) for session, value in self.state.iterator()}
        spans = {session: (begin, end) for session, begin, end in self.spans(rows)}
        times, frames, seg_ids, texts = (rows[name].tolist() for name in ("t_us", "frame_id", "seg_id", "text"))
        out, due = [], []
        for session in known | spans:
            start, last, named = known.get(session, self.default)
            told = {}
            for i in range(*spans.get(session, (0, 0))):
                if start is not None and times[i] - last >= self.idle_us:
                    out.append(self._end(session, start, last, named, told))
                    start, named, told = None, 0, {}
                start, last = times[i] if start is None else start, times[i]
                if texts[i]:
                    name = (seg_ids[i] is not None, seg_ids[i] or "")
                    told[name] = told[name][0] if name in told else (times[i], frames[i]), texts[i]
            if last + self.idle_us <= watermark_us:
                out.append(self._end(session, start, last, named, told))
                if session in known:
                    self.state.removeKey((session,))
                continue
            if session in spans:
                self.state.updateValue((session,), (start, last, self._store(session, named, told)))
            due.append(last + self.idle_us)
        if due:
            self.handle.registerTimer(-(-min(due) // 1000))
        return pd.DataFrame(out, columns=self.output)


class BargeIns(Ordered):
    """Outputs with the first speech that falls into them, or none once their end has passed.

    Rows are outputs (with an id and an end) and speech.  Only outputs that still run wait, each until
    its own end; speech is needed no longer than it takes to be released.
    """

    columns = {"session": "bigint", "t_us": "bigint", "is_output": "boolean", "output_id": "bigint", "end_us": "bigint"}
    schema, default, order = "runs array<struct<output_id: bigint, start_us: bigint, end_us: bigint>>", ([],), ["t_us"]
    output = ["session", "output_id", "start_us", "end_us", "cut_us"]

    def step(self, rows, watermark_us):
        known = {session[0]: [tuple(run) for run in value[0]] for session, value in self.state.iterator()}
        spans = {session: (begin, end) for session, begin, end in self.spans(rows)}
        is_output, times = rows["is_output"].to_numpy(bool), rows["t_us"].to_numpy()
        ids, ends = rows["output_id"].tolist(), rows["end_us"].tolist()
        out, due = [], []
        for session in known | spans:
            begin, end = spans.get(session, (0, 0))
            new = (begin + np.flatnonzero(is_output[begin:end])).tolist()
            runs = known.get(session, []) + [(ids[i], int(times[i]), ends[i]) for i in new]
            if not runs:
                continue
            said = times[begin:end][~is_output[begin:end]]
            first = np.r_[said, 2**62][said.searchsorted([start for _, start, _ in runs])].tolist()
            over = [cut < stop or stop <= watermark_us for cut, (_, _, stop) in zip(first, runs)]
            out += [(session, *run, cut if cut < run[2] else None) for run, cut, done in zip(runs, first, over) if done]
            stay = [tuple(map(int, run)) for run, done in zip(runs, over) if not done]
            due += [stop for _, _, stop in stay]
            if stay and (new or len(stay) < len(runs)):
                self.state.updateValue((session,), (stay,))
            elif not stay and session in known:
                self.state.removeKey((session,))
        if due:
            self.handle.registerTimer(-(-min(due) // 1000))
        found = pd.DataFrame(out, columns=self.output)
        return found.assign(cut_us=found["cut_us"].astype("Int64"))


class StableText(StatefulProcessor):
    """One trigger per run of equal text that lasted long enough; texts are stripped and never blank.

    A later row shows that the run lasted; when none comes, a timer in event time does, as soon as
    the watermark has passed the moment.  A change cancels what is pending.
    """

    schema = "text string, since_us bigint, last_us bigint, fired boolean"
    default = (None, 0, 0, False)
    columns = ["session", "start_us", "trigger_us", "text"]

    def __init__(self, stable_us: int = STABLE_US, min_chars: int = STABLE_CHARS):
        self.stable_us, self.min_chars = stable_us, min_chars

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", self.schema)

    def load(self) -> tuple:
        return tuple(self.state.get()) if self.state.exists() else self.default

    def handleInputRows(self, key, rows, timerValues):
        frame = _ordered(rows, ["t_us", "frame_id"])
        text, since, last, fired = self.load()
        times, texts = frame["t_us"].to_numpy(), frame["text"].to_numpy()
        # runs of equal text; the first may continue the one in the state
        begins = np.flatnonzero(np.r_[texts[0] != text, texts[1:] != texts[:-1]])
        starts, names, done = np.r_[since, times[begins]], [text, *texts[begins]], np.r_[fired, np.zeros(len(begins), bool)]
        # the row that shows that a run lasted: the start of the next run, for the last run its last sight
        until = np.r_[times[begins], times[-1]]
        stable = (until - starts >= self.stable_us) & ~done & [name is not None and len(name) >= self.min_chars for name in names]
        out = [(key[0], int(starts[i]), int(starts[i]) + self.stable_us, names[i]) for i in np.flatnonzero(stable)]
        text, since, last, fired = names[-1], int(starts[-1]), int(times[-1]), bool(done[-1] or stable[-1])
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        if not fired:
            self.handle.registerTimer((since + self.stable_us) // 1000 + 1)
        self.state.update((text, since, last, fired))
        yield pd.DataFrame(out, columns=self.columns)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        text, since, last, fired = self.load()
        out = []
        if text is not None and not fired and len(text) >= self.min_chars:
            out.append((key[0], since, since + self.stable_us, text))
            self.state.update((text, since, last, True))
        yield pd.DataFrame(out, columns=self.columns)

    def close(self) -> None:
        pass


def cut_places(text: str, min_len: int) -> list[int]:
    """Where clauses end: the first mark at least ``min_len`` after the end before, found in the sorted places of marks."""
    marks = np.array([m.end() for m in re.finditer(CLAUSE_BREAK, text)], "i8")
    ends, begin = [], 0
    while (at := int(marks.searchsorted(begin + min_len))) < len(marks):
        begin = int(marks[at])
        ends.append(begin)
    return ends


class ClauseAssembly(Ordered):
    """Text deltas to clauses with running ids; the remainder of a reply is flushed with its last delta."""

    columns = {"session_id": "bigint", "t_us": "bigint", "turn": "bigint", "text": "string", "is_last": "boolean"}
    schema, default, order = "rest string, sentence_id bigint", ("", 0), ["t_us", "turn"]
    output = ["session_id", "sentence_id", "clause"]

    def __init__(self, min_len: int = CLAUSE_CHARS, forget_us: int | None = None):
        self.min_len, self.forget_us = min_len, forget_us

    def step(self, rows, watermark_us):
        texts, whole = rows["text"].tolist(), rows["is_last"].tolist()
        out = []
        for session, begin, end in self.spans(rows):
            rest, number = self.load(session)
            found, parts = [], [rest]
            for i in range(begin, end):
                parts.append(texts[i] or "")
                if not (whole[i] or i == end - 1):
                    continue
                text = "".join(parts)
                ends = cut_places(text, self.min_len)
                found += [text[a:b].strip() for a, b in zip([0, *ends], ends)]
                rest = text[ends[-1] if ends else 0 :]
                if whole[i]:
                    found += [rest.strip()] if rest.strip() else []
                    rest = ""
                parts = [rest]
            self.state.updateValue((session,), (rest, number + len(found)))
            out += [(session, number + 1 + n, clause) for n, clause in enumerate(found)]
        return pd.DataFrame(out, columns=self.output)


class RecentTexts(Ordered):
    """Every message with the texts of the last few before it."""

    columns = {"session_id": "bigint", "t_us": "bigint", "turn": "bigint", "text": "string"}
    schema, default, order = "texts array<string>", ([],), ["t_us", "turn"]
    output = ["session_id", "turn", "text", "context"]

    def __init__(self, size: int, forget_us: int | None = None):
        self.size, self.forget_us = size, forget_us

    def step(self, rows, watermark_us):
        texts, contexts = [text or "" for text in rows["text"].tolist()], []
        for session, begin, end in self.spans(rows):
            known = list(self.load(session)[0])
            every = [*known, *texts[begin:end]]
            short = [text.strip() for text in every]
            contexts += [" ".join(filter(None, short[max(0, i - self.size) : i])) for i in range(len(known), len(every))]
            self.state.updateValue((session,), (every[-self.size :] if self.size else [],))
        return rows.assign(context=contexts)[self.output]
