"""The lines of copy workers as a stream: status (@ready, @layout, @copy, @total, @progress, @sync) and dd's own lines.

Parsing is in column expressions. The order of a job's status lines, its rate and its chart are kept in state that is bounded: eight
samples, a mark and the number of bars, and the last messages.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: The steps of a job in their order; progress may repeat.
STEPS = ["@ready", "@layout", "@copy", "@total", "@progress", "@sync"]


def split_lines(chunk: Column) -> Column:
    """Lines of a text that ends lines with CR or LF; empty ones go."""
    return F.filter(F.split(chunk, "[\r\n]"), lambda x: x != "")


def parse_status(df: DataFrame, line: str = "line") -> DataFrame:
    """Adds word, and rest (the layout), total, done, written from a status line; null where it has none."""
    text = F.trim(F.col(line))
    word, rest = F.substring_index(text, " ", 1), F.when(F.contains(text, F.lit(" ")), F.regexp_extract(text, r"^\S+ (.*)$", 1)).otherwise("")
    numbers = F.filter(F.split(rest, r"\s+"), lambda x: x != "")
    n = lambda k: F.when(F.get(numbers, F.lit(k)).rlike("^[0-9]+$"), F.get(numbers, F.lit(k)).try_cast("bigint"))
    return df.withColumns({"word": word, "layout": F.when(word == "@layout", rest), "total": F.when(word == "@total", n(0)), "done": F.when(word == "@progress", n(0)), "written": F.when(word == "@progress", n(1))})


def dd_progress(line: Column) -> Column:
    """The bytes of dd's progress line, else null."""
    return F.when(F.trim(line).rlike("^[0-9]+ byte"), F.regexp_extract(F.trim(line), "^([0-9]+) ", 1).try_cast("bigint"))


def dd_record_count(line: Column) -> Column:
    """Whether it is a line such as `1192+1 records in`."""
    return F.trim(line).rlike(r"^[0-9+]*\+[0-9+]* records")


def dd_message(line: Column) -> Column:
    """dd's line if it is neither empty, progress nor a record count."""
    t = F.trim(line)
    return F.when((t != "") & dd_progress(line).isNull() & ~dd_record_count(line), t)


PROGRESS = "job string, lines long, done long, written long, total long, rate double, bars int, bar double, order_ok boolean, finished boolean"
STATE = "step int, first double, mark double, marked long, bars int, bar double, done long, written long, total long, lines long, ok boolean, samples string"


def _advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """One job: state holds eight samples, the last bar's mark, and how far the protocol is."""
    names = [c.split(" ")[0] for c in STATE.split(", ")]
    s = dict(zip(names, state.get, strict=True)) if state.exists else {"step": -1, "first": None, "mark": None, "marked": 0, "bars": 0, "bar": None, "done": 0, "written": None, "total": None, "lines": 0, "ok": True, "samples": "[]"}
    samples = json.loads(s["samples"])
    rows = pd.concat(list(batches), ignore_index=True).sort_values(["ts", "seq"], kind="stable")
    for r in rows.itertuples():
        s["lines"] += 1
        if r.word not in STEPS:
            continue
        step = STEPS.index(r.word)
        # a copy may not begin, nor report, before the step it follows; only progress comes more than once
        fine = step > s["step"] or step == s["step"] == STEPS.index("@progress")
        s["ok"] = bool(s["ok"] and fine and (step < 4 or s["step"] >= 2))
        s["step"] = max(s["step"], step)
        now = r.ts.timestamp()
        if r.word == "@copy":
            s["first"], s["mark"] = now, now
        elif r.word == "@total" and not pd.isna(r.total):
            s["total"] = int(r.total)
        elif r.word == "@progress" and not pd.isna(r.done):
            s["done"] = int(r.done)
            s["written"] = s["written"] if pd.isna(r.written) else int(r.written)
            moved = s["done"] if s["written"] is None else s["written"]
            if s["mark"] is not None and now - s["mark"] >= 0.9:
                s["bar"], s["bars"] = max(0, moved - s["marked"]) / (now - s["mark"]), s["bars"] + 1
                s["mark"], s["marked"] = now, moved
            samples = [*samples, [now, moved]][-8:]
    rate = None
    if samples and samples[-1][0] - samples[0][0] >= 0.5:
        rate = max(0, samples[-1][1] - samples[0][1]) / (samples[-1][0] - samples[0][0])
    elif samples and s["first"] is not None and samples[-1][0] - s["first"] > 0.5:
        rate = samples[-1][1] / (samples[-1][0] - s["first"])
    s["samples"] = json.dumps(samples)
    state.update(tuple(s[n] for n in names))
    yield pd.DataFrame({"job": [key[0]], "lines": [s["lines"]], "done": [s["done"]], "written": pd.array([s["written"]], "Int64"), "total": pd.array([s["total"]], "Int64"), "rate": [rate], "bars": [s["bars"]], "bar": [s["bar"]], "order_ok": [s["ok"]], "finished": [s["step"] == len(STEPS) - 1]}).astype({"rate": "float64", "bar": "float64", "bars": "int32"})


def job_progress(lines: DataFrame) -> DataFrame:
    """A stream (job string, ts timestamp, seq long, line string) to each job's progress after a trigger: counters, rate over the latest
    eight samples, the last chart bar, whether the protocol's order holds. Output mode update."""
    parsed = parse_status(lines).select("job", "ts", "seq", "word", "total", "done", "written")
    return parsed.groupBy("job").applyInPandasWithState(_advance, PROGRESS, STATE, "update", GroupStateTimeout.NoTimeout)


def current_job(lines: DataFrame, job: str) -> DataFrame:
    """Without lines of jobs that are no longer shown."""
    return lines.where(F.col("job") == job)


def finish(progress: Column, total: Column, rate: Column) -> Column:
    """Seconds left, null if the rate is unknown or 0."""
    return F.when((rate > 0) & (total >= progress), (total - progress) / rate)


def percent(progress: Column, total: Column) -> Column:
    return F.when(total > 0, F.least(F.floor(progress * 100 / total), F.lit(100)))


def progress_line(done: Column, written: Column) -> Column:
    """The status line for a progress report."""
    return F.concat_ws(" ", F.lit("@progress"), done.cast("string"), written.cast("string"))


class _Offsets(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        super().__init__(path)
        self.path, self.start, self.end = path, start, end


class _LineReader(DataSourceStreamReader):
    """Offsets are the bytes of each file so far; a line counts once it has ended."""

    def __init__(self, options: dict):
        self.folder, self.most = options["path"], int(options.get("maxbytespertrigger", options.get("maxBytesPerTrigger", 16 << 20)))
        self.seen: dict[str, int] = {}

    def _ended(self, name: str) -> int:
        """How far the file's lines have ended: only what came since the last look is read, at most `most` bytes of it, but always a whole line."""
        path, start = os.path.join(self.folder, name), self.seen.get(name, 0)
        size, length = os.path.getsize(path), self.most
        with open(path, "rb") as f:
            while size > start:
                f.seek(start)
                data = f.read(length)
                end = max(data.rfind(b"\n"), data.rfind(b"\r")) + 1
                if end or start + len(data) >= size:
                    return start + end
                length *= 2
        return start

    def _sizes(self) -> dict[str, int]:
        self.seen = {name: self._ended(name) for name in sorted(os.listdir(self.folder))}
        return dict(self.seen)

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return self._sizes()

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self.seen = {**end, **self.seen}
        return [_Offsets(os.path.join(self.folder, n), start.get(n, 0), e) for n, e in end.items() if e > start.get(n, 0)]

    def read(self, partition: _Offsets) -> Iterator[tuple]:
        with open(partition.path, "rb") as f:
            f.seek(partition.start)
            data = f.read(partition.end - partition.start)
        at = partition.start
        for raw in data.replace(b"\r", b"\n").split(b"\n"):
            if raw:
                yield os.path.basename(partition.path), at, raw.decode("utf-8", "replace")
            at += len(raw) + 1

    def commit(self, end: dict) -> None:
        """Nothing to give back: files stay."""


class WorkerLines(DataSource):
    """Files of a folder that workers append to, one for each job: (job, seq, line); CR and LF both end a line."""

    @classmethod
    def name(cls) -> str:
        return "worker_lines"

    def schema(self) -> str:
        return "job string, seq long, line string"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _LineReader(self.options)
