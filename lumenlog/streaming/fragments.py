"""Fragments whose head is in another batch: held for a short time, then released.

Hosts and programs are spread over shards; a shard's buffer is keyed state. It holds a bounded number of
host-program pairs and of fragments for each, so state is bounded however many hosts there are. What is
held too long is released by a timer, what exceeds a bound at once: nothing is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.multiline import MOST_LINES, is_fragment

HOLD_MS, MOST_KEYS, MOST_HELD, REACH_MS = 10_000, 500, 30, 5_000
OUT = "host string, program string, timestamp timestamp, message string"
KEY = "host string, program string"
HELD = "first long, times array<long>, lines array<string>, since array<long>"


class Buffer:
    """One shard's fragments, as plain values: (host, program) -> [number of first use, [(time in ms, line, held since)]]."""

    def __init__(self, held: dict | None = None, most_keys: int = MOST_KEYS, hold_ms: int = HOLD_MS):
        self.held = held or {}
        self.most_keys, self.hold_ms = most_keys, hold_ms
        self.out: list[tuple[str, str, int | None, str]] = []

    def release(self, key: tuple[str, str], fragments: list[tuple]) -> None:
        self.out += [(*key, at, line) for at, line, _ in fragments]

    def expire(self, now: int) -> None:
        """Releases what is held for longer than ``hold_ms``."""
        for key, (number, own) in list(self.held.items()):
            self.release(key, [f for f in own if now - f[2] > self.hold_ms])
            self._keep(key, number, [f for f in own if now - f[2] <= self.hold_ms])

    def _keep(self, key: tuple[str, str], number: int, own: list[tuple]) -> None:
        if own:
            self.held[key] = [number, own]
        else:
            self.held.pop(key, None)

    def add(self, rows: list[tuple], now: int) -> None:
        """Takes lines (host, program, time in ms or null, message, is fragment) in order.

        A fragment joins the head before it in its second, up to MOST_LINES lines; else it is held. A head
        takes the held fragments within REACH_MS of it, in the order of their times, after its own line.
        """
        heads: dict[tuple, list] = {}  # (host, program, second) -> [place in out, lines]
        for host, program, at, message, fragment in rows:
            key, second = (host, program), None if at is None else at // 1000
            open_head = heads.get((*key, second)) if second is not None else None
            if fragment and open_head and open_head[1] < MOST_LINES:
                h, p, t, text = self.out[open_head[0]]
                self.out[open_head[0]] = (h, p, t, f"{text}\n{message}")
                open_head[1] += 1
            elif fragment and at is not None and self.hold(key, at, message, now):
                continue
            else:
                text, lines = message, 1
                if not fragment and at is not None and key in self.held:
                    number, own = self.held[key]
                    near = sorted((f for f in own if abs(f[0] - at) <= REACH_MS), key=lambda f: f[0])
                    self._keep(key, number, [f for f in own if f not in near])
                    text, lines = "\n".join([message, *(f[1] for f in near)]), 1 + len(near)
                self.out.append((host, program, at, text))
                if not fragment and second is not None:
                    heads[(*key, second)] = [len(self.out) - 1, lines]

    def hold(self, key: tuple[str, str], at: int, message: str, now: int) -> bool:
        """Holds a fragment; false if its pair is full. A new pair beyond the bound releases the oldest one."""
        if key not in self.held:
            if len(self.held) >= self.most_keys:
                oldest = min(self.held, key=lambda k: self.held[k][0])
                self.release(oldest, self.held.pop(oldest)[1])
            self.held[key] = [1 + max((n for n, _ in self.held.values()), default=0), []]
        own = self.held[key][1]
        if len(own) >= MOST_HELD:
            return False
        own.append((at, message, now))
        return True

    def next_timer(self) -> int | None:
        since = [f[2] for _, own in self.held.values() for f in own]
        return min(since) + self.hold_ms + 1 if since else None


class Joiner(StatefulProcessor):
    """The buffer of a shard in the state store; one timer stands for its next expiry."""

    def __init__(self, most_keys: int, hold_ms: int):
        self.most_keys, self.hold_ms = most_keys, hold_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getMapState("held", KEY, HELD)

    def load(self) -> Buffer:
        held = {}
        for k, (first, times, lines, since) in self.state.iterator():
            held[k[0], k[1]] = [first, list(zip(times, lines, since, strict=True))]
        return Buffer(held, self.most_keys, self.hold_ms)

    def save(self, before: dict, buffer: Buffer) -> Iterator[pd.DataFrame]:
        for k in before.keys() - buffer.held.keys():
            self.state.removeKey(k)
        for k, (first, own) in buffer.held.items():
            if before.get(k) != own:
                self.state.updateValue(k, (first, [f[0] for f in own], [f[1] for f in own], [f[2] for f in own]))
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        if (at := buffer.next_timer()) is not None:
            self.handle.registerTimer(at)
        yield pd.DataFrame({"host": [o[0] for o in buffer.out], "program": [o[1] for o in buffer.out], "timestamp": pd.to_datetime([o[2] for o in buffer.out], unit="ms", utc=True), "message": [o[3] for o in buffer.out]}).astype({"host": object, "program": object, "message": object})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        now = timerValues.getCurrentProcessingTimeInMs()
        frames = [f for f in rows if len(f)]
        lines = pd.concat(frames).sort_values("seq", kind="stable") if frames else pd.DataFrame(columns=["host", "program", "millis", "message", "fragment"])
        buffer = self.load()
        before = {k: list(own) for k, (_, own) in buffer.held.items()}
        buffer.expire(now)
        buffer.add([(h, p, None if pd.isna(t) else int(t), m, bool(f)) for h, p, t, m, f in zip(*(lines[c] for c in ("host", "program", "millis", "message", "fragment")), strict=True)], now)
        yield from self.save(before, buffer)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        buffer = self.load()
        before = {k: list(own) for k, (_, own) in buffer.held.items()}
        buffer.expire(timerValues.getCurrentProcessingTimeInMs())
        yield from self.save(before, buffer)

    def close(self) -> None:
        pass


def reassembled_stream(rows: DataFrame, shards: int = 16, most_keys: int = MOST_KEYS, hold_ms: int = HOLD_MS) -> DataFrame:
    """A stream of lines (host, program, timestamp, seq, message) with fragments joined to heads across batches.

    Null hosts and programs are empty; lines without a time are never held; a null message is empty.
    ``most_keys`` bounds the host-program pairs of a shard. Needs the RocksDB state store.
    """
    text = F.coalesce("message", F.lit(""))
    df = rows.select(F.coalesce("host", F.lit("")).alias("host"), F.coalesce("program", F.lit("")).alias("program"), F.unix_millis("timestamp").alias("millis"), F.col("seq").cast("long").alias("seq"), text.alias("message"), is_fragment(text).alias("fragment"))
    sharded = df.withColumn("shard", F.pmod(F.xxhash64("host", "program"), F.lit(shards)).cast("int"))
    return sharded.groupBy("shard").transformWithStateInPandas(Joiner(most_keys, hold_ms), OUT, "Append", "ProcessingTime")
