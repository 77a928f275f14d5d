"""Frames of event streams put together from chunks that cut them anywhere, and the progress of runs, as stateful streams.

Each connection keeps a state of its own: the bytes after the last blank line, the chunks that came too early, and whether it
is over. A state ends with its connection, or after a silence.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: A state without news for so long ends.
SILENCE_MS = 30 * 60 * 1000
EVENTS = "number bigint, kind string, payload string"


@dataclass
class Connection:
    """next: the number of the chunk that comes next; tail: the frame begun; number: of the next event; held: chunks that came early."""

    next: int = 0
    tail: bytes = b""
    number: int = 0
    over: bool = False
    held: dict[int, bytes] = field(default_factory=dict)

    def take(self, chunks: Iterable[tuple[int, bytes]]) -> Iterator[tuple[int, str, str]]:
        """Events (number, kind, payload) that chunks (seq, data) complete; chunks may come in any order and more than once. Nothing follows an error or the end."""
        for seq, data in chunks:
            if seq >= self.next and not self.over:
                self.held.setdefault(seq, data or b"")
        while self.next in self.held and not self.over:
            *frames, self.tail = (self.tail + self.held.pop(self.next)).split(b"\n\n")
            self.next += 1
            for frame in frames:
                found = event_of(frame)
                if found and not self.over:
                    yield self.number, *found
                    self.number += 1
                    self.over = found[0] in ("error", "done")
        if self.over:
            self.held, self.tail = {}, b""


def timeout(silence_ms: int | None) -> str:
    """Silences are told by the clock; Spark then looks after them without end, so a query over what is available now needs None."""
    return GroupStateTimeout.NoTimeout if silence_ms is None else GroupStateTimeout.ProcessingTimeTimeout


def _refuse(name: str):
    raise ValueError(name)


def event_of(frame: bytes) -> tuple[str, str] | None:
    """Kind and JSON of a frame; None if it is no data or no JSON object. Kinds are told as a client tells them: the first of these fields that says something."""
    line = frame.decode("utf-8", "replace").strip().lstrip("﻿")
    text = line[5:].strip() if line.startswith("data:") else ""
    try:
        value = json.loads(text, parse_constant=_refuse) if text else None
    except ValueError:
        return None
    if not isinstance(value, dict):
        return None
    says = lambda k: isinstance(value.get(k), dict | list) or bool(value.get(k))
    for kind in ("error", "done", "smart_resolve", "intent"):
        if says(kind):
            return kind, text
    if says("card_type") and says("card_data"):
        return "card", text
    return ("text" if says("text") else "other"), text


def events_of_chunks(chunks: DataFrame, silence_ms: int | None = SILENCE_MS) -> DataFrame:
    """STR-1, STR-3 as a stream: connection, number, kind and payload of the events in chunks (connection, seq from 0, data binary).

    Kinds that a client has no use for are `other`. Chunks of a connection may come in any order, twice, and cut frames
    anywhere; one that never comes holds back what follows it. A connection that falls silent before its end gives an event
    of kind `lost`. Null connections, numbers and repeated chunks are left out; null data is empty. The state of a connection
    is its unfinished frame and the chunks ahead of a gap; after the end it is one row until the silence is over. With a
    silence of None states stay, and nothing is lost.
    """
    kind = chunks.schema["connection"].dataType.simpleString()

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        c = Connection()
        if state.exists:
            c.next, c.tail, c.number, c.over, held = state.get
            c.tail, c.held = bytes(c.tail), {int(k): bytes.fromhex(v) for k, v in json.loads(held).items()}
        if state.hasTimedOut:
            state.remove()
            if not c.over:
                yield pd.DataFrame({"connection": [key[0]], "number": [c.number], "kind": ["lost"], "payload": [None]})
            return
        for b in batches:
            found = list(c.take((int(s), None if d is None else bytes(d)) for s, d in zip(b["seq"], b["data"], strict=True)))
            if found:
                yield pd.DataFrame(found, columns=["number", "kind", "payload"]).assign(connection=key[0])[["connection", "number", "kind", "payload"]]
        state.update((c.next, c.tail, c.number, c.over, json.dumps({str(k): v.hex() for k, v in c.held.items()})))
        if silence_ms is not None:
            state.setTimeoutDuration(silence_ms)

    rows = chunks.where("connection is not null and seq is not null").select("connection", "seq", "data")
    return rows.groupBy("connection").applyInPandasWithState(run, f"connection {kind}, {EVENTS}", "next bigint, tail binary, number bigint, over boolean, held string", "append", timeout(silence_ms))


def run_progress(reports: DataFrame, silence_ms: int | None = SILENCE_MS) -> DataFrame:
    """STR-4 as a stream: repo_id, status, percent and finished whenever these go forward in reports (repo_id, status, percent).

    A run goes on from its greatest status and percent so far; statuses of 2 and 3 end it, and with it its state, so that the
    next report begins another run. A report that says nothing new gives no row.
    """
    kind = reports.schema["repo_id"].dataType.simpleString()

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = tuple(state.get) if state.exists else (-1, -1)
        out, over = [], False
        for b in batches:
            for now in sorted(zip(b["status"].astype(int), b["percent"].astype(int), strict=True)):
                if now > last and not over:
                    over = now[0] >= 2
                    out.append((key[0], *now, over))
                    last = now
        if over:
            state.remove() if state.exists else None
        else:
            state.update(last)
            if silence_ms is not None:
                state.setTimeoutDuration(silence_ms)
        yield pd.DataFrame(out, columns=["repo_id", "status", "percent", "finished"])

    rows = reports.where("repo_id is not null and status is not null").selectExpr("repo_id", "cast(status as int) status", "cast(coalesce(percent, 0) as int) percent")
    return rows.groupBy("repo_id").applyInPandasWithState(run, f"repo_id {kind}, status int, percent int, finished boolean", "status int, percent int", "append", timeout(silence_ms))
