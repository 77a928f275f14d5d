"""Frames and progress as stateful streams."""

import json
import random

import pytest

from codeloom.streaming.frames import Connection, event_of, events_of_chunks, run_progress

EVENTS = [{"intent": "bug"}, {"smart_resolve": {"symbols": []}}, {"card_type": "impact", "card_data": {"n": 1}}, {"text": "é漢😀 a\\n\\nb"}, {"text": ""}, {"x": 1}, {"text": "data: {}"}]
TEXT = "".join(f"data: {json.dumps(e, ensure_ascii=False)}\n\n" for e in EVENTS) + ": comment\n\ndata:\n\ndata: {broken\n\ndata: [1]\n\ndata: NaN\n\n" + '  data:{"done": true}  \n\ndata: {"text": "late"}\n\n'
KINDS = ["intent", "smart_resolve", "card", "text", "other", "other", "text", "done"]


def test_kinds():
    assert event_of(b'data: {"error": "x", "done": true}') == ("error", '{"error": "x", "done": true}')
    assert event_of(b'data: {"card_type": "x"}')[0] == "other" and event_of(b'data: {"card_type": "x", "card_data": []}')[0] == "card"
    assert event_of(b'data: {"intent": 0, "text": "y"}')[0] == "text" and event_of("﻿data: {}".encode())[0] == "other"
    assert event_of(b"event: x") is None and event_of(b"data: null") is None and event_of(b"data: {\xff") is None


def test_frames_cut_at_every_byte_give_the_same_events():
    data = TEXT.encode()
    whole = list(Connection().take([(0, data)]))
    assert [k for _, k, _ in whole] == KINDS and [n for n, _, _ in whole] == list(range(8))
    for cut in range(len(data) + 1):
        c = Connection()
        assert list(c.take([(0, data[:cut])])) + list(c.take([(1, data[cut:])])) == whole
    c = Connection()
    assert [e for i in range(len(data)) for e in c.take([(i, data[i : i + 1])])] == whole and c.over and not c.held


@pytest.mark.parametrize("seed", range(20))
def test_chunks_in_any_order_and_more_than_once(seed):
    rng, data = random.Random(seed), TEXT.encode()
    cuts = sorted(rng.sample(range(len(data)), 12))
    chunks = [(i, data[x:y]) for i, (x, y) in enumerate(zip([0, *cuts], [*cuts, len(data)], strict=True))]
    sent = chunks + rng.sample(chunks, 5)
    rng.shuffle(sent)
    c = Connection()
    assert [e for one in sent for e in c.take([one])] == list(Connection().take([(0, data)]))


def run_to_end(spark, stream, source, path):
    query = stream(source, silence_ms=None).writeStream.format("parquet").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start(f"{path}/out")
    try:
        assert query.awaitTermination(120)
    finally:
        query.stop()


def test_a_restart_loses_and_repeats_nothing(spark, tmp_path):
    schema, path = "connection string, seq bigint, data binary", f"file://{tmp_path}"
    rng, texts = random.Random(3), {}
    sent = []
    for k in range(6):
        texts[f"c{k}"] = data = TEXT.encode() if k % 2 else TEXT.split('  data:{"done"')[0].encode()
        cuts = sorted(rng.sample(range(len(data)), 9))
        sent += [(f"c{k}", i, data[x:y]) for i, (x, y) in enumerate(zip([0, *cuts], [*cuts, len(data)], strict=True))]
    rng.shuffle(sent)
    sent += [(None, 0, b"data: {}\n\n"), ("c0", None, b"x"), ("empty", 0, None)] + sent[:7]
    half = len(sent) // 2
    for part in (sent[:half], sent[half:]):
        spark.createDataFrame(part, schema).coalesce(2).write.mode("append").parquet(f"{path}/in")
        source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
        run_to_end(spark, events_of_chunks, source, path)
    got = sorted(tuple(r) for r in spark.read.parquet(f"{path}/out").collect())
    assert got == sorted((c, *e) for c, data in texts.items() for e in Connection().take([(0, data)]))


def test_a_silent_connection_is_lost(spark, tmp_path):
    schema, path = "connection string, seq bigint, data binary", f"file://{tmp_path}"
    spark.createDataFrame([("a", 0, b'data: {"text": "x"}\n\ndata: {"do'), ("b", 0, b'data: {"done": true}\n\n')], schema).coalesce(1).write.parquet(f"{path}/in")
    stream = events_of_chunks(spark.readStream.schema(schema).parquet(f"{path}/in"), silence_ms=500)
    query = stream.writeStream.format("memory").queryName("silent").trigger(processingTime="1 second").start()
    try:
        for _ in range(60):
            if spark.sql("SELECT * FROM silent WHERE kind = 'lost'").count():
                break
            query.awaitTermination(1)
    finally:
        query.stop()
    assert sorted((r.connection, r.number, r.kind) for r in spark.sql("SELECT * FROM silent").collect()) == [("a", 0, "text"), ("a", 1, "lost"), ("b", 0, "done")]


def test_runs_go_forward_and_end(spark, tmp_path):
    schema, path = "repo_id bigint, status int, percent int", f"file://{tmp_path}"
    for part in ([(1, 0, 0), (1, 1, 10), (2, 1, None), (None, 1, 1)], [(1, 1, 5), (1, 1, 60), (2, 3, 0), (3, None, 1)], [(1, 2, 100), (2, 1, 20)]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{path}/in")
        run_to_end(spark, run_progress, spark.readStream.schema(schema).parquet(f"{path}/in"), path)
    got = sorted(tuple(r) for r in spark.read.parquet(f"{path}/out").collect())
    assert got == [(1, 0, 0, False), (1, 1, 10, False), (1, 1, 60, False), (1, 2, 100, True), (2, 1, 0, False), (2, 1, 20, False), (2, 3, 0, True)]
