"""Events reversed in a stream, with state over micro-batches and restarts, give what the batch form gives."""

import json
import random
import time

import pytest
from pyspark.sql import functions as F

from maskflow.operators import mask
from maskflow.streaming import reverse

PAIRS = [("alice", "[NAME_001]"), ("Zoë \"Z\"", "[NAME_0011]"), ("bob@x.org", "[EMAIL_001]")]
CHUNK = "stream_id string, seq long, payload binary, is_end boolean"


@pytest.fixture()
def rocksdb(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.set(name, old)


def data(body, head=b""):
    return head + b"data: " + json.dumps(body, ensure_ascii=False).encode() + b"\n\n"


def stream(rng):
    """The bytes of a stream of either format, with several open blocks or calls, other events and odd ones."""
    texts = ["Hi [NAME_0", "01]! é", "[NAME_0011]", " [EMA", "IL_001] and [NAME_", "009] ", "x" * 30, "[[NAME_001]"]
    pick = lambda: rng.choice(texts)
    out = [b": ping\n\n", b"event: odd\r\ndata: {\"x\": 1}\r\n\r\n"]
    if rng.random() < 0.5:
        for _ in range(rng.randrange(3, 12)):
            i = rng.randrange(3)
            delta = {"type": "text_delta", "text": pick()} if i < 2 else {"type": "input_json_delta", "partial_json": pick()}
            out.append(data({"type": "content_block_delta", "index": i, "delta": delta}, b"event: content_block_delta\n"))
            if rng.random() < 0.2:
                out.append(data({"type": "content_block_stop", "index": i}))
        out.append(data({"type": "message_stop"}) if rng.random() < 0.7 else b"data: {\"type\": \"content_block_delta\", \"index\": [1], \"delta\": 3}\n\n")
    else:
        for _ in range(rng.randrange(3, 12)):
            delta = rng.choice([{"content": pick()}, {"tool_calls": [{"index": rng.randrange(2), "function": {"arguments": pick()}}, 5]}, {"function_call": {"arguments": pick()}}, {"role": "x"}])
            out.append(data({"choices": [{"index": 0, "delta": delta}]}))
        out.append(rng.choice([b"data: [DONE]\n\n", data({"choices": [{"delta": {}, "finish_reason": "stop"}]}), b"data: {cut"]))
    return b"".join(out)


def cut(rng, whole):
    at = sorted(rng.sample(range(1, len(whole)), min(len(whole) - 1, rng.randrange(1, 12))))
    return [whole[a:z] for a, z in zip([0, *at], [*at, len(whole)])]


def reversed_whole(whole, pairs=PAIRS):
    r = reverse.EventReverser(pairs)
    return r.feed(whole) + r.flush()


def joined(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r.stream_id, r.seq)):
        out[r.stream_id] = out.get(r.stream_id, b"") + bytes(r.payload)
    return out


def streams(n, seed):
    rng = random.Random(seed)
    whole = {f"s{i}": stream(rng) for i in range(n)}
    return rng, whole, {k: cut(rng, w) for k, w in whole.items()}


def maps_of(spark, names):
    return spark.createDataFrame([(k, json.dumps(PAIRS)) for k in names], "stream_id string, pairs string")


def test_batches(spark):
    _, whole, parts = streams(30, 1)
    rows = [(k, i, p) for k, ps in parts.items() for i, p in enumerate(ps)] + [("plain", 0, b"data: {\"choices\": [ {} ]}"), ("plain", 1, None), ("none", 0, b"x")]
    pairs = F.when(F.col("stream_id").startswith("s"), F.array(*[mask.pair(F.lit(o), F.lit(p)) for o, p in PAIRS]).cast(mask.PAIRS)).when(F.col("stream_id") == "none", F.array().cast(mask.PAIRS))
    df = spark.createDataFrame(rows, "stream_id string, seq long, payload binary").withColumn("pairs", pairs).repartition(5)
    got = joined(reverse.unmask_events(df).collect())
    assert got == {**{k: reversed_whole(w) for k, w in whole.items()}, "plain": b"data: {\"choices\": [ {} ]}", "none": b"x"}
    assert reverse.unmask_events(df.where("false")).count() == 0


def run_once(spark, maps, at):
    chunks = spark.readStream.schema(CHUNK).option("maxFilesPerTrigger", 1).parquet(f"{at}/in")
    q = reverse.unmask_event_stream(chunks, maps).writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/ck").trigger(availableNow=True).start()
    assert q.awaitTermination(180)


def test_stream_over_batches_and_a_restart(spark, tmp_path, rocksdb):
    rng, whole, parts = streams(25, 2)
    rows = [(k, i, p, i == len(ps) - 1) for k, ps in parts.items() for i, p in enumerate(ps)]
    rows += [("plain", 0, whole["s0"][:50], False), ("plain", 1, whole["s0"][50:], True)]
    files = [[] for _ in range(4)]
    for r in rows:
        files[rng.randrange(4)].append(r)  # chunks come out of order, over four batches
    files[3] += [r for r in rng.sample(files[0], 5) if not any(x[0] == r[0] and x[3] for x in rows if x in files[0] + files[1] + files[2])]
    maps = maps_of(spark, whole)
    for first in (0, 2):  # the second query goes on from the first one's checkpoint
        for part in files[first : first + 2]:
            spark.createDataFrame(part, CHUNK).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
            time.sleep(0.05)
        run_once(spark, maps, tmp_path)
    got = joined(spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == {**{k: reversed_whole(w) for k, w in whole.items()}, "plain": whole["s0"]}


def test_idle_streams_are_flushed_block_by_block(spark, tmp_path, rocksdb):
    delta = lambda i, t: data({"type": "content_block_delta", "index": i, "delta": {"type": "text_delta", "text": t}})
    start = delta(1, "one [NAME_0") + delta(0, "two [EMAIL_00")
    rows = [("a", 0, start[:40], False), ("a", 1, start[40:], False), ("a", 3, delta(0, "1]"), False), ("b", 0, b"data: [DONE]\n\n", True), ("b", 0, b"again", False)]
    spark.createDataFrame(rows, CHUNK).coalesce(1).write.parquet(f"{tmp_path}/in")
    want = {"a": reversed_whole(start + delta(0, "1]")), "b": b"data: [DONE]\n\n"}
    chunks = spark.readStream.schema(CHUNK).parquet(f"{tmp_path}/in")
    q = reverse.unmask_event_stream(chunks, maps_of(spark, ["a", "b"]), idle_ms=500).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ck").trigger(processingTime="1 second").start()
    got, deadline = {}, time.time() + 90
    while got != want and time.time() < deadline:
        time.sleep(1)
        try:
            got = joined(spark.read.schema("stream_id string, seq long, payload binary").parquet(f"{tmp_path}/out").collect())
        except Exception:  # the sink's folder is made by the first batch
            continue
    q.stop()
    assert got == want


def test_watermark_dedup(spark, tmp_path):
    """A request that comes twice within the watermark is one record, in other batches too; state goes with it."""
    at = lambda s: f"2024-01-01 00:{s // 60:02d}:{s % 60:02d}"
    for part in ([("r1", at(0)), ("r2", at(5)), ("r1", at(6))], [("r1", at(30)), ("r3", at(40))], [("r2", at(100)), ("r4", at(3000))]):
        spark.createDataFrame(part, "request_id string, t string").select("request_id", F.to_timestamp("t").alias("timestamp")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        time.sleep(0.05)
    s = spark.readStream.schema("request_id string, timestamp timestamp").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = reverse.watermark_dedup(s).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    assert sorted(r.request_id for r in spark.read.parquet(f"{tmp_path}/out").collect()) == ["r1", "r2", "r3", "r4"]
