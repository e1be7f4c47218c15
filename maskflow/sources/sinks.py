"""Audit sinks: lines, partitioned objects, fan-out of a micro-batch, a ledger for repeated ones, a selector by name."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.audit import gated, trace_events


def lines(records: DataFrame, path: str, record: str = "record") -> None:
    gated(records, record)[0].select(record).write.mode("append").text(path)


def objects(records: DataFrame, path: str, record: str = "record", files: int = 16) -> None:
    """Compressed lines by team and day. Records of a team's day are dealt to at most ``files`` files by a hash of the
    record, so no large team is one task, and no task writes a file for each team and day that it meets."""
    good = gated(records, record)[0].withColumn("dt", F.date_format("timestamp", "yyyy-MM-dd"))
    dealt = good.select("team_id", "dt", F.col(record).alias("value")).repartition("team_id", "dt", F.pmod(F.xxhash64(record), F.lit(files)))
    dealt.write.mode("append").partitionBy("team_id", "dt").option("compression", "gzip").text(path)


def fan_out(*sinks: Callable[[DataFrame], None]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that feeds each sink with the same batch; the batch number makes retries visible."""

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.withColumn("batch_no", F.lit(number))
        batch.persist()
        try:
            for sink in sinks:
                sink(batch)
        finally:
            batch.unpersist()

    return write


def memory(store: list, record: str = "record") -> Callable[[DataFrame], None]:
    """A sink for tests: the records of small batches as strings, in a list on the driver."""
    return lambda records: store.extend(r[record] for r in gated(records, record)[0].select(record).collect())


class IngestionError(RuntimeError):
    pass


def _posted(post: Callable[[dict], tuple[int, str]], batch: list) -> None:
    try:
        status, text = post({"batch": batch})
    except OSError as e:
        raise IngestionError(f"transport error: {e}") from e
    if status >= 400:
        raise IngestionError(f"ingestion {status}: {text[:300]}")


def _events(records: DataFrame, record: str) -> DataFrame:
    return trace_events(gated(records, record)[0]).select(F.to_json(F.struct("*")).alias("value"))


def http(post: Callable[[dict], tuple[int, str]], size: int = 100, record: str = "record") -> Callable[[DataFrame], None]:
    """A sink that posts envelopes {"batch": [events]} of at most ``size`` events. ``post`` (envelope -> status and
    text) is the caller's client, which workers import. A status of 400 or more, or an error of the client, fails the
    task and so the micro-batch; ids of events derive from the request's, so a second attempt posts the same ones."""

    def send(rows) -> None:
        batch: list = []
        for r in rows:
            batch.append(json.loads(r.value))
            if len(batch) == size:
                _posted(post, batch)
                batch = []
        if batch:
            _posted(post, batch)

    return lambda records: _events(records, record).foreachPartition(send)


class Ledger:
    """Which envelopes of which micro-batch have been taken, as files in a folder that all executors share: one per
    envelope, with its digest, and one per whole batch. A file is written aside and then renamed, so it is there
    whole or not at all."""

    def __init__(self, uri: str):
        self.uri = uri.rstrip("/") if "://" in uri else "file://" + uri.rstrip("/")

    def _at(self, name: str):
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(self.uri)
        return store, f"{root}/{name}"

    def read(self, name: str) -> str | None:
        store, path = self._at(name)
        if not store.get_file_info(path).is_file:
            return None
        with store.open_input_stream(path) as f:
            return f.read().decode()

    def write(self, name: str, what: str) -> None:
        store, path = self._at(name)
        store.create_dir(path.rpartition("/")[0], recursive=True)
        aside = f"{path}.{uuid.uuid4().hex}"
        with store.open_output_stream(aside) as f:
            f.write(what.encode())
        store.move(aside, path)

    def drop(self, name: str) -> None:
        from pyarrow import fs

        store, path = self._at(name)
        if store.get_file_info(path).type == fs.FileType.Directory:
            store.delete_dir(path)


def http_once(post: Callable[[dict], tuple[int, str]], ledger: str, size: int = 100, parts: int = 16, record: str = "record") -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that posts each event of a stream once, though micro-batches and tasks are repeated.

    A micro-batch is replayed with the same rows but not in the same tasks. So events are dealt to ``parts`` parts by
    their own hash and sorted there, which makes the same envelopes each time, whoever posts them. An envelope is
    entered in the ``ledger`` folder when the receiver has taken it, and one that is entered is not posted again; a
    batch that is done is skipped whole, and its entries are then dropped. A replay with other rows is an error.
    Between the receiver's answer and the entry a task can still be lost: that one envelope is posted again, with the
    same event ids, and is marked with "retry": true, so that the receiver can tell."""
    book = Ledger(ledger)

    def write(batch: DataFrame, number: int) -> None:
        done = book.read("done")
        if done is not None and int(done) >= number:
            return

        def send(rows) -> None:
            part, k, held = TaskContext.get().partitionId(), 0, []

            def envelope():
                name = f"{number:012d}/{part:05d}-{k:06d}"
                digest, entered = hashlib.sha256("\n".join(held).encode()).hexdigest(), book.read(name)
                if entered not in (None, digest):
                    raise IngestionError(f"batch {number} came again with other events")
                if entered is None:
                    begun = book.read(f"{name}.begun") is not None
                    book.write(f"{name}.begun", digest)
                    _posted(lambda body: post({**body, "retry": True} if begun else body), [json.loads(x) for x in held])
                    book.write(name, digest)

            for r in rows:
                held.append(r.value)
                if len(held) == size:
                    envelope()
                    k, held = k + 1, []
            if held:
                envelope()

        dealt = _events(batch, record).withColumn("_part", F.pmod(F.xxhash64("value"), F.lit(parts)).cast("int"))
        dealt.repartitionById(parts, F.col("_part")).sortWithinPartitions("value").foreachPartition(send)
        book.write("done", str(number))
        book.drop(f"{number:012d}")

    return write


KNOWN: dict[str, Callable] = {"lines": lines, "objects": objects, "http": http, "memory": memory}


def sink(name: str) -> Callable:
    if name not in KNOWN:
        raise ValueError(f"unknown sink {name!r}; known: {', '.join(sorted(KNOWN))}")
    return KNOWN[name]
