"""Placeholders turned back into originals in streams of chunks."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


class Reverser:
    """Text in, text out; what could be the start of a placeholder is held back until it is decided or flushed."""

    def __init__(self, pairs: Iterable[tuple[str, str]], held: str = ""):
        self.pairs = sorted(((p, o) for o, p in pairs if p), key=lambda x: (-len(x[0]), x[0]))
        self.keep = max((len(p) for p, _ in self.pairs), default=1) - 1
        self.held = held
        self.closed = False

    def feed(self, text: str) -> str:
        if self.closed:
            raise RuntimeError("fed after flush")
        self.held += text
        for placeholder, original in self.pairs:
            self.held = self.held.replace(placeholder, original)
        cut = max(0, len(self.held) - self.keep)
        out, self.held = self.held[:cut], self.held[cut:]
        return out

    def flush(self) -> str:
        self.closed = True
        out, self.held = self.held, ""
        return out


class ReverseProcessor(StatefulProcessor):
    """State per stream: held text, next chunk number, and chunks that came too early. It goes when the stream's end
    was put out or, with ``idle_ms``, when no chunk has come for so long: what was held back is then put out as the
    last chunk, chunks after a gap included."""

    def __init__(self, idle_ms: int | None = None):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("stream", "held string, next long, early string")

    def _rows(self, rows: list) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["stream_id", "seq", "text"])

    def _settimer(self, now: int | None) -> None:
        if self.idle_ms is not None:
            for due in list(self.handle.listTimers()):
                self.handle.deleteTimer(due[0] if isinstance(due, tuple) else due)
            if now is not None:
                self.handle.registerTimer(now + self.idle_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held, nxt, early = self.state.get() if self.state.exists() else ("", 0, "[]")
        waiting = {int(r[0]): r[1:] for r in json.loads(early)}
        for pdf in rows:
            for r in pdf.itertuples(index=False):
                if int(r.seq) >= nxt:
                    waiting[int(r.seq)] = [r.payload or "", bool(r.is_end), r.pairs or "[]"]
        out, ended = [], False
        while nxt in waiting and not ended:
            payload, ended, pairs = waiting.pop(nxt)
            rev = Reverser([tuple(p) for p in json.loads(pairs)], held)
            text = rev.feed(payload) + (rev.flush() if ended else "")
            held = rev.held
            out.append((key[0], nxt, text))
            nxt += 1
        if ended:
            self.state.clear()
            self._settimer(None)
        else:
            self.state.update((held, nxt, json.dumps([[k, *v] for k, v in waiting.items()])))
            self._settimer(timerValues.getCurrentProcessingTimeInMs() if self.idle_ms is not None else None)
        if out:
            yield self._rows(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.state.exists():
            return
        held, nxt, early = self.state.get()
        self.state.clear()
        text = ""
        for _, payload, _, pairs in sorted(json.loads(early)):
            rev = Reverser([tuple(p) for p in json.loads(pairs)], held)
            text, held = text + rev.feed(payload), rev.held
        if text + held:
            yield self._rows([(key[0], nxt, text + held)])

    def close(self) -> None:
        pass


def unmask_stream(chunks: DataFrame, mappings: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """chunks (stream_id, seq from 0, payload, is_end) and mappings (stream_id, pairs: JSON [[original, placeholder],
    ..]) -> stream_id, seq, text. Chunks may come out of order; a stream without a mapping passes through. Without
    ``idle_ms`` the state of a stream that is cut off stays; with it such a stream ends once it was idle so long."""
    joined = chunks.join(mappings, "stream_id", "left").select("stream_id", "seq", "payload", "is_end", "pairs")
    return joined.groupBy("stream_id").transformWithStateInPandas(ReverseProcessor(idle_ms), "stream_id string, seq long, text string", "append", "none" if idle_ms is None else "processingTime")


class ObjectReverser:
    """Chunks that are parsed objects: the first choice's content or a bare delta's text, tool arguments per call, and
    the arguments of a function call. A chunk of which all text is held back is left out unless it carries
    arguments; ``flush`` gives what is still held as chunks of its own."""

    def __init__(self, pairs: Iterable[tuple[str, str]]):
        self.pairs = list(pairs)
        self.of: dict = {}

    def _fed(self, key, text: str) -> str:
        if key not in self.of:
            self.of[key] = Reverser(self.pairs if key == "text" else [(json.dumps(o, ensure_ascii=False)[1:-1], p) for o, p in self.pairs])
        return self.of[key].feed(text)

    @staticmethod
    def _number(index) -> int | None:
        try:
            return int(index)
        except (TypeError, ValueError):
            return None

    def _call(self, call):
        f = call.get("function") if isinstance(call, dict) else None
        index = self._number(call.get("index", 0)) if isinstance(f, dict) else None
        if index is None or not isinstance(f.get("arguments"), str):
            return call, False
        return {**call, "function": {**f, "arguments": self._fed(("call", index), f["arguments"])}}, True

    def feed(self, chunk):
        """The chunk to send on, or None if it is held back whole."""
        if not isinstance(chunk, dict):
            return chunk
        choices = chunk.get("choices")
        choice = choices[0] if isinstance(choices, list) and choices and isinstance(choices[0], dict) else None
        delta = choice.get("delta") if choice is not None else chunk.get("delta")
        if not isinstance(delta, dict):
            return chunk
        delta, carries, field = dict(delta), False, "text" if choice is None else "content"
        if choice is not None:
            if isinstance(delta.get("tool_calls"), list):
                calls = [self._call(c) for c in delta["tool_calls"]]
                delta["tool_calls"], carries = [c for c, _ in calls], any(x for _, x in calls)
            f = delta.get("function_call")
            if isinstance(f, dict) and isinstance(f.get("arguments"), str):
                delta["function_call"], carries = {**f, "arguments": self._fed("function", f["arguments"])}, True
        if isinstance(delta.get(field), str):
            delta[field] = self._fed("text", delta[field])
            if not delta[field] and not carries and not (choice or {}).get("finish_reason"):
                return None
        return {**chunk, "delta": delta} if choice is None else {**chunk, "choices": [{**choice, "delta": delta}, *choices[1:]]}

    def flush(self) -> list[dict]:
        out = []
        for key, reverser in sorted(self.of.items(), key=lambda x: (x[0] != "text", x[0] == "function", str(x[0]))):
            if text := reverser.flush():
                delta = {"content": text} if key == "text" else {"function_call": {"arguments": text}} if key == "function" else {"tool_calls": [{"index": key[1], "function": {"arguments": text}}]}
                out.append({"choices": [{"delta": delta}]})
        self.of = {}
        return out


_BORDER = re.compile(rb"\r\n\r\n|\n\n|\r\r")


class EventReverser:
    """Server-sent events of both wire formats: text, tool input and tool arguments are reversed per block or call;
    all other events pass through byte by byte."""

    def __init__(self, pairs: Iterable[tuple[str, str]]):
        self.pairs = list(pairs)
        self.buffer = b""
        self.blocks: dict = {}

    def _of(self, key, held: str = "") -> Reverser:
        if key not in self.blocks:
            pairs = self.pairs if key[0] in ("text", "content") else [(json.dumps(o, ensure_ascii=False)[1:-1], p) for o, p in self.pairs]
            self.blocks[key] = Reverser(pairs, held)
        return self.blocks[key]

    def held(self) -> list[tuple[str, str, str]]:
        """(kind, index as JSON, held text) of the open blocks, in the order in which they began."""
        return [(kind, json.dumps(index), r.held) for (kind, index), r in self.blocks.items()]

    def resume(self, buffer: bytes, blocks: Iterable[tuple[str, str, str]]) -> None:
        self.buffer = buffer
        for kind, index, held in blocks:
            self._of((kind, json.loads(index)), held)

    def feed(self, data: bytes) -> bytes:
        self.buffer += data
        out = []
        while m := _BORDER.search(self.buffer):
            event, self.buffer = self.buffer[: m.start()], self.buffer[m.end() :]
            out.append(self._event(event, m[0]))
        return b"".join(out)

    def flush(self) -> bytes:
        rest, self.buffer = self.buffer, b""
        return (self._event(rest, b"") if rest else b"") + self._tails()

    def _tails(self) -> bytes:
        out = []
        for key in list(self.blocks):
            text = self.blocks.pop(key).flush()
            if text:
                out.append(self._tail(key, text))
        return b"".join(out)

    def _tail(self, key, text: str) -> bytes:
        kind, index = key
        if kind in ("text", "json"):
            delta = {"type": "text_delta", "text": text} if kind == "text" else {"type": "input_json_delta", "partial_json": text}
            body = {"type": "content_block_delta", "index": index, "delta": delta}
            return b"event: content_block_delta\n" + self._data(body)
        delta = {"content": text} if kind == "content" else {"tool_calls": [{"index": index, "function": {"arguments": text}}]} if kind == "call" else {"function_call": {"arguments": text}}
        return self._data({"choices": [{"index": 0, "delta": delta}]})

    @staticmethod
    def _data(body) -> bytes:
        return b"data: " + json.dumps(body, ensure_ascii=False).encode() + b"\n\n"

    def _event(self, event: bytes, border: bytes) -> bytes:
        lines = event.split(b"\n")
        at = next((i for i, x in enumerate(lines) if x.startswith(b"data:")), None)
        raw = lines[at][5:].strip() if at is not None else b""
        if raw == b"[DONE]":
            return self._tails() + event + border
        try:
            body = json.loads(raw)
        except ValueError:
            return event + border
        before, touched, drop = b"", False, False
        if isinstance(body, dict) and body.get("type") == "content_block_delta":
            delta, index = body.get("delta"), body.get("index")
            for kind, field in (("text", "text"), ("json", "partial_json")):
                if isinstance(delta, dict) and isinstance(delta.get(field), str) and not isinstance(index, (list, dict)):
                    delta[field], touched = self._of((kind, index)).feed(delta[field]), True
        elif isinstance(body, dict) and body.get("type") in ("content_block_stop", "message_stop"):
            for key in [k for k in self.blocks if body["type"] == "message_stop" or k[1] == body.get("index")]:
                text = self.blocks.pop(key).flush()
                before += self._tail(key, text) if text else b""
        elif isinstance(body, dict) and isinstance(body.get("choices"), list) and body["choices"] and isinstance(body["choices"][0], dict):
            choice = body["choices"][0]
            delta = choice.get("delta") if isinstance(choice.get("delta"), dict) else {}
            if isinstance(delta.get("content"), str):
                delta["content"], touched = self._of(("content", 0)).feed(delta["content"]), True
                drop = not delta["content"] and set(delta) == {"content"} and not choice.get("finish_reason")
            for call in delta["tool_calls"] if isinstance(delta.get("tool_calls"), list) else []:
                f, index = (call.get("function"), call.get("index", 0)) if isinstance(call, dict) else (None, 0)
                if isinstance(f, dict) and isinstance(f.get("arguments"), str) and not isinstance(index, (list, dict)):
                    f["arguments"], touched = self._of(("call", index)).feed(f["arguments"]), True
            f = delta.get("function_call")
            if isinstance(f, dict) and isinstance(f.get("arguments"), str):
                f["arguments"], touched = self._of(("function", 0)).feed(f["arguments"]), True
            if choice.get("finish_reason"):
                before = self._tails()
        if drop:
            return before
        if touched:
            lines[at] = b"data: " + json.dumps(body, ensure_ascii=False).encode()
        return before + b"\n".join(lines) + border


class EventProcessor(StatefulProcessor):
    """Server-sent events of a stream, reversed as their bytes come, however micro-batches cut them.

    State of a stream: the bytes of an event that is not whole yet and the next chunk's number; in a map by block or
    call the text that is held back there; in a map by number the chunks that came too early. With ``idle_ms`` a timer
    flushes a stream that no chunk came for in so long: chunks after a gap, then every block's tail. The end of a
    stream clears its state; with ``idle_ms`` a mark stays for as long, so that a chunk that is delivered again after
    the end gives nothing."""

    def __init__(self, idle_ms: int | None = None):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.stream = handle.getValueState("stream", "tail binary, next long, ended boolean")
        self.early = handle.getMapState("early", "seq long", "payload binary, is_end boolean, pairs string")
        self.blocks = handle.getMapState("blocks", "kind string, at string", "place long, held string")

    def _open(self, pairs: str | None, tail: bytes) -> EventReverser:
        r = EventReverser([tuple(p) for p in json.loads(pairs or "[]")])
        own = sorted((v[0], *k, v[1]) for k, v in self.blocks.iterator())
        r.resume(tail, [x[1:] for x in own])
        return r

    def _close(self, r: EventReverser) -> None:
        now = {(kind, at): (place, held) for place, (kind, at, held) in enumerate(r.held())}
        for k in [tuple(k) for k in self.blocks.keys()]:
            if k not in now:
                self.blocks.removeKey(k)
        for k, v in now.items():
            self.blocks.updateValue(k, v)

    def _rearm(self, now: int) -> None:
        if self.idle_ms is not None:
            for due in list(self.handle.listTimers()):
                self.handle.deleteTimer(due[0] if isinstance(due, tuple) else due)
            self.handle.registerTimer(now + self.idle_ms)

    def _forget(self, mark: bool) -> None:
        self.early.clear()
        self.blocks.clear()
        self.stream.update((b"", 0, True)) if mark else self.stream.clear()

    def _put(self, key, rows: list) -> Iterator[pd.DataFrame]:
        if rows:
            yield pd.DataFrame([(key[0], *r) for r in rows], columns=["stream_id", "seq", "payload"])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        tail, nxt, ended = self.stream.get() if self.stream.exists() else (b"", 0, False)
        reverser, was, out = None, None, []
        for pdf in rows:
            waiting = {}
            for r in pdf.itertuples(index=False):
                if not ended and int(r.seq) >= nxt:  # of a chunk that is delivered twice the first counts
                    waiting.setdefault(int(r.seq), (bytes(r.payload or b""), bool(r.is_end), r.pairs))
            while not ended and (nxt in waiting or self.early.containsKey((nxt,))):
                if self.early.containsKey((nxt,)):
                    payload, ended, pairs = self.early.getValue((nxt,))
                    self.early.removeKey((nxt,))
                    waiting.pop(nxt, None)
                else:
                    payload, ended, pairs = waiting.pop(nxt)
                if reverser is None or pairs != was:
                    if reverser is not None:
                        tail = reverser.buffer
                        self._close(reverser)
                    reverser, was = self._open(pairs, bytes(tail)), pairs
                done = reverser.feed(bytes(payload)) if reverser.pairs else bytes(payload)
                out.append((nxt, done + reverser.flush() if ended else done))
                nxt += 1
            for seq, chunk in waiting.items():
                if not ended and not self.early.containsKey((seq,)):
                    self.early.updateValue((seq,), chunk)
        if ended:
            self._forget(mark=self.idle_ms is not None)
        else:
            if reverser is not None:
                tail = reverser.buffer
                self._close(reverser)
            self.stream.update((bytes(tail), nxt, False))
        self._rearm(timerValues.getCurrentProcessingTimeInMs() if self.idle_ms is not None else 0)
        yield from self._put(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.stream.exists():
            return
        tail, nxt, ended = self.stream.get()
        out = b""
        if not ended:
            rest = sorted((k[0], *v) for k, v in self.early.iterator())
            r = self._open(rest[0][3] if rest else None, bytes(tail))  # what is held has been searched already
            out = b"".join(r.feed(bytes(x[1])) if r.pairs else bytes(x[1]) for x in rest) + r.flush()
        self._forget(mark=False)
        yield from self._put(key, [(nxt, out)] if out else [])

    def close(self) -> None:
        pass


def unmask_event_stream(chunks: DataFrame, mappings: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """chunks (stream_id, seq from 0, payload binary, is_end) and mappings (stream_id, pairs: JSON [[original,
    placeholder], ..]) -> stream_id, seq, payload: the bytes to send on in place of each chunk. Joined in the order of
    seq they are what ``unmask_events`` gives for the whole stream, wherever chunks and micro-batches are cut and
    whatever the order they come in. A stream without a mapping passes through byte by byte. Needs the RocksDB state
    store."""
    joined = chunks.join(mappings, "stream_id", "left").select("stream_id", "seq", "payload", "is_end", "pairs")
    return joined.groupBy("stream_id").transformWithStateInPandas(EventProcessor(idle_ms), "stream_id string, seq long, payload binary", "append", "none" if idle_ms is None else "processingTime")


def _in_order(chunks: DataFrame, key: str, begin, feed, flush, kind: pa.DataType) -> DataFrame:
    """key, seq, payload from a fold over each stream's chunks in the order of seq. A stream is one task's, as each
    chunk depends on those before it; it is sorted by Spark, which spills, and run through batch by batch, so no
    stream has to fit into memory. ``feed`` and ``flush`` give what to send on (None: nothing) and a list of it."""
    kinds = dict(chunks.dtypes)
    d = chunks.select(key, "seq", "payload", "pairs").repartition(key).sortWithinPartitions(key, "seq")

    def run(batches):
        own, state, n, key_type = None, None, 0, pa.null()

        def batch(rows):
            cols = list(zip(*rows)) or [[]] * 3
            return pa.RecordBatch.from_arrays([pa.array(cols[0], key_type), pa.array(cols[1], pa.int64()), pa.array(cols[2], kind)], names=[key, "seq", "payload"])

        for b in batches:
            key_type, rows = b.schema.field(0).type, []
            for k, payload, pairs in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist()):
                if state is None or k != own:
                    for x in flush(state) if state is not None else []:
                        rows.append((own, n, x))
                        n += 1
                    own, n, state = k, 0, begin([(p["original"], p["placeholder"]) for p in pairs or []])
                x = feed(state, payload)
                if x is not None:
                    rows.append((k, n, x))
                    n += 1
            yield batch(rows)
        if state is not None:
            yield batch([(own, n + i, x) for i, x in enumerate(flush(state))])

    return d.mapInArrow(run, f"`{key}` {kinds[key]}, seq long, payload {'binary' if kind == pa.binary() else 'string'}")


def unmask_objects(chunks: DataFrame, key: str = "stream_id") -> DataFrame:
    """Batch form: key, seq, payload string (a JSON chunk), pairs array<struct<original,placeholder>> -> key, seq
    (from 0, of what is sent on), payload. Chunks that are no JSON, or null, pass through as they are."""

    def feed(r: ObjectReverser, payload):
        try:
            chunk = r.feed(json.loads(payload))
        except (TypeError, ValueError):
            return payload if payload is not None else ""
        return json.dumps(chunk, ensure_ascii=False) if chunk is not None else None

    return _in_order(chunks, key, ObjectReverser, feed, lambda r: [json.dumps(x, ensure_ascii=False) for x in r.flush()], pa.string())


def unmask_events(chunks: DataFrame, key: str = "stream_id") -> DataFrame:
    """Batch form: key, seq, payload binary, pairs array<struct<original,placeholder>> -> key, seq (from 0), payload:
    a row for each chunk and one for what is left at the end. Their payloads, joined, are the reversed stream. Without
    pairs chunks pass through; a null payload is empty."""
    feed = lambda r, payload: r.feed(payload or b"") if r.pairs else payload or b""
    return _in_order(chunks, key, EventReverser, feed, lambda r: [x for x in [r.flush()] if x], pa.binary())


def watermark_dedup(records: DataFrame, ts: str = "timestamp", late: str = "10 minutes") -> DataFrame:
    """One audit record per request in a stream, with state bounded by the watermark."""
    return records.withWatermark(ts, late).dropDuplicatesWithinWatermark(["request_id"])
