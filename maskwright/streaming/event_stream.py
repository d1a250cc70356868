"""Restoring chat event streams: each text that is built up over many events is a stream of its own."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from maskwright.config import Engine, LimitExceeded, MaskingError, StreamClosed, StreamRestoreError
from maskwright.sources.groups import by_group
from maskwright.sources.json_body import JsonSyntaxError, Node, encoded, parse
from maskwright.streaming.stream import CHUNKS, StreamRestorer, known_of

SEGMENT = 16 << 10
MAX_ROUTES = 256
_KIB, _MIB = 1 << 10, 1 << 20
_EOL = re.compile(rb"\r\n|\n|\r")
_BOM = b"\xef\xbb\xbf"


class Segments:
    """Cuts output into segments of at most 16 KiB; an event goes with the segment that holds the last byte before it."""

    def __init__(self):
        self.done: list[tuple[bytes, list]] = []
        self.open, self.events = bytearray(), []

    def push(self, data: bytes, events: list | tuple = ()) -> None:
        self.open += data
        while len(self.open) > SEGMENT:
            self.done.append((bytes(self.open[:SEGMENT]), self.events))
            self.open, self.events = self.open[SEGMENT:], []
        self.events = [*self.events, *events]

    def finish(self) -> list[tuple[bytes, list]]:
        if self.open or self.events:
            self.done.append((bytes(self.open), self.events))
        return self.done


@dataclass
class Route:
    """One text of one choice, with the raw identity tokens that a frame made for it repeats."""

    target: str
    choice: str
    tokens: dict[str, str]
    ending: str
    restorer: dict = field(default_factory=dict)
    flushed: bool = False

    def frame(self) -> tuple[str, str]:
        """What stands before and after the text in a frame of its own."""
        named = lambda key, name: f'"{name}":{self.tokens[key]},' if key in self.tokens else ""
        if self.target in ("content", "refusal"):
            inner = (f'"{self.target}":"', '"')
        elif self.target == "function_call":
            inner = ('"function_call":{"arguments":"', '"}')
        else:
            of, last = ("function", "arguments") if self.target == "arguments" else ("custom", "input")
            inner = (f'"tool_calls":[{{{named("tool", "index")}{named("id", "id")}"{of}":{{{named(of, "name")}"{last}":"', '"}}]')
        return f'data: {{"choices":[{{{named("choice", "index")}"delta":{{{inner[0]}', f"{inner[1]}}}}}]}}{self.ending}{self.ending}"


@dataclass
class _Line:
    raw: bytes
    ending: bytes
    name: bytes | None
    value: bytes


def _lines(event: bytes) -> list[_Line]:
    out, at = [], 0
    while at < len(event):
        m = _EOL.search(event, at)
        content, ending = (event[at : m.start()], m[0]) if m else (event[at:], b"")
        name, colon, value = content.partition(b":")
        if not name:
            name = None  # a blank line or a comment
        out.append(_Line(content + ending, ending, name, value[1:] if value[:1] == b" " else value))
        at += len(content) + len(ending)
    return out


def _token(node: Node, key: str, text: str) -> str | None:
    """The raw text of the first member of that name that is not null."""
    return next((v.raw(text) for v in node.named(key) if v.value != "null" or v.kind != "word"), None)


@dataclass
class _Target:
    name: str
    node: Node
    key: str
    tokens: dict[str, str]


def _targets(choice: Node, text: str, choice_token: str | None) -> Iterator[_Target]:
    """The strings of a choice's deltas that are restored, each with what tells its stream from others."""
    base = {"choice": choice_token} if choice_token is not None else {}
    for delta in choice.named("delta"):
        for name in ("content", "refusal"):
            for node in delta.named(name):
                yield _Target(name, node, "", base)
        for calls in delta.named("tool_calls"):
            for position, call in enumerate(calls.items()):
                if call.kind != "object":
                    continue
                first = lambda key: next((v for v in call.named(key) if v.kind == "object" and _token(v, "name", text) is not None), None)  # noqa: B023, E731
                function, custom = first("function"), first("custom")
                found = {"tool": _token(call, "index", text), "id": _token(call, "id", text), "function": function and _token(function, "name", text), "custom": custom and _token(custom, "name", text)}
                tokens = {**base, **{k: v for k, v in found.items() if v is not None}}
                key = next((f"{k}:{found[k]}" for k in found if found[k] is not None), f"at:{position}")
                for own in call.named("function"):
                    for node in own.named("arguments"):
                        yield _Target("arguments", node, key, tokens)
                for own in call.named("custom"):
                    for node in own.named("input"):
                        yield _Target("input", node, key, tokens)
        for own in delta.named("function_call"):
            for node in own.named("arguments"):
                yield _Target("function_call", node, "", base)


class EventStreamRestorer:
    """feed(chunk) and finish() give segments (bytes, events). The first error is repeated for good.

    All state is in `state()`, a JSON text: the unfinished event, the open texts and the budgets spent.
    """

    def __init__(self, mapping: dict[str, str], engine: Engine | None = None, state: str | None = None):
        self.mapping, self.engine = mapping, engine or Engine()
        own = json.loads(state) if state else {}
        self.buffer = bytes.fromhex(own.get("buffer", ""))
        self.partial = bytes.fromhex(own.get("partial", ""))
        self.routes = {k: Route(**r) for k, r in own.get("routes", {}).items()}
        self.live: dict[str, StreamRestorer] = {}
        self.raw, self.sent, self.restored, self.identity, self.opened = own.get("spent", [0] * 5)
        self.begun, self.ended, self.failed = own.get("begun", False), own.get("ended", False), own.get("failed")
        out = self.engine.max_output_bytes
        self.event_budget = max(out + 4 * _KIB, 64 * _KIB)
        self.emitted_budget = self.event_budget + 6 * out
        self.raw_budget = max(4 * out, 4 * _MIB)
        self.total_budget = self.raw_budget + 6 * out
        self.state_budget = max(self.engine.max_input_bytes, 4 * _MIB)

    def state(self) -> str:
        for key, live in self.live.items():
            self.routes[key].restorer = {"state": live.state()}
        spent = [self.raw, self.sent, self.restored, self.identity, self.opened]
        return json.dumps({"buffer": self.buffer.hex(), "partial": self.partial.hex(), "routes": {k: asdict(r) for k, r in self.routes.items()}, "spent": spent, "begun": self.begun, "ended": self.ended, "failed": self.failed})

    def _need(self, good: bool, why: str) -> None:
        if not good:
            self.failed = why
            raise StreamRestoreError(why)

    def _ready(self) -> None:
        if self.failed:
            raise StreamRestoreError(self.failed)

    def _restorer(self, key: str) -> StreamRestorer:
        if key not in self.live:
            self.live[key] = StreamRestorer(self.mapping, self.engine, self.routes[key].restorer.get("state"))
        return self.live[key]

    def feed(self, chunk: bytes) -> list[tuple[bytes, list]]:
        self._ready()
        if self.ended:
            raise StreamClosed("the stream has ended")
        self.raw += len(chunk)
        self._need(self.raw <= self.raw_budget, "bytes of the stream")
        # the bytes are held against UTF-8 as they come; a character may be split between chunks
        data = self.partial + chunk
        try:
            data.decode("utf-8")
            self.partial = b""
        except UnicodeDecodeError as e:
            self._need(e.reason == "unexpected end of data", "invalid UTF-8")
            self.partial = data[e.start :]
        self.buffer += chunk
        out, start, line = [], 0, 0
        for m in _EOL.finditer(self.buffer):
            if m[0] == b"\r" and m.end() == len(self.buffer):
                break  # its line feed may be yet to come
            if m.start() == line:
                out += self._event(self.buffer[start : m.end()])
                start = m.end()
            line = m.end()
        self.buffer = self.buffer[start:]
        self._need(len(self.buffer) <= self.event_budget, "an event's bytes")
        return out

    def finish(self) -> list[tuple[bytes, list]]:
        """The stream's end: an event without its blank line counts, then all open texts are given out."""
        self._ready()
        if self.ended:
            return []
        self._need(not self.partial, "the stream ends within a character")
        self.ended = True
        out = self._event(self.buffer) if self.buffer else []
        self.buffer = b""
        return out + self._flush_all()

    def _flush(self, key: str) -> tuple[str, list]:
        """What a text still withheld, in pieces."""
        route = self.routes[key]
        route.flushed = True
        try:
            text, _ = self._restorer(key).flush()
        except MaskingError as e:
            self._need(False, f"flush: {e}")
        self._count(text)
        return text, self._restorer(key).pieces

    def _count(self, text: str) -> None:
        self.restored += len(text.encode())
        self._need(self.restored <= self.engine.max_output_bytes, "restored bytes")

    def _framed(self, route: Route, pieces: list) -> list[tuple[bytes, list]]:
        before, after = route.frame()
        return [(before.encode(), []), *((encoded(t, True).encode(), e) for t, e in pieces), (after.encode(), [])]

    def _send(self, pushes: list[tuple[bytes, list]]) -> list[tuple[bytes, list]]:
        self.sent += sum(len(b) for b, _ in pushes)
        self._need(self.sent <= self.total_budget, "bytes sent")
        return _cut(pushes)

    def _flush_all(self) -> list[tuple[bytes, list]]:
        pushes = []
        for key, route in self.routes.items():
            if not route.flushed:
                text, pieces = self._flush(key)
                if text or any(e for _, e in pieces):
                    pushes += self._framed(route, pieces)
        return self._send(pushes)

    def _route(self, key: str, target: _Target, choice: str, ending: str) -> StreamRestorer:
        """The open text of that key; after a flush a new one begins under the same identity."""
        old = self.routes.get(key)
        if old is None or old.flushed:
            self.opened += 1
            self._need(self.opened <= MAX_ROUTES, "open texts")
            self.live.pop(key, None)
            if old is None:
                self.routes[key] = Route(target.name, choice, target.tokens, ending)
                self.identity += len(key.encode()) + sum(len(t.encode()) for t in target.tokens.values())
                self._need(self.identity <= self.state_budget, "bytes of state")
            else:
                old.flushed, old.restorer = False, {}
        return self._restorer(key)

    def _event(self, event: bytes) -> list[tuple[bytes, list]]:
        self._need(len(event) <= self.event_budget, "an event's bytes")
        out = []
        if not self.begun:
            self.begun = True
            if event.startswith(_BOM):
                event = event[len(_BOM) :]
                out += _cut([(_BOM, [])])
        lines = _lines(event)
        self._need(all(len(x.raw) <= self.event_budget for x in lines), "a line's bytes")
        data = [x for x in lines if x.name == b"data"]
        if not data:
            return out + _cut([(event, [])])
        joined = b"\n".join(x.value for x in data)
        self._need(len(joined) <= self.event_budget, "an event's data")
        if joined == b"[DONE]":
            return out + self._flush_all() + _cut([(event, [])])
        text = joined.decode("utf-8")
        try:
            root = parse(text)
        except (JsonSyntaxError, LimitExceeded) as e:
            self._need(False, f"an event's JSON: {e}")
        ending = next((x.ending for x in [data[0], *lines] if x.ending), b"\n")
        patches, frames, finished = self._restore(text, root, ending.decode())
        if not patches and not frames and not finished:
            return out + _cut([(event, [])])
        text = text.replace("\n", " ")  # several data lines become one, without moving any place
        body, at = [(b"data: ", [])], 0
        for start, end, pieces in sorted(patches, key=lambda p: p[0]):
            body.append((text[at:start].encode(), []))
            body += pieces
            at = end
        body.append((text[at:].encode() + ending, []))
        self._need(sum(len(b) for b, _ in body) - 6 - len(ending) <= self.event_budget, "an event's new data")
        pushes = list(frames)
        for line in lines:
            if line is data[0]:
                pushes += body
            elif line.name != b"data":
                pushes.append((line.raw, []))
        self._need(sum(len(b) for b, _ in pushes) <= self.emitted_budget, "an event's new bytes")
        return out + self._send(pushes)

    def _restore(self, text: str, root: Node, ending: str) -> tuple[list, list, set[str]]:
        """(patches (start, end, pushes), pushes of the frames that go before the event, keys of finished choices)."""
        seen: dict[str, int] = {}

        def apart(key: str) -> str:
            """Keys that one event holds several times are told apart by a number."""
            n = seen[key] = seen.get(key, -1) + 1
            return f"{key}#{n}" if n else key

        visits, finished = [], set()
        for choices in root.named("choices"):
            for position, choice in enumerate(choices.items()):
                if choice.kind != "object":
                    continue
                token = _token(choice, "index", text)
                choice_key = apart(f"at:{position}" if token is None else f"index:{token}")
                if _token(choice, "finish_reason", text) is not None:
                    finished.add(choice_key)
                for target in _targets(choice, text, token):
                    if target.node.kind != "string":
                        continue
                    key = apart(json.dumps([target.name, choice_key, target.key]))
                    restorer = self._route(key, target, choice_key, ending)
                    try:
                        new, events = restorer.write(target.node.value.encode())
                    except MaskingError as e:
                        self._need(False, f"write: {e}")
                    self._count(new)
                    visits.append((key, choice_key, target.node, new, events, restorer.pieces))
        patches, frames = [], []
        for key, choice_key, node, new, events, pieces in visits:
            inside = (node.start + 1, node.end - 1)
            if choice_key in finished:
                # all of the text goes out in a frame before; the event itself keeps an empty one
                tail, more = ("", []) if self.routes[key].flushed else self._flush(key)
                if new or tail or events:
                    frames += self._framed(self.routes[key], pieces + more)
                    patches.append((*inside, []))
            elif new != node.value:
                patches.append((*inside, [(encoded(t, True).encode(), e) for t, e in pieces]))
            elif events:  # nothing resolved: the bytes stay as they were written
                patches.append((*inside, [(text[inside[0] : inside[1]].replace("\n", " ").encode(), events)]))
        for key, route in self.routes.items():
            if route.choice in finished and not route.flushed:
                tail, pieces = self._flush(key)
                if tail or any(e for _, e in pieces):
                    frames += self._framed(route, pieces)
        held = sum(self._restorer(k).withheld() for k, r in self.routes.items() if not r.flushed)
        self._need(self.identity + held <= self.state_budget, "bytes of state")
        return patches, frames, finished


def _cut(pushes: list[tuple[bytes, list]]) -> list[tuple[bytes, list]]:
    out = Segments()
    for data, events in pushes:
        out.push(data, events)
    return out.finish()


OUTPUT = "stream_id string, chunk_no long, segment_no int, bytes binary, events array<struct<entity:string,placeholder:string,restored:boolean>>, error string"
_COLUMNS = ["stream_id", "chunk_no", "segment_no", "bytes", "events", "error"]


def _rows(stream_id: str, chunks, restorer: EventStreamRestorer) -> list[tuple]:
    """Output rows for (chunk_no, chunk, is_eof) in order; an error gives a row of its own."""
    out = []
    for number, chunk, eof in chunks:
        try:
            segments = restorer.feed(bytes(chunk or b""))
            segments += restorer.finish() if eof else []
            out += [(stream_id, number, i, data, [{"entity": e, "placeholder": p, "restored": r} for e, p, r in events], None) for i, (data, events) in enumerate(segments)]
        except MaskingError as e:
            out.append((stream_id, number, 0, b"", [], type(e).__name__))
    return out


class EventStreamProcessor(StatefulProcessor):
    """As RestoreProcessor, for event streams: (stream_id, chunk_no from 0, chunk, is_eof, mapping)."""

    def __init__(self, engine: Engine | None = None, ttl_ms: int | None = None):
        self.engine, self.ttl_ms = engine or Engine(), ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getValueState("kept", "state string, next long, mapping string, early string", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state, turn, mapping, early = self.kept.get() if self.kept.exists() else ("", 0, "{}", "[]")
        known, held = json.loads(mapping), {n: (c, e) for n, c, e in json.loads(early)}
        for pdf in rows:
            for r in pdf.itertuples():
                known.update(dict(r.mapping) if r.mapping is not None else {})
                if r.chunk_no >= turn:
                    held[int(r.chunk_no)] = (bytes(r.chunk or b"").hex(), bool(r.is_eof))
        restorer = EventStreamRestorer(known, self.engine, state or None)
        ready = []
        while turn in held:
            chunk, eof = held.pop(turn)
            ready.append((turn, bytes.fromhex(chunk), eof))
            turn += 1
        out = _rows(key[0], ready, restorer)
        if sum(len(c) // 2 for c, _ in held.values()) > self.engine.max_input_bytes:
            out.append((key[0], turn, 0, b"", [], "LimitExceeded"))
            held = {}
        self.kept.update((restorer.state(), turn, json.dumps(known), json.dumps([[n, c, e] for n, (c, e) in held.items()])))
        yield pd.DataFrame(out, columns=_COLUMNS)

    def close(self) -> None: ...


def restore_event_stream(chunks: DataFrame, engine: Engine | None = None, ttl_ms: int | None = None) -> DataFrame:
    """Structured Streaming: chunks of event streams to restored segments; ttl_ms as in restore_stream()."""
    return chunks.groupBy("stream_id").transformWithStateInPandas(EventStreamProcessor(engine, ttl_ms), outputStructType=OUTPUT, outputMode="append", timeMode="processingTime" if ttl_ms else "none")


def restore_event_chunks(chunks: DataFrame, engine: Engine | None = None) -> DataFrame:
    """The same for a batch table; the raw budget of a stream bounds what one task holds of it."""
    engine = engine or Engine()

    def run(stream_id: str, rows: list[tuple]) -> list[tuple]:
        return _rows(stream_id, [r[1:4] for r in rows], EventStreamRestorer(known_of(rows), engine))

    return by_group(chunks.select(*CHUNKS), "stream_id", "chunk_no", run, OUTPUT)
