"""Restoring text that comes in chunks: what may still become a placeholder is withheld until it is decided."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from maskwright.config import MAX_REPORT_BYTES, MAX_RESTORE_EVENTS, Engine, InvalidUTF8, LimitExceeded, MaskingError, StreamClosed
from maskwright.sources.groups import by_group

TOKEN = re.compile("[\\[【]?([A-Z][A-Z0-9]*)_([0-9]+)[\\]】]?")
#: An end of text that further text could make a token.
OPEN = re.compile("(?:[\\[【](?:[A-Z][A-Z0-9]*(?:_[0-9]*)?)?|[A-Z][A-Z0-9]*(?:_[0-9]*)?)\\Z")


class StreamRestorer:
    """write(chunk) and flush() give (text, events); events: (entity, placeholder, restored). Errors repeat for good.

    pieces: the last text in parts, each with the event that ends it, if one does. All state is in `state()`, a JSON
    text, so that a restorer can go on in another process.
    """

    def __init__(self, mapping: dict[str, str], engine: Engine | None = None, state: str | None = None):
        self.mapping, self.engine = mapping, engine or Engine()
        own = json.loads(state) if state else {}
        self.bytes = bytes.fromhex(own.get("bytes", ""))
        self.tail = own.get("tail", "")
        self.read, self.made, self.events, self.report = own.get("counts", [0, 0, 0, 0])
        self.failed, self.closed = own.get("failed"), own.get("closed", False)
        self.pieces: list[tuple[str, list[tuple[str, str, bool]]]] = []

    def withheld(self) -> int:
        """Bytes that are read but not given out yet."""
        return len(self.bytes) + len(self.tail.encode())

    def state(self) -> str:
        return json.dumps({"bytes": self.bytes.hex(), "tail": self.tail, "counts": [self.read, self.made, self.events, self.report], "failed": self.failed, "closed": self.closed})

    def _fail(self, kind: type[MaskingError], why: str):
        self.failed = [kind.__name__, why]
        raise kind(why)

    def _ready(self) -> None:
        if self.failed:
            raise {"InvalidUTF8": InvalidUTF8, "LimitExceeded": LimitExceeded}[self.failed[0]](self.failed[1])
        if self.closed:
            raise StreamClosed("the stream is flushed")

    def write(self, chunk: bytes) -> tuple[str, list[tuple[str, str, bool]]]:
        self._ready()
        self.read += len(chunk)
        if self.read > self.engine.max_input_bytes:
            self._fail(LimitExceeded, "input")
        data = self.bytes + chunk
        cut = len(data)
        for back in range(1, min(3, len(data)) + 1):  # an unfinished character at the end waits
            lead = data[-back]
            if lead >= 0xC0:
                need = 4 if lead >= 0xF0 else 3 if lead >= 0xE0 else 2
                cut = len(data) - back if need > back else cut
                break
            if lead < 0x80:
                break
        try:
            text = data[:cut].decode("utf-8")
            if cut < len(data):
                self._prefix(data[cut:])
        except UnicodeDecodeError:
            self._fail(InvalidUTF8, "input")
        self.bytes = data[cut:]
        return self._emit(text, False)

    @staticmethod
    def _prefix(part: bytes) -> None:
        """Raises unless some continuation makes the part a character."""
        for fill in (b"\x80", b"\xbf", b"\x90", b"\xa0"):
            need = 4 if part[0] >= 0xF0 else 3 if part[0] >= 0xE0 else 2
            try:
                (part + fill * (need - len(part))).decode("utf-8")
                return
            except UnicodeDecodeError:
                pass
        part.decode("utf-8")

    def flush(self) -> tuple[str, list[tuple[str, str, bool]]]:
        self._ready()
        if self.bytes:
            self._fail(InvalidUTF8, "the input ends within a character")
        out = self._emit("", True)
        self.closed = True
        return out

    def _emit(self, text: str, last: bool) -> tuple[str, list[tuple[str, str, bool]]]:
        data, at, parts, events = self.tail + text, 0, [], []
        self.pieces = []
        hold = len(data)
        for m in TOKEN.finditer(data):
            if not last and m.end() == len(data) and data[m.end() - 1] not in "]】":
                hold = m.start()
                break
            entity, digits = m[1], m[2]
            plain = self.mapping.get(f"[{entity}_{int(digits)}]") if len(digits) <= self.engine.max_seq_digits else None
            parts += [data[at : m.start()], m[0] if plain is None else plain]
            events.append((entity, m[0], plain is not None))
            self.pieces += [(parts[-2], []), (parts[-1], events[-1:])]
            at = m.end()
            self.events += 1
            self.report += len(entity) + len(m[0].encode())
        if not last and hold == len(data):
            m = OPEN.search(data, at)
            hold = m.start() if m else hold
        parts.append(data[at:hold])
        self.pieces.append((parts[-1], []))
        self.tail = data[hold:]
        out = "".join(parts)
        self.made += len(out.encode())
        if self.events > MAX_RESTORE_EVENTS or self.report > MAX_REPORT_BYTES or self.made > self.engine.max_output_bytes:
            self._fail(LimitExceeded, "output")
        return out, events


OUTPUT = "stream_id string, chunk_no long, text string, events array<struct<entity:string,placeholder:string,restored:boolean>>, error string"


def rows_of(stream_id: str, chunks, restorer: StreamRestorer) -> list[tuple]:
    """Output rows for (chunk_no, chunk, is_eof) in order; an error gives a row of its own and ends the stream."""
    out = []
    for number, chunk, eof in chunks:
        try:
            text, events = restorer.write(bytes(chunk or b""))
            if eof:
                more, late = restorer.flush()
                text, events = text + more, events + late
            out.append((stream_id, number, text, [{"entity": e, "placeholder": p, "restored": r} for e, p, r in events], None))
        except MaskingError as e:
            out.append((stream_id, number, "", [], type(e).__name__))
    return out


_COLUMNS = ["stream_id", "chunk_no", "text", "events", "error"]


def overdue(stream_id: str, turn: int) -> tuple:
    return (stream_id, turn, "", [], "LimitExceeded")


class RestoreProcessor(StatefulProcessor):
    """For groupBy('stream_id').transformWithStateInPandas over (stream_id, chunk_no, chunk, is_eof, mapping).

    mapping: map of placeholders, given with any row of the stream up to the first token. Rows are taken by chunk_no;
    a chunk that comes before its turn is held until the gap is filled, as many as one input may have bytes; beyond that
    they are given up with the error LimitExceeded.
    """

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
        restorer = StreamRestorer(known, self.engine, state or None)
        ready = []
        while turn in held:
            chunk, eof = held.pop(turn)
            ready.append((turn, bytes.fromhex(chunk), eof))
            turn += 1
        out = rows_of(key[0], ready, restorer)
        if sum(len(c) // 2 for c, _ in held.values()) > self.engine.max_input_bytes:
            out.append(overdue(key[0], turn))
            held = {}
        self.kept.update((restorer.state(), turn, json.dumps(known), json.dumps([[n, c, e] for n, (c, e) in held.items()])))
        yield pd.DataFrame(out, columns=_COLUMNS)

    def close(self) -> None: ...


def restore_stream(chunks: DataFrame, engine: Engine | None = None, ttl_ms: int | None = None) -> DataFrame:
    """Structured Streaming: (stream_id, chunk_no from 0, chunk, is_eof, mapping) to restored pieces.

    ttl_ms: the state of a stream that nothing came for so long is forgotten.
    """
    return chunks.groupBy("stream_id").transformWithStateInPandas(RestoreProcessor(engine, ttl_ms), outputStructType=OUTPUT, outputMode="append", timeMode="processingTime" if ttl_ms else "none")


CHUNKS = ("stream_id", "chunk_no", "chunk", "is_eof", "mapping")


def known_of(rows: list[tuple]) -> dict[str, str]:
    """The mapping that the rows of a stream (CHUNKS) give together; of two plaintexts the later row's holds."""
    known, last = {}, None
    for *_, m in rows:
        if m is not None and m != last:
            known.update(m)
            last = m
    return known


def restore_chunks(chunks: DataFrame, engine: Engine | None = None) -> DataFrame:
    """The same for a batch table: each stream's chunks in one task, whose size the input limit bounds."""
    engine = engine or Engine()

    def run(stream_id: str, rows: list[tuple]) -> list[tuple]:
        return rows_of(stream_id, [r[1:4] for r in rows], StreamRestorer(known_of(rows), engine))

    return by_group(chunks.select(*CHUNKS), "stream_id", "chunk_no", run, OUTPUT)
