"""JSON bodies by span: strict parsing that keeps members, duplicates and places, the texts to treat, and patches.

Spark's own JSON reader folds duplicate members and forgets where values stand, so that a body could not be given back
byte for byte. Positions are code points of the decoded body; all bytes outside patched strings stay as they were.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

from maskwright.config import LimitExceeded, MaskingError

MAX_DEPTH, MAX_NODES = 64, 65_536


class JsonSyntaxError(MaskingError): ...


@dataclass(slots=True)
class Node:
    """kind: object, array, string, number or word; [start, end) is the whole value, quotes included."""

    kind: str
    start: int
    end: int
    value: object

    def raw(self, text: str) -> str:
        return text[self.start : self.end]

    def named(self, key: str) -> Iterator[Node]:
        """The values of all members of that name, in the order they stand; nothing where this is no object."""
        return (v for k, v in self.value if k == key) if self.kind == "object" else iter(())

    def items(self) -> list[Node]:
        return self.value if self.kind == "array" else []


_SPACE = re.compile(r"[ \t\n\r]*")
_NUMBER = re.compile(r"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?")
_STRING = re.compile(r'"((?:[^"\\\x00-\x1f]++|\\(?:["\\/bfnrt]|u[0-9A-Fa-f]{4}))*+)"')
_ESCAPE = re.compile(r"\\u([dD][89abAB][0-9A-Fa-f]{2})\\u([dD][c-fC-F][0-9A-Fa-f]{2})|\\u([0-9A-Fa-f]{4})|\\(.)")
_WORD = re.compile("true|false|null")
_PLAIN = {"b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t"}


def _unescaped(m: re.Match) -> str:
    if m[1]:
        return chr(0x10000 + ((int(m[1], 16) - 0xD800) << 10) + int(m[2], 16) - 0xDC00)
    if m[3]:
        code = int(m[3], 16)
        if 0xD800 <= code < 0xE000:
            raise JsonSyntaxError("a surrogate without its pair")
        return chr(code)
    return _PLAIN.get(m[4], m[4])


class _Reader:
    def __init__(self, text: str):
        self.text, self.at, self.nodes = text, 0, 0

    def space(self) -> None:
        self.at = _SPACE.match(self.text, self.at).end()

    def take(self, kind: str, pattern: re.Pattern) -> re.Match:
        m = pattern.match(self.text, self.at)
        if not m:
            raise JsonSyntaxError(f"{kind} expected at {self.at}")
        self.at = m.end()
        return m

    def next(self) -> str:
        self.space()
        return self.text[self.at : self.at + 1]

    def entered(self, depth: int) -> None:
        self.nodes += 1
        if depth > MAX_DEPTH or self.nodes > MAX_NODES:
            raise LimitExceeded("JSON depth or nodes")

    def string(self) -> Node:
        m = self.take("string", _STRING)
        return Node("string", m.start(), m.end(), _ESCAPE.sub(_unescaped, m[1]) if "\\" in m[1] else m[1])

    def list_of(self, close: str, one) -> list:
        """What stands between commas up to the closing sign; self.at is at the opening one."""
        self.at += 1
        out = []
        if self.next() != close:
            out.append(one())
            while self.next() == ",":
                self.at += 1
                self.space()
                out.append(one())
            if self.next() != close:
                raise JsonSyntaxError(f"{close} expected at {self.at}")
        self.at += 1
        return out

    def value(self, depth: int) -> Node:
        first, start = self.next(), self.at
        # a key is no node; a value is one, at the depth of what holds it and one more
        self.entered(depth)
        if first == "{":

            def member() -> tuple[str, Node]:
                if depth + 1 > MAX_DEPTH:
                    raise LimitExceeded("JSON depth")
                key = self.string().value
                if self.next() != ":":
                    raise JsonSyntaxError(f": expected at {self.at}")
                self.at += 1
                return key, self.value(depth + 1)

            own = self.list_of("}", member)
            return Node("object", start, self.at, own)
        if first == "[":
            own = self.list_of("]", lambda: self.value(depth + 1))
            return Node("array", start, self.at, own)
        if first == '"':
            return self.string()
        kind, pattern = ("number", _NUMBER) if first in "-0123456789" and first else ("word", _WORD)
        m = self.take("value", pattern)
        return Node(kind, start, self.at, m[0])


def parse(text: str) -> Node:
    """The root of a JSON text, with nothing but white space around it."""
    reader = _Reader(text)
    root = reader.value(1)
    reader.space()
    if reader.at < len(text):
        raise JsonSyntaxError(f"more text at {reader.at}")
    return root


def parse_bytes(body: bytes) -> tuple[str, Node]:
    try:
        text = body.decode("utf-8")
    except UnicodeDecodeError as e:
        raise JsonSyntaxError("not UTF-8") from e
    return text, parse(text)


def strings(node: Node) -> Iterator[Node]:
    """All string values, keys left out, in the order they stand."""
    if node.kind == "string":
        yield node
    for child in node.items() if node.kind == "array" else [v for _, v in node.value] if node.kind == "object" else []:
        yield from strings(child)


# ---- patches ------------------------------------------------------------------------------------

_BARE = {chr(i): f"\\u{i:04x}" for i in range(0x20)} | {'"': '\\"', "\\": "\\\\", "\b": "\\b", "\f": "\\f", "\n": "\\n", "\r": "\\r", "\t": "\\t"}
_IN_STREAM = str.maketrans(_BARE)
_IN_BODY = str.maketrans(_BARE | {chr(0x2028): "\\u2028", chr(0x2029): "\\u2029"})


def encoded(text: str, stream: bool = False) -> str:
    """The inside of a JSON string: characters and slashes bare. Line separators are escaped in bodies, not in streams."""
    return text.translate(_IN_STREAM if stream else _IN_BODY)


def patched(text: str, patches: list[tuple[int, int, str]]) -> str:
    """The text with the insides [start, end) of strings replaced, in any order; overlaps are an error."""
    out, at = [], 0
    for start, end, new in sorted(patches):
        if start < at or end < start or end > len(text):
            raise MaskingError("patches overlap or leave the text")
        out += [text[at:start], encoded(new)]
        at = end
    return "".join([*out, text[at:]])


def within_budget(size: int, patches: list[tuple[str, str]], limit: int) -> bool:
    """Whether a body of that many bytes stays within the limit after every patch (raw old inside, new text) in turn."""
    for old, new in patches:
        size += len(encoded(new).encode()) - len(old.encode())
        if size > limit:
            return False
    return True


# ---- the texts to treat ---------------------------------------------------------------------------

#: Where free text stands in chat requests, their schemas, and responses, in the order it is numbered.
#: A step is a member name, [] for the elements of an array; a name in the last place is a string, or @schema a schema.
_MESSAGE = (
    ("content", ("=", "[].text", "[].refusal")),
    ("refusal", ("=",)),
    ("tool_calls", ("[].function.arguments", "[].custom.input")),
    ("function_call", ("arguments",)),
)
_FUNCTION = (("description", ("=",)), ("parameters", ("@schema",)))
SCHEMA_TEXTS = ("description", "title", "$comment")
SCHEMA_ONE = ("additionalItems", "contains", "contentSchema", "additionalProperties", "unevaluatedItems", "unevaluatedProperties", "propertyNames", "not", "if", "then", "else")
SCHEMA_LISTS = ("prefixItems", "allOf", "anyOf", "oneOf")
SCHEMA_MAPS = ("properties", "patternProperties", "$defs", "definitions", "dependentSchemas", "dependencies")


def _each(node: Node, *names: str) -> Iterator[Node]:
    """The nodes at a path of member names; "[]" stands for the elements of an array."""
    if not names:
        yield node
        return
    for child in node.items() if names[0] == "[]" else node.named(names[0]):
        yield from _each(child, *names[1:])


def _at(node: Node, path: str) -> Iterator[Node]:
    steps = [] if path == "=" else path.replace("[]", "[].").replace("..", ".").split(".")
    return (n for n in _each(node, *[s for s in steps if s]) if n.kind == "string")


def _object_texts(node: Node, plan) -> Iterator[Node]:
    for name, paths in plan:
        for child in node.named(name):
            if paths == ("@schema",):
                yield from schema_texts(child)
                continue
            # the parts of an array are taken one by one, all paths of a part before the next part
            if child.kind == "array":
                for part in child.items():
                    for path in paths:
                        if path.startswith("[]"):
                            yield from _at(part, path[2:].lstrip("."))
            else:
                for path in paths:
                    if not path.startswith("[]"):
                        yield from _at(child, path)


def schema_texts(node: Node) -> Iterator[Node]:
    """The descriptions, titles and comments of a JSON schema and of the schemas in it; anything else is passed over."""
    if node.kind != "object":
        return
    for name in SCHEMA_TEXTS:
        yield from (v for v in node.named(name) if v.kind == "string")
    for own in node.named("items"):
        for child in own.items() if own.kind == "array" else [own]:
            yield from schema_texts(child)
    for name in SCHEMA_ONE:
        for child in node.named(name):
            yield from schema_texts(child)
    for name in SCHEMA_LISTS:
        for child in _each(node, name, "[]"):
            yield from schema_texts(child)
    for name in SCHEMA_MAPS:
        for own in node.named(name):
            if own.kind == "object":
                for _, child in sorted(own.value, key=lambda kv: kv[0].encode()):
                    yield from schema_texts(child)


def request_texts(root: Node) -> Iterator[Node]:
    for message in _each(root, "messages", "[]"):
        yield from _object_texts(message, _MESSAGE)
    for tool in _each(root, "tools", "[]"):
        for function in tool.named("function"):
            yield from _object_texts(function, _FUNCTION)
        for custom in tool.named("custom"):
            yield from _at(custom, "description")
    for function in _each(root, "functions", "[]"):
        yield from _object_texts(function, _FUNCTION)
    for own in _each(root, "response_format", "json_schema"):
        yield from _object_texts(own, (("description", ("=",)), ("schema", ("@schema",))))
    for prediction in root.named("prediction"):
        yield from _object_texts(prediction, (("content", ("=", "[].text")),))


def response_texts(root: Node) -> Iterator[Node]:
    for message in _each(root, "choices", "[]", "message"):
        yield from _object_texts(message, (*_MESSAGE, ("audio", ("transcript",))))
