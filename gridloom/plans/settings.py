"""Settings as text: ``name{key=value,...}`` with nested objects, lists, numbers, truth values, null and strings."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

_TOKEN = re.compile(r"\s*(?:(?P<number>[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)(?![\w:])|(?P<string>\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*')|(?P<word>[A-Za-z_][\w.:/-]*)|(?P<mark>[{}\[\],=]))")


class BadSettings(ValueError):
    """Text that is no settings."""


@dataclass
class Setting:
    """A named object."""

    name: str
    values: dict[str, object] = field(default_factory=dict)


def _tokens(text: str):
    at, out = 0, []
    while text[at:].strip():
        m = _TOKEN.match(text, at)
        if not m:
            raise BadSettings(f"unexpected {text[at:].strip()[:10]!r} at {at}")
        out.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    return out + [("end", "")]


class _Parser:
    def __init__(self, text: str):
        self.tokens, self.at = _tokens(text), 0

    def peek(self, mark: str) -> bool:
        return self.tokens[self.at] == ("mark", mark)

    def take(self, mark: str | None = None):
        kind, value = self.tokens[self.at]
        if mark is not None and (kind, value) != ("mark", mark):
            raise BadSettings(f"expected {mark!r}, found {value or 'the end'!r}")
        self.at += 1
        return kind, value

    def value(self):
        kind, value = self.take()
        if kind == "number":
            return float(value) if re.search(r"[.eE]", value) else int(value)
        if kind == "string":
            return re.sub(r"\\(.)", r"\1", value[1:-1])
        if kind == "word":
            if self.peek("{"):
                return Setting(value, self.fields())
            return {"true": True, "false": False, "null": None}.get(value, value)
        if (kind, value) == ("mark", "["):
            return self.many("]", self.value)
        if (kind, value) == ("mark", "{"):
            self.at -= 1
            return self.fields()
        raise BadSettings(f"unexpected {value or 'the end'!r}")

    def many(self, end: str, item):
        out = []
        while not self.peek(end):
            out.append(item())
            if not self.peek(end):
                self.take(",")
        self.take(end)
        return out

    def fields(self) -> dict[str, object]:
        self.take("{")

        def one():
            kind, key = self.take()
            if kind not in ("word", "string"):
                raise BadSettings(f"expected a name, found {key or 'the end'!r}")
            self.take("=")
            return key, self.value()

        return dict(self.many("}", one))


def parse(text: str):
    """One value; a bare word is a string."""
    p = _Parser(text)
    out = p.value()
    if p.take()[0] != "end":
        raise BadSettings("more follows the value")
    return out


def parse_list(text: str) -> list[Setting]:
    """Named objects with commas between them; a name alone has no values."""
    p, out = _Parser(text), []
    while p.tokens[p.at][0] != "end":
        value = p.value()
        out.append(value if isinstance(value, Setting) else Setting(str(value)))
        if p.tokens[p.at][0] != "end":
            p.take(",")
    return out


def build(registry: dict[str, type], setting: Setting):
    """An object of the registered class (a dataclass) with the setting's values; unknown names fail."""
    if setting.name not in registry:
        raise BadSettings(f"unknown name {setting.name!r}; known: {', '.join(sorted(registry))}")
    try:
        return registry[setting.name](**setting.values)
    except TypeError as error:
        raise BadSettings(str(error)) from error
