"""The grammar of claim sheets' cells: actions with nested qualifiers and relations between them, with the lines that do not parse.

A cell holds lines, parted by line feeds or semicolons outside quotes and brackets::

    verb(object)[{key: value, ...}]        the object may be empty, the bracket may be missing
    before(a1, a2)                          a relation of the first and the second action
    none                                    no relation

A value is a quoted or bare word, a number, true, false or null, a list ``[...]`` or
another ``{...}``. Each line is read by descent over these rules; what does not fit is kept as it is
in ``bad``.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKEN = re.compile(r"""\s*(?:(?P<punct>[(){}\[\],:])|(?P<quoted>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')|(?P<word>[^\s(){}\[\],:"']+))""")
_VERB = re.compile(r"[A-Za-z_][A-Za-z_-]*\Z")
_PLACE = re.compile(r"a(\d+)\Z", re.I)
_NUMBER = re.compile(r"-?\d+(\.\d+)?\Z")


def lines(cell: str) -> list[str]:
    """The lines of a cell, without those that are blank."""
    out, start, depth, quote, i = [], 0, 0, "", 0
    while i < len(cell):
        c = cell[i]
        if quote:
            i += c == "\\"
            quote = "" if c == quote else quote
        elif c in "\"'":
            quote = c
        elif c in "([{":
            depth += 1
        elif c in ")]}":
            depth = max(0, depth - 1)
        elif c == ";" and not depth or c == "\n":
            out.append(cell[start:i])
            start, depth = i + 1, 0
        if c == "\n":  # a line feed ends a line whatever is open
            if quote:
                out.append(cell[start:i])
                start = i + 1
            quote, depth = "", 0
        i += 1
    out.append(cell[start:])
    return [x.strip() for x in out if x.strip()]


class _Line:
    def __init__(self, text: str):
        self.text, self.at = text, 0
        self.tokens: list[tuple[str, str]] = []
        at = 0
        while text[at:].strip():
            m = _TOKEN.match(text, at)
            if m is None:
                raise ValueError("no token")
            self.tokens.append((m.lastgroup, m.group(m.lastgroup)))
            at = m.end()

    def peek(self) -> str | None:
        return self.tokens[self.at][1] if self.at < len(self.tokens) and self.tokens[self.at][0] == "punct" else None

    def take(self, punct: str) -> None:
        if self.peek() != punct:
            raise ValueError(f"{punct} is missing")
        self.at += 1

    def words(self) -> list[str]:
        """Words up to the next punctuation, quotes taken off."""
        out = []
        while self.at < len(self.tokens) and self.tokens[self.at][0] != "punct":
            kind, text = self.tokens[self.at]
            out.append(re.sub(r"\\(.)", r"\1", text[1:-1]) if kind == "quoted" else text)
            self.at += 1
        return out

    def value(self):
        if self.peek() == "{":
            return self.fields()
        if self.peek() == "[":
            return self.items("[", "]", self.value)
        kind = self.tokens[self.at][0] if self.at < len(self.tokens) else None
        words = self.words()
        if not words:
            raise ValueError("a value is missing")
        if kind == "word" and len(words) == 1:
            bare = words[0]
            if bare.lower() in ("true", "false", "null", "none"):
                return {"true": True, "false": False}.get(bare.lower())
            if _NUMBER.match(bare):
                return float(bare) if "." in bare else int(bare)
        return " ".join(words)

    def items(self, begin: str, end: str, one) -> list:
        out = []
        self.take(begin)
        while self.peek() != end:
            out.append(one())
            if self.peek() != end:
                self.take(",")
        self.take(end)
        return out

    def field(self) -> tuple[str, object]:
        name = " ".join(self.words())
        if not name:
            raise ValueError("a key is missing")
        if self.peek() != ":":  # a bare word is a mark
            return name, True
        self.take(":")
        return name, self.value()

    def fields(self) -> dict:
        return dict(self.items("{", "}", self.field))

    def end(self) -> None:
        if self.at < len(self.tokens):
            raise ValueError("something follows")


def action(line: str) -> dict:
    """``verb``, ``object`` (None: empty) and ``qualifiers`` (JSON) of a line."""
    p = _Line(line)
    verb = p.words()
    if len(verb) != 1 or not _VERB.match(verb[0]):
        raise ValueError("no verb")
    p.take("(")
    thing = " ".join(p.words())
    p.take(")")
    qualifiers: dict = {}
    if p.peek() is not None:
        for each in p.items("[", "]", p.fields):
            qualifiers |= each
    p.end()
    return {"verb": verb[0].lower(), "object": thing or None, "qualifiers": json.dumps(qualifiers, sort_keys=True, ensure_ascii=False)}


def relation(line: str) -> dict:
    """``relation``, ``first`` and ``second`` (numbers of actions) of a line."""
    p = _Line(line)
    name = p.words()
    p.take("(")
    places = [p.words()]
    p.take(",")
    places.append(p.words())
    p.take(")")
    p.end()
    found = [_PLACE.match(x[0]) if len(x) == 1 else None for x in places]
    if len(name) != 1 or not _VERB.match(name[0]) or None in found:
        raise ValueError("no relation of two actions")
    return {"relation": name[0].lower(), "first": int(found[0][1]), "second": int(found[1][1])}


def parsed(actions: str | None, relations: str | None) -> dict:
    """Both cells of a row; a relation to an action that the row does not have is bad."""
    out: dict = {"actions": [], "relations": [], "bad": []}
    for line in lines(actions or ""):
        try:
            out["actions"].append(action(line))
        except ValueError:
            out["bad"].append(line)
    n = len(out["actions"])
    for line in lines(relations or ""):
        if line.lower() == "none":
            continue
        try:
            one = relation(line)
            if not (1 <= one["first"] <= n and 1 <= one["second"] <= n):
                raise ValueError("no such action")
            out["relations"].append(one)
        except ValueError:
            out["bad"].append(line)
    return out


def _written(value) -> str:
    if isinstance(value, dict):
        return "{" + ", ".join(f"{json.dumps(k, ensure_ascii=False)}: {_written(v)}" for k, v in value.items()) + "}"
    if isinstance(value, list):
        return "[" + ", ".join(map(_written, value)) + "]"
    if value is None or isinstance(value, (bool, int, float)):
        return {None: "null", True: "true", False: "false"}.get(value, str(value)) if not isinstance(value, (int, float)) or isinstance(value, bool) else str(value)
    return '"' + re.sub(r'([\\"])', r"\\\1", value) + '"'


def rendered(parts: dict) -> tuple[str, str]:
    """The two cells that :func:`parsed` reads back as ``parts``."""
    rows = []
    for x in parts["actions"]:
        q = json.loads(x["qualifiers"])
        rows.append(f"{x['verb']}({_written(x['object']) if x['object'] else ''})" + (f"[{_written(q)}]" if q else ""))
    return "; ".join(rows), "\n".join(f"{x['relation']}(a{x['first']}, a{x['second']})" for x in parts["relations"]) or "none"


CLAIMS = "struct<actions:array<struct<verb:string,object:string,qualifiers:string>>,relations:array<struct<relation:string,first:int,second:int>>,bad:array<string>>"


def claims(actions: Column, relations: Column) -> Column:
    """Both cells parsed, a batch at a time: ``actions, relations, bad``."""

    @F.pandas_udf(CLAIMS)
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for a, r in batches:
            yield pd.DataFrame([parsed(x, y) for x, y in zip(a, r)], columns=["actions", "relations", "bad"])

    return run(actions, relations)
