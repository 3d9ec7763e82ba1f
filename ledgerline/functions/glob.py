"""Glob patterns of KEYS and SCAN as Spark predicates."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def _class(body: str) -> str:
    out, i = "", 0
    if body[:1] == "^":
        out, i = "^", 1
    while i < len(body):
        c = body[i]
        if c == "\\" and i + 1 < len(body):
            i += 1
            c = body[i]
        elif c == "-" and out not in ("", "^") and i + 1 < len(body):
            out += "-"
            i += 1
            continue
        out += re.sub(r"([\\\[\]^&-])", r"\\\1", c)
        i += 1
    return f"[{out}]" if out not in ("", "^") else ("(?!)" if not out else ".")


def to_regex(glob: str) -> str:
    """``*`` any run, ``?`` one code point, ``[a-z]`` and ``[^...]`` classes, ``\\x`` literal x; an unterminated ``[`` is literal."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif c == "\\" and i + 1 < len(glob):
            i += 1
            out += re.escape(glob[i])
        elif c == "[" and (end := _closing(glob, i)) > 0:
            out += _class(glob[i + 1 : end])
            i = end
        else:
            out += re.escape(c)
        i += 1
    return rf"(?s)\A{out}\z"


def _closing(glob: str, at: int) -> int:
    i = at + 1 + (glob[at + 1 : at + 2] == "^")
    while i < len(glob):
        if glob[i] == "\\":
            i += 1
        elif glob[i] == "]" and i > at + 1:
            return i
        i += 1
    return -1


def literal_prefix(glob: str) -> str:
    out, i = "", 0
    while i < len(glob) and glob[i] not in "*?[":
        if glob[i] == "\\" and i + 1 < len(glob):
            i += 1
        out += glob[i]
        i += 1
    return out


def matches(name: str | Column, glob: str) -> Column:
    """A regex, and beside it the literal prefix as a predicate that reaches the Parquet scan."""
    c = F.col(name) if isinstance(name, str) else name
    if glob == "*":
        return c.isNotNull()
    p = literal_prefix(glob)
    if p == glob and "\\" not in glob:
        return c == glob
    hit = c.rlike(to_regex(glob))
    return c.startswith(p) & hit if p else hit
