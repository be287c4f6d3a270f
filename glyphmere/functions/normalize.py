"""Rewrite rules for names: a rule is a list of operations, folded into one column expression."""

from __future__ import annotations

import functools
import json
import os
import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Lower:
    def column(self, s: Column) -> Column:
        return F.lower(s)


@dataclass(frozen=True)
class Map:
    """Each character of the set becomes the replacement (none, one or more characters)."""

    charset: str
    to: str

    def column(self, s: Column) -> Column:
        if len(self.to) == 1:
            return F.translate(s, "".join(dict.fromkeys(self.charset)), self.to * len(set(self.charset)))
        return F.regexp_replace(s, _class(self.charset), re.sub(r"([\\$])", r"\\\1", self.to))


@dataclass(frozen=True)
class Collapse:
    """Runs of one and the same character of the set become one; mixed runs stay."""

    charset: str

    def column(self, s: Column) -> Column:
        return F.regexp_replace(s, f"({_class(self.charset)})\\1+", "$1")


Op = Lower | Map | Collapse


def _class(charset: str) -> str:
    return "[" + "".join(f"\\x{{{ord(c):x}}}" for c in charset) + "]"


#: Python packaging names: lower case, and any one of ._- for a hyphen (each run of them one).
PYPI: tuple[Op, ...] = (Lower(), Map("._-", "-"), Collapse("-"))


def parse_rules(text: str) -> tuple[Op, ...]:
    """Operations of a JSON array of ["lower"], ["map", SET, TO], ["collapse", SET]."""
    try:
        program = json.loads(text)
    except json.JSONDecodeError as e:
        raise ValueError(f"invalid JSON: {e}") from None
    if not isinstance(program, list):
        raise ValueError("rules must be an array")
    arity = {"lower": 0, "map": 2, "collapse": 1}
    ops: list[Op] = []
    for rule in program:
        if not isinstance(rule, list) or not rule or not all(isinstance(x, str) for x in rule):
            raise ValueError(f"a rule must be an array of strings: {json.dumps(rule)}")
        name, *args = rule
        if name not in arity:
            raise ValueError(f"unknown operation: {name}")
        if len(args) != arity[name]:
            raise ValueError(f"{name} takes {arity[name]} argument(s)")
        if args and not args[0]:
            raise ValueError(f"{name}: empty character set")
        ops.append({"lower": Lower, "map": Map, "collapse": Collapse}[name](*args))
    return tuple(ops)


def load_rules(path: str) -> tuple[Op, ...]:
    if not os.path.isfile(path):
        raise ValueError(f"{path}: not a regular file")
    try:
        with open(path, encoding="utf-8") as f:
            return parse_rules(f.read())
    except (ValueError, OSError) as e:
        raise ValueError(f"{path}: {e}") from None


def normalized(s: Column, ops: tuple[Op, ...]) -> Column:
    return functools.reduce(lambda c, op: op.column(c), ops, s)
