"""Places named in sources: /*name*/ is right behind the comment, /*<name*/ at its start. And the comparison of occurrences."""

from __future__ import annotations

import re
from typing import NamedTuple


class Place(NamedTuple):
    line: int
    col: int
    col16: int


class MarkerError(ValueError):
    pass


def scan(text: str) -> dict[str, Place]:
    """The places of all markers; lines and columns from 1, columns in bytes of UTF-8 and in units of UTF-16."""

    def place(at: int) -> Place:
        begin = text.rfind("\n", 0, at) + 1
        before = text[begin:at]
        return Place(text.count("\n", 0, at) + 1, 1 + len(before.encode()), 1 + len(before.encode("utf-16-le")) // 2)

    found: dict[str, Place] = {}
    for m in re.finditer(r"/\*(.*?)\*/", text, re.S):
        if "/*" in m[1]:
            raise MarkerError(f"a comment in a comment at {place(m.start(1) + m[1].index('/*'))}")
        name, at = (m[1][1:], m.start()) if m[1].startswith("<") else (m[1], m.end())
        if name in found:
            raise MarkerError(f"{name} is at {found[name]} and at {place(at)}")
        found[name] = place(at)
    return found


def missing(rows: list, expected: list[dict]) -> list:
    """What is left of rows and expected after each expected one took a row: equal in its fields, roles being a part of the row's."""
    rest, lost = list(rows), []
    for e in expected:
        hit = next((r for r in rest if all(r[k] & v == v if k == "roles" else r[k] == v for k, v in e.items())), None)
        if hit is None:
            lost.append(e)
        else:
            rest.remove(hit)
    return rest + lost
