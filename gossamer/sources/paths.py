"""Exempt paths of JSON trees, one rule for typed columns and for JSON texts: `$.a.b`, `a[0].b`, `a[*].b`.

A path is parsed into steps; walking a tree, the steps that still match are carried along.
"""

from __future__ import annotations

import re

#: Any place of a list, or any key of a map.
ANY = "*"
_STEP = re.compile(r"\.?([^.\[\]]+)|\[([0-9]+|\*)\]")

Steps = tuple[str | int, ...]


def parse(paths: list[str] | None) -> list[Steps]:
    """The steps of each path. Descendants, filters, slices and wildcards of keys raise ValueError."""
    out = []
    for path in paths or []:
        rest, steps = path.removeprefix("$"), []
        while rest:
            m = _STEP.match(rest)
            if not m or m[1] == "*":
                raise ValueError(f"exempt paths are plain: {path}")
            steps.append(m[1] if m[1] is not None else ANY if m[2] == ANY else int(m[2]))
            rest = rest[m.end() :]
        if steps:
            out.append(tuple(steps))
    return out


def step(live: list[Steps], to: str | int) -> list[Steps]:
    """What is left of the paths that go on to this key or place; ANY steps go on to every place, but to no key."""
    return [p[1:] for p in live if p and (p[0] == to or (p[0] == ANY and isinstance(to, int)))]


def named(live: list[Steps], kind: type) -> list[str | int]:
    """The keys (str) or places (int) that the next steps name."""
    return sorted({p[0] for p in live if p and p[0] != ANY and isinstance(p[0], kind)})


def ends(live: list[Steps]) -> bool:
    """Whether some path ends here."""
    return () in live
