"""Deep merges as values that compose: patches of nested documents (small helpers that run inside tasks).

A delta merges into a document key by key: null removes, an object merges into an object and replaces anything else,
other values replace. Two deltas in a row are again one patch, whatever the document was, once a patch can say "merge
into an object, else become this". So long histories of one record are composed piece by piece, in parallel, and no task
needs all of them. A patch maps keys to ``["gone"]``, ``["is", value]`` or ``["merge", value otherwise, patch]``.
"""

from __future__ import annotations

import json
from typing import Any

Patch = dict[str, list]


def spread(delta: dict, separator: str = ".") -> dict:
    """Top-level dotted keys as nested objects; ValueError where a key runs through a value that is no object."""
    out: dict[str, Any] = {}
    for key, value in delta.items():
        *parents, last = key.split(separator)
        place = out
        for part in parents:
            place = place.setdefault(part, {})
            if not isinstance(place, dict):
                raise ValueError(f"{key} runs through a value")
        place[last] = value
    return out


def flat(doc: dict, separator: str = ".", prefix: str = "") -> dict:
    """Nested objects as dotted keys; empty objects vanish, arrays stay."""
    out: dict[str, Any] = {}
    for key, value in doc.items():
        out |= flat(value, separator, f"{prefix}{key}{separator}") if isinstance(value, dict) else {prefix + key: value}
    return out


def patch_of(delta: dict) -> Patch:
    return {key: ["gone"] if value is None else ["merge", value, patch_of(value)] if isinstance(value, dict) else ["is", value] for key, value in delta.items()}


def applied(doc: dict, patch: Patch) -> dict:
    out = dict(doc)
    for key, (kind, *rest) in patch.items():
        if kind == "gone":
            out.pop(key, None)
        elif kind == "merge" and isinstance(out.get(key), dict):
            out[key] = applied(out[key], rest[1])
        else:
            out[key] = rest[0]
    return out


def composed(first: Patch, then: Patch) -> Patch:
    """The patch that does what ``first`` and ``then`` do one after the other."""
    out = dict(first)
    for key, step in then.items():
        before = out.get(key)
        if before is None or step[0] != "merge":
            out[key] = step
        elif before[0] == "merge":
            out[key] = ["merge", applied(before[1], step[2]), composed(before[2], step[2])]
        elif before[0] == "is" and isinstance(before[1], dict):
            out[key] = ["is", applied(before[1], step[2])]
        else:
            out[key] = ["is", step[1]]
    return out


class History:
    """What a run of operations does to one record: perhaps forget it, then patch it."""

    def __init__(self, forgets: bool = False, alive: bool = False, patch: Patch | None = None) -> None:
        self.forgets, self.alive, self.patch = forgets, alive, patch or {}

    def delete(self) -> None:
        self.forgets, self.alive, self.patch = True, False, {}

    def write(self, patch: Patch) -> None:
        self.alive, self.patch = True, composed(self.patch, patch)

    def then(self, other: History) -> None:
        if other.forgets:
            self.delete()
        if other.alive:
            self.write(other.patch)

    def document(self) -> dict | None:
        return applied({}, self.patch) if self.alive else None

    def dumps(self) -> str:
        return json.dumps([self.forgets, self.alive, self.patch], ensure_ascii=False, separators=(",", ":"))

    @classmethod
    def loads(cls, text: str) -> History:
        return cls(*json.loads(text))


def read_delta(text: str | None, nested: bool = True) -> dict | None:
    """A delta as an object with dotted keys spread; None for what is no JSON object or contradicts itself."""
    try:
        delta = json.loads(text or "null")
        return (spread(delta) if nested else delta) if isinstance(delta, dict) else None
    except ValueError:
        return None
