"""What the operators that find spans in texts share."""

from __future__ import annotations

import hashlib

Span = tuple[str, int, int]


def joined(spans: list[Span], kinds: tuple[str, ...]) -> str:
    """kind:start:end by start, then kind in the order of ``kinds``, comma-joined."""
    rank = {k: i for i, k in enumerate(kinds)}
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], rank[s[0]], s[2])))


def digest(spans: list[Span], kinds: tuple[str, ...]) -> str:
    return hashlib.sha256(joined(spans, kinds).encode()).hexdigest()


def clear_of(start: int, end: int, spans: list[Span]) -> bool:
    """Whether none of these spans overlaps start:end."""
    return all(end <= a or b <= start for _, a, b in spans)


def masked(text: str, spans: list[Span]) -> str:
    """The text with each covered stretch replaced by the upper-case kind in brackets."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])
