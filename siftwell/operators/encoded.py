"""Texts hidden inside a text by an encoding."""

from __future__ import annotations

import base64
import binascii
import re
from collections.abc import Iterator
from typing import NamedTuple
from urllib.parse import unquote_to_bytes

#: Shortest run that is decoded and layers that are; share of printable characters and letters that a decoded text has at least.
LEAST_RUN, LAYERS, PRINTABLE, LETTERS = 24, 2, 0.9, 4
STRETCH = 64


class Run(NamedTuple):
    """A decoded text, how it was hidden, how many layers lay above, and the run of the outermost text that holds it."""

    start: int
    end: int
    how: str
    text: str
    depth: int


def _base64(run: str, signs: bytes | None = None) -> str | None:
    body = run.rstrip("=")
    if len(body) % 4 == 1:
        return None
    return base64.b64decode(body + "=" * (-len(body) % 4), signs).decode("utf-8", "replace")


def _percent(run: str) -> str | None:
    if re.search("%(?![0-9A-Fa-f]{2})", run):
        return None
    return unquote_to_bytes(run).decode()


def _points(pattern: re.Pattern, run: str, number) -> str:
    return pattern.sub(lambda m: chr(number(m)), run)


ENTITY = re.compile("&#(?:[xX]([0-9A-Fa-f]{1,6})|([0-9]{1,7}));")
ESCAPE = re.compile(r"\\(?:x([0-9A-Fa-f]{2})|u([0-9A-Fa-f]{4})|u\{([0-9A-Fa-f]{1,6})\})")
#: Name, runs, what the text must hold, decoder.  Of runs equally long the earlier kind counts.
KINDS = [
    ("Base64", re.compile("[A-Za-z0-9+/]{24,}={0,2}"), "", _base64),
    ("Base64url", re.compile("[A-Za-z0-9_-]{24,}={0,2}"), "", lambda r: _base64(r, b"-_")),
    ("URL encoding", re.compile(r"[A-Za-z0-9._~%:/?#\[\]@!$&'()*+,;=-]{24,}"), "%", _percent),
    ("hexadecimal", re.compile(r"\b(?:[0-9A-Fa-f]{2}){12,}\b", re.ASCII), "", lambda r: bytes.fromhex(r).decode("latin-1")),
    ("HTML escaping", re.compile("(?:&#(?:x[0-9A-Fa-f]{1,6}|[0-9]{1,7});){6,}"), "&#", lambda r: _points(ENTITY, r, lambda m: int(m[1], 16) if m[1] else int(m[2]))),
    ("string escaping", re.compile(r"(?:\\(?:x[0-9A-Fa-f]{2}|u[0-9A-Fa-f]{4}|u\{[0-9A-Fa-f]{1,6}\})){6,}"), "\\", lambda r: _points(ESCAPE, r, lambda m: int(m[1] or m[2] or m[3], 16))),
]
SEEN, LETTER = re.compile("[\t\n\r\x20-\x7e]"), re.compile("[A-Za-z]")


def readable(text: str) -> bool:
    return bool(text) and len(SEEN.findall(text)) >= PRINTABLE * len(text) and len(LETTER.findall(text)) >= LETTERS


def _candidates(text: str) -> list[tuple]:
    found = []
    for order, (how, pattern, needs, decode) in enumerate(KINDS):
        if needs in text:
            for m in pattern.finditer(text):
                if m.end() - m.start() >= LEAST_RUN and (how != "URL encoding" or re.search("%[0-9A-Fa-f]{2}", m[0])):
                    found.append((m.start() - m.end(), m.start(), order, m.end(), how, decode, m[0]))
    return sorted(found, key=lambda c: c[:3])


def decoded_runs(text: str, layers: int = LAYERS) -> Iterator[Run]:
    """Every run that decodes to readable text, outer ones first: of runs within one another the longest."""
    seen: set[tuple] = set()

    def walk(inner: str, depth: int, outer: tuple[int, int] | None) -> Iterator[Run]:
        taken: dict[int, list[tuple[int, int]]] = {}  # by stretches of the text that they touch
        for _, start, _, end, how, decode, run in _candidates(inner):
            if any(a <= start and end <= b for a, b in taken.get(start // STRETCH, ())):
                continue
            try:
                plain = decode(run)
            except (ValueError, binascii.Error, OverflowError):
                continue
            place = outer or (start, end)
            if plain is None or plain == run or not readable(plain) or (*place, plain) in seen:
                continue
            seen.add((*place, plain))
            for k in range(start // STRETCH, (end - 1) // STRETCH + 1):
                taken.setdefault(k, []).append((start, end))
            yield Run(*place, how, plain, depth)
            if depth + 1 < layers:
                yield from walk(plain, depth + 1, place)

    if len(text) >= LEAST_RUN:
        yield from walk(text, 0, None)
