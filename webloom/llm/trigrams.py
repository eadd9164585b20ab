"""Trigrams of texts and of regular expressions: what a match must hold, and postings of documents.

A trigram is three bytes of UTF-8 with A-Z in lower case, as one number.  A query is
nested tuples: ("and", parts), ("or", parts), a trigram, or ``ALL`` (no trigram is
mandatory).  It is derived from the parsed expression: of each part the set of
strings that it matches exactly is kept as long as it is small, with the sets of
their beginnings and ends beyond it; what these strings share is demanded.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np

sre = re._parser  # the tree of an expression, as the standard library parses it
c = re._constants

ALL = ("and",)
NOTHING = ("or",)
#: Sets of strings are given up beyond so many members; classes of more characters aren't spelt out; ends are cut to so many bytes.
MOST_STRINGS, MOST_CHARACTERS, END = 64, 8, 4
_FOLD = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_FOLD_TABLE = np.frombuffer(_FOLD, np.uint8)


def folded(text: str) -> bytes:
    """UTF-8 with A-Z in lower case; lone surrogates as three bytes."""
    return text.encode("utf-8", "surrogatepass").translate(_FOLD)


def number(three: bytes) -> int:
    return three[0] << 16 | three[1] << 8 | three[2]


def _and(*parts: tuple | int) -> tuple | int:
    flat: list = []
    for p in parts:
        if p == NOTHING:
            return NOTHING
        flat.extend(p[1:] if isinstance(p, tuple) and p[0] == "and" else [p])
    flat = list(dict.fromkeys(flat))
    return flat[0] if len(flat) == 1 else ("and", *flat)


def _or(parts: Iterable[tuple | int]) -> tuple | int:
    flat: list = []
    for p in parts:
        if p == ALL:
            return ALL
        flat.extend(p[1:] if isinstance(p, tuple) and p[0] == "or" else [p])
    flat = list(dict.fromkeys(flat))
    # a way that demands all that another demands, and more, adds nothing
    sets = [frozenset([p] if isinstance(p, int) else p[1:]) for p in flat]
    plain = [isinstance(p, int) or p[0] == "and" for p in flat]
    flat = [p for k, p in enumerate(flat) if not any(plain[j] and sets[j] < sets[k] for j in range(len(flat)) if plain[k])]
    return flat[0] if len(flat) == 1 else ("or", *flat)


def _of_strings(strings: Iterable[bytes]) -> tuple | int:
    """That one of the strings is there; any shorter than three bytes asks for nothing."""
    return _or(_and(*[number(s[i : i + 3]) for i in range(len(s) - 2)]) for s in strings)


@dataclass
class _Part:
    """What a part of an expression matches: exactly these strings, or strings that begin and end so; and the query of what is no longer among them."""

    exact: frozenset[bytes] | None
    begins: frozenset[bytes] = field(default=frozenset([b""]))
    ends: frozenset[bytes] = field(default=frozenset([b""]))
    query: tuple | int = ALL


_EMPTY, _ANYTHING = _Part(frozenset([b""])), _Part(None)


def _short(part: _Part) -> _Part:
    """part with no more strings than it may hold; what is let go goes into its query."""
    if part.exact is not None and (len(part.exact) > MOST_STRINGS or any(len(s) > 64 for s in part.exact)):
        part = _Part(None, part.exact, part.exact, _and(part.query, _of_strings(part.exact)))
    if part.exact is None:
        query = part.query
        sides = []
        for strings, cut in ((part.begins, lambda s, n: s[:n]), (part.ends, lambda s, n: s[max(0, len(s) - n) :])):
            if any(len(s) > END for s in strings):
                query = _and(query, _of_strings(strings))
            n = END
            while len(strings := frozenset(cut(s, n) for s in strings)) > MOST_STRINGS:
                n -= 1
            sides.append(strings)
        part = _Part(None, *sides, query)
    return part


def _cross(left: Iterable[bytes], right: Iterable[bytes]) -> frozenset[bytes]:
    right = list(right)
    return frozenset(a + b for a in left for b in right)


def _then(a: _Part, b: _Part) -> _Part:
    if a.exact is not None and b.exact is not None:
        return _short(_Part(_cross(a.exact, b.exact), query=_and(a.query, b.query)))
    a_begins, a_ends = (a.exact, a.exact) if a.exact is not None else (a.begins, a.ends)
    b_begins, b_ends = (b.exact, b.exact) if b.exact is not None else (b.begins, b.ends)
    joint = _cross(a_ends, b_begins) if len(a_ends) * len(b_begins) <= 4 * MOST_STRINGS else frozenset([b""])
    begins = _cross(a.exact, b_begins) if a.exact is not None and len(a.exact) * len(b_begins) <= 4 * MOST_STRINGS else a_begins
    ends = _cross(a_ends, b.exact) if b.exact is not None and len(b.exact) * len(a_ends) <= 4 * MOST_STRINGS else b_ends
    return _short(_Part(None, begins, ends, _and(a.query, b.query, _of_strings(joint))))


def _either(parts: list[_Part]) -> _Part:
    if all(p.exact is not None and p.query == ALL for p in parts):
        return _short(_Part(frozenset().union(*(p.exact for p in parts))))
    whole = [p if p.exact is None else _Part(None, p.exact, p.exact, _and(p.query, _of_strings(p.exact))) for p in parts]
    return _short(_Part(None, frozenset().union(*(p.begins for p in whole)), frozenset().union(*(p.ends for p in whole)), _or(p.query for p in whole)))


def _characters(items: list) -> _Part:
    found: set[bytes] = set()
    for kind, value in items:
        if kind is c.LITERAL:
            found.add(folded(chr(value)))
        elif kind is c.RANGE and value[1] - value[0] <= 4 * MOST_CHARACTERS:
            found |= {folded(chr(v)) for v in range(value[0], value[1] + 1)}
        else:
            return _ANYTHING
    return _Part(frozenset(found)) if len(found) <= MOST_CHARACTERS else _ANYTHING


def _part(node: tuple) -> _Part:
    kind, value = node
    if kind is c.LITERAL:
        return _Part(frozenset([folded(chr(value))]))
    if kind is c.IN:
        return _characters(value)
    if kind is c.BRANCH:
        return _either([_sequence(p) for p in value[1]])
    if kind is c.SUBPATTERN:
        return _sequence(value[3])
    if kind is c.ATOMIC_GROUP:
        return _sequence(value)
    if kind in (c.AT, c.ASSERT, c.ASSERT_NOT):
        return _EMPTY
    if kind in (c.MAX_REPEAT, c.MIN_REPEAT, c.POSSESSIVE_REPEAT):
        least, most, what = value
        once = _sequence(what)
        if (least, most) == (0, 1):
            return _either([_EMPTY, once])
        if least == 0:
            return _ANYTHING
        out = once
        for _ in range(min(least, 64) - 1):
            out = _then(out, once)
        return out if least == most and least <= 64 else _then(out, _Part(None, frozenset([b""]), once.exact or once.ends, ALL))
    return _ANYTHING


def _sequence(nodes: Iterable[tuple]) -> _Part:
    out = _EMPTY
    for node in nodes:
        out = _then(out, _part(node))
    return out


def query_of(pattern: str) -> tuple | int:
    """The trigrams that every text with a match of the pattern has; ``ALL`` if there are none.

    Case doesn't count in an index, so flags for it make no difference.
    """
    part = _sequence(sre.parse(pattern))
    if part.exact is not None:
        return _and(part.query, _of_strings(part.exact))
    return _and(part.query, _of_strings(part.begins), _of_strings(part.ends))


def trigrams_in(query: tuple | int) -> set[int]:
    return {query} if isinstance(query, int) else set().union(*(trigrams_in(p) for p in query[1:]))


def evaluate(query: tuple | int, postings: dict[int, np.ndarray], n: int) -> np.ndarray:
    """The documents, of n, that satisfy the query: a mask; postings intersected and united."""
    if isinstance(query, int):
        mask = np.zeros(n, bool)
        mask[postings.get(query, [])] = True
        return mask
    mask = np.full(n, query[0] == "and")
    for part in query[1:]:
        if query[0] == "and":
            mask &= evaluate(part, postings, n)
            if not mask.any():
                break
        else:
            mask |= evaluate(part, postings, n)
    return mask


def _codes(data: np.ndarray) -> np.ndarray:
    return data[:-2].astype(np.uint64) << 16 | data[1:-1].astype(np.uint64) << 8 | data[2:].astype(np.uint64)


#: Bytes whose trigrams are sorted at a time.
PIECE = 1 << 22


def invert(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """trigrams (ascending), ends and gap bytes of their postings among the texts (up to 2**32).

    A gap is written as one byte for what is over a multiple of 255, after a 255 for
    each of these: the running sum of all bytes at those under 255 gives the places.
    """
    gathered: list[np.ndarray] = []
    begin, k = 0, 0
    data = np.frombuffer(b"".join(texts), np.uint8)
    lengths = np.array([len(t) for t in texts], np.int64)
    starts = np.concatenate([[0], np.cumsum(lengths)])
    data = _FOLD_TABLE[data]
    while begin + 2 < len(data):
        stop = min(len(data), begin + PIECE)
        codes = _codes(data[begin:stop])
        places = np.arange(begin, stop - 2)
        of = np.searchsorted(starts, places, side="right") - 1
        inside = places + 2 < starts[of + 1]
        keys = codes[inside] << np.uint64(32) | of[inside].astype(np.uint64)
        keys.sort()
        gathered.append(keys[np.concatenate([[True], keys[1:] != keys[:-1]])] if len(keys) else keys)
        begin, k = stop - 2, k + 1
        if stop == len(data):
            break
    if not gathered:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint8)
    keys = gathered[0] if len(gathered) == 1 else np.unique(np.concatenate(gathered))
    trigrams, places = (keys >> np.uint64(32)).astype(np.int64), (keys & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.concatenate([[True], trigrams[1:] != trigrams[:-1]]) if len(keys) else np.zeros(0, bool)
    gaps = np.diff(places, prepend=0)
    gaps[first] = places[first]
    sizes = gaps // 255 + 1
    ends = np.cumsum(sizes)
    out = np.full(ends[-1] if len(ends) else 0, 255, np.uint8)
    out[ends - 1] = gaps % 255
    heads = np.flatnonzero(first)
    return trigrams[heads], np.concatenate([ends[heads[1:] - 1], ends[-1:]]), out


def places(gaps: bytes) -> np.ndarray:
    """The places that a posting's gap bytes give."""
    data = np.frombuffer(gaps, np.uint8)
    return np.cumsum(data, dtype=np.int64)[data < 255]
