"""Boolean trigram queries from regular expressions, in the manner of code search engines.

A query is a tree of ``("and", ...)``, ``("or", ...)``, a trigram, or ``ALL`` for "says nothing".  A text that matches the
expression makes the query true; the reverse need not hold.
"""

from __future__ import annotations

import itertools
from re import _parser as parser

ALL = ("and",)
# Sets of alternative strings that grow beyond this are given up for what is known of them so far.
MOST = 64
# A character class with more members says nothing.
MANY = 8


def _all(parts) -> tuple:
    parts = [p for p in dict.fromkeys(parts) if p != ALL]
    flat = [q for p in parts for q in (p[1:] if p[0] == "and" else [p])]
    flat = list(dict.fromkeys(flat))
    return flat[0] if len(flat) == 1 else ("and", *flat)


def _any(parts) -> tuple:
    parts = list(dict.fromkeys(parts))
    if not parts or ALL in parts:
        return ALL
    # What asks for all that another part asks for, and more, adds nothing.
    needs = [frozenset(p[1:] if p[0] == "and" else [p]) for p in parts]
    parts = [p for p, n in zip(parts, needs, strict=True) if not any(m < n for m in needs)]
    return parts[0] if len(parts) == 1 else ("or", *parts)


def _of_strings(strings: set[str]) -> tuple:
    """True for texts that hold one of the strings."""
    return _any([_all([("gram", s[i : i + 3]) for i in range(len(s) - 2)]) if len(s) >= 3 else ALL for s in sorted(strings)])


def _charset(items) -> set[str] | None:
    found: set[str] = set()
    for kind, value in items:
        if str(kind) == "LITERAL":
            found.add(chr(value).lower())
        elif str(kind) == "RANGE" and value[1] - value[0] < MANY:
            found |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
        else:
            return None
        if len(found) > MANY:
            return None
    return found


def _walk(nodes) -> tuple[set[str] | None, tuple]:
    """The strings (lower case) that the nodes match, if they are few, and the query for what lies before."""
    exact: set[str] | None = {""}
    query = ALL
    for kind, value in nodes:
        kind = str(kind)
        inner: set[str] | None = None
        more = ALL
        if kind == "LITERAL":
            inner = {chr(value).lower()}
        elif kind == "IN":
            inner = _charset(value)
        elif kind == "SUBPATTERN":
            inner, more = _walk(value[3])
        elif kind == "BRANCH":
            branches = [_walk(b) for b in value[1]]
            if all(e is not None and q == ALL for e, q in branches):
                inner = set().union(*(e for e, _ in branches))
            else:
                more = _any([_all([q, _of_strings(e) if e is not None else ALL]) for e, q in branches])
        elif kind in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
            low, high, body = value
            e, q = _walk(body)
            if low == 0 and int(high) == 1 and e is not None and q == ALL:
                inner = e | {""}
            elif low >= 1 and e is not None:
                more = q
                if low <= 8:
                    inner = {"".join(x) for x in itertools.islice(itertools.product(sorted(e), repeat=low), MOST + 1)}
                    if int(high) != low:  # what follows may be more of the same
                        exact, query, inner = _join(exact, query, inner, more)
                        query = _all([query, _of_strings(exact)]) if exact is not None else query
                        exact = None
                        continue
            elif low >= 1:
                more = q
        elif kind == "AT":
            inner = {""}
        exact, query, _ = _join(exact, query, inner, more)
    return exact, query


def _join(exact, query, inner, more):
    """Append what a node matches to what came before."""
    query = _all([query, more])
    if inner is None or len(inner) > MOST:
        if exact is not None:
            query = _all([query, _of_strings(exact)])
        return None, query, None
    if exact is None:
        return set(inner) if inner != {""} else None, query, inner
    joined = {a + b for a in exact for b in inner}
    if len(joined) > MOST:
        query = _all([query, _of_strings(exact)])
        return set(inner), query, inner
    return joined, query, inner


def trigram_query(pattern: str) -> tuple:
    """The query of a regular expression, over lower-case trigrams; ``ALL`` if no trigram is mandatory."""
    exact, query = _walk(parser.parse(pattern))
    return _all([query, _of_strings(exact)]) if exact is not None else query


def trigrams(query: tuple) -> set[str]:
    if query[0] == "gram":
        return {query[1]}
    return set().union(*(trigrams(q) for q in query[1:])) if len(query) > 1 else set()
