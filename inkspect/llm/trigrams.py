"""Boolean trigram queries of regular expressions.

A query is a list of clauses that must all hold; a clause is a list of alternatives, each
a set of trigrams that must all occur in the lower-cased text. No clause means that the
expression has no mandatory trigram and every text must be scanned.
"""

from __future__ import annotations

import re

# Strings that a part of an expression may stand for before it is closed as a clause.
MOST_STRINGS = 32

Query = list[list[frozenset[str]]]
_parser = re._parser
_NEVER = object()


def _clause(strings: set[str]) -> Query:
    """Any of the strings occurs; nothing is known if one of them has no trigram."""
    sets = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings}
    if not sets or frozenset() in sets:
        return []
    return [sorted((s for s in sets if not any(o < s for o in sets)), key=sorted)]


def _node(op, arg) -> tuple[set[str] | None, Query]:
    """The exact strings of a parsed node if they are few, else None and its own clauses."""
    name = str(op)
    if name == "LITERAL":
        return {chr(arg).lower()}, []
    if name == "IN":
        found: set[str] = set()
        for kind, value in arg:
            if str(kind) == "LITERAL":
                found.add(chr(value).lower())
            elif str(kind) == "RANGE" and value[1] - value[0] < MOST_STRINGS:
                found |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
            else:
                return None, []
            if len(found) > MOST_STRINGS:
                return None, []
        return found, []
    if name == "SUBPATTERN":
        return _sequence(arg[-1])
    if name == "BRANCH":
        parts = [_sequence(p) for p in arg[1]]
        if all(strings is not None for strings, _ in parts):
            union = set().union(*(strings for strings, _ in parts))
            return (union, []) if len(union) <= MOST_STRINGS else (None, _clause(union))
        # An alternative of unknown strings stands for its rarest-looking clause.
        choices: list[frozenset[str]] = []
        for strings, query in parts:
            own = _clause(strings) if strings is not None else query
            if not own:
                return None, []
            choices += max(own, key=lambda c: min(map(len, c)))
        return None, [choices]
    if name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
        low, high, inner = arg
        strings, query = _sequence(inner)
        if (low, high) == (0, 1) and strings is not None:
            return strings | {""}, []
        if low == 0:
            return None, []
        if strings is not None and low == high and len(strings) ** low <= MOST_STRINGS:
            out = {""}
            for _ in range(low):
                out = {a + b for a in out for b in strings}
            return out, []
        return None, query + (_clause(strings) if strings is not None else [])
    return None, []


def _sequence(nodes) -> tuple[set[str] | None, Query]:
    """Concatenation: runs of parts with known strings are joined, unknown parts end a run."""
    query: Query = []
    run: set[str] = {""}
    whole = True
    for op, arg in nodes:
        strings, own = _node(op, arg)
        if strings is not None and len(strings) * len(run) <= MOST_STRINGS:
            run = {a + b for a in run for b in strings}
            continue
        query += _clause(run) + own
        whole, run = False, strings if strings is not None else {""}
    if whole:
        return run, query
    return None, query + _clause(run)


def trigram_query(pattern: str) -> Query:
    strings, query = _sequence(_parser.parse(pattern))
    return query + (_clause(strings) if strings is not None else [])
