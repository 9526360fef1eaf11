"""Boolean trigram queries from regular expressions.

A query is in conjunctive form: every clause must hold, and a clause holds if one of its
alternatives has all its trigrams in the text. It is a necessary condition for a match, over
lower-cased text. Strings that the expression must contain are followed as sets of
alternatives; where a part matches too many different strings, the strings up to there are
closed into a clause and a new one begins.
"""

from __future__ import annotations

import itertools
import re
from re import _constants as C
from re import _parser

#: Different strings followed at once; more close a clause.
MOST_STRINGS = 32

Clause = frozenset[frozenset[str]]


def _literals(node, fold: bool) -> list[str] | None:
    """All strings a node can match, lower-cased, or None if they are too many."""
    op, value = node
    if op is C.LITERAL:
        return [chr(value).lower()]
    if op is C.IN and all(o in (C.LITERAL, C.RANGE) for o, _ in value):
        found = set()
        for o, v in value:
            codes = [v] if o is C.LITERAL else range(v[0], v[1] + 1)
            if len(codes) > 2 * MOST_STRINGS:
                return None
            found |= {chr(c).lower() for c in codes}
        return sorted(found) if len(found) <= MOST_STRINGS else None
    if op is C.SUBPATTERN:
        return _sequence(value[3], fold)
    if op is C.BRANCH:
        parts = [_sequence(branch, fold) for branch in value[1]]
        return None if None in parts else sorted({s for p in parts for s in p})
    if op in (C.MAX_REPEAT, C.MIN_REPEAT):
        low, high, inner = value
        once = _sequence(inner, fold)
        if once is None or high is C.MAXREPEAT or high > 3:
            return None
        return sorted({"".join(x) for n in range(low, high + 1) for x in itertools.product(once, repeat=n)})
    if op is C.AT:
        return [""]
    return None


def _sequence(nodes, fold: bool) -> list[str] | None:
    out = [""]
    for node in nodes:
        found = _literals(node, fold)
        if found is None or len(out) * len(found) > MOST_STRINGS:
            return None
        out = [a + b for a in out for b in found]
    return out


def _clause(strings: list[str]) -> set[Clause]:
    """The clause of strings of which one must occur; none if one of them has no trigram."""
    sets = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings}
    weakest = frozenset(a for a in sets if not any(b < a for b in sets))
    return {weakest} if all(sets) else set()


def _walk(nodes, done: set[Clause]) -> list[str]:
    """Adds the clauses of a sequence to ``done``; returns the strings still open at its end."""
    open_strings = [""]
    for node in nodes:
        found = _literals(node, True)
        if found is not None and len(open_strings) * len(found) <= MOST_STRINGS:
            open_strings = sorted({a + b for a in open_strings for b in found})
            continue
        done |= _clause(open_strings)
        open_strings = [""]
        op, value = node
        if found is not None:
            open_strings = found
        elif op is C.SUBPATTERN:
            open_strings = _walk(value[3], done)
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT) and value[0] >= 1:
            done |= _clause(_walk(value[2], done))
        elif op is C.BRANCH:
            done |= _either([trigram_clauses_of(b) for b in value[1]])
    return open_strings


def _either(branches: list[set[Clause]]) -> set[Clause]:
    """Clauses that hold if all clauses of one branch do: one alternative per combination."""
    if not all(branches):
        return set()
    chosen = [min(b, key=lambda clause: (len(clause), sorted(map(sorted, clause)))) for b in branches]
    return {frozenset(itertools.chain(*chosen))}


def trigram_clauses_of(nodes) -> set[Clause]:
    done: set[Clause] = set()
    return done | _clause(_walk(nodes, done))


def trigram_query(pattern: str) -> list[list[list[str]]]:
    """Clauses of alternatives of trigrams, all sorted; empty if no trigram is mandatory."""
    clauses = trigram_clauses_of(_parser.parse(pattern, re.ASCII))
    return sorted(sorted(sorted(a) for a in clause) for clause in clauses)
