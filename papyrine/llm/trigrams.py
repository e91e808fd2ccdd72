"""Boolean trigram queries that hold for every match of a regular expression (after Cox, 'Regular Expression Matching with a Trigram Index', 2012).

A query is ``ANY``, a trigram (three lower-case bytes), or ("and" | "or", [queries]).
"""

from __future__ import annotations

from itertools import product
from re import _constants as C  # the library's own parser; patterns are ours, ASCII only
from re import _parser

ANY = None
#: Alternatives that are followed exactly; above it what is known so far goes into the query.
MOST = 64


def both(*queries):
    flat = list(dict.fromkeys(q for q in queries if q is not ANY))
    return ANY if not flat else flat[0] if len(flat) == 1 else ("and", tuple(flat))


def either(queries):
    flat = list(dict.fromkeys(queries))
    return ANY if ANY in flat or not flat else flat[0] if len(flat) == 1 else ("or", tuple(flat))


def of_strings(strings) -> object:
    """At least one of the strings occurs."""
    return either(both(*(s[i : i + 3] for i in range(len(s) - 2))) if len(s) > 2 else ANY for s in strings)


def _chars(item) -> set[str] | None:
    """The characters a set stands for, folded; None if they are many."""
    out: set[str] = set()
    for op, value in item:
        if op is C.LITERAL:
            out.add(chr(value).lower())
        elif op is C.RANGE and value[1] - value[0] < 4:
            out |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
        else:
            return None
    return out if len(out) <= 4 else None


def _exact(node) -> set[str] | None:
    """All strings that a small subpattern matches, or None."""
    out = {""}
    for op, value in node:
        if op is C.LITERAL:
            some = {chr(value).lower()}
        elif op is C.IN:
            some = _chars(value)
        elif op is C.SUBPATTERN:
            some = _exact(value[3])
        elif op is C.BRANCH:
            parts = [_exact(x) for x in value[1]]
            some = None if None in parts else set().union(*parts)
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT) and value[1] is not C.MAXREPEAT and value[1] <= 4:
            one = _exact(value[2])
            some = one and {"".join(x) for n in range(value[0], value[1] + 1) for x in product(sorted(one), repeat=n)} if not one or len(one) ** value[1] <= MOST else None
        else:
            some = None
        if some is None or len(out) * len(some) > MOST:
            return None
        out = {a + b for a in out for b in some}
    return out


def _query(node):
    queries, known = [], {""}
    for item in node:
        exact = _exact([item])
        if exact is not None and len(known) * len(exact) <= MOST:
            known = {a + b for a in known for b in exact}
            continue
        queries.append(of_strings(known))
        known = {""} if exact is None else exact
        op, value = item
        if exact is not None:
            continue
        if op is C.SUBPATTERN:
            queries.append(_query(value[3]))
        elif op is C.BRANCH:
            queries.append(either([_query(x) for x in value[1]]))
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT) and value[0] > 0:
            queries.append(_query(value[2]))
            if (one := _exact(value[2])) is not None and len(one) ** min(value[0], 3) <= MOST:
                queries.append(of_strings({"".join(x) for x in product(sorted(one), repeat=min(value[0], 8))} if len(one) ** min(value[0], 8) <= MOST else {""}))
    queries.append(of_strings(known))
    return both(*queries)


def query(pattern: str):
    """What any match of ``pattern`` must contain; ANY if nothing is mandatory."""
    return _query(_parser.parse(pattern))


def trigrams(q) -> set[str]:
    return set() if q is ANY else {q} if isinstance(q, str) else set().union(*map(trigrams, q[1]))
