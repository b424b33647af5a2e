"""The ``where`` language over units: clauses ``key=value``; unlike keys must all hold, equal keys any."""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

EXACT = {"project": "project", "language": "language", "kind": "kind"}
GLOBS = {"name": "name", "scope": "scope", "path": "relative_path"}


def glob_pattern(glob: str, path: bool = False) -> str:
    """An anchored regular expression; in paths ``*`` stays within a part and ``**`` does not."""
    out, i = [], 0
    while i < len(glob):
        if glob[i] == "*":
            double = glob[i : i + 2] == "**"
            out.append(".*" if double or not path else "[^/]*")
            i += 1 + double
            continue
        out.append(("[^/]" if path else ".") if glob[i] == "?" else re.escape(glob[i]))
        i += 1
    return "^" + "".join(out) + "$"


def parse(clauses: Iterable[str]) -> Column:
    """The filter of all clauses; raises on a clause without ``=`` and on unknown keys."""
    by_key: dict[str, list[Column]] = {}
    for clause in clauses:
        key, eq, value = clause.partition("=")
        if not eq:
            raise ValueError(f"a clause is key=value, not {clause!r}")
        if key in EXACT:
            one = F.col(EXACT[key]) == value
        elif key in GLOBS:
            one = F.col(GLOBS[key]).rlike(glob_pattern(value, key == "path"))
        elif key == "min_nodes":
            one = F.col("body_node_count") >= int(value)
        else:
            raise ValueError(f"unknown key {key!r}; known: {', '.join([*EXACT, *GLOBS, 'min_nodes'])}")
        by_key.setdefault(key, []).append(F.coalesce(one, F.lit(False)))
    return reduce(lambda p, q: p & q, (reduce(lambda p, q: p | q, any_) for any_ in by_key.values()), F.lit(True))
