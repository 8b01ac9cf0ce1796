"""Queries over the driver's tables, a family a module: name -> (query, DuckDB SQL or None)."""

from __future__ import annotations

from . import attribution, corpus, ensemble, features, joins, levels, more, relational, tables, text, verdicts
from .sql import SQL

FAMILIES = (text, features, ensemble, corpus, more, relational, levels, verdicts, joins, attribution, tables)
QUERIES = {k: q for f in FAMILIES for k, (q, _) in f.ALL.items()}
ORACLES = {**{k: sql for f in FAMILIES for k, (_, sql) in f.ALL.items() if sql}, **SQL}
