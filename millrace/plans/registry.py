"""Every query of the engine by name, and the SQL it must agree with."""

from __future__ import annotations

from . import dedup, extra, nodes, relational, roundtrips, rules, scored, text

MODULES = [text, dedup, scored, extra, relational, nodes, rules, roundtrips]
QUERIES = {name: q for m in MODULES for name, q in m.QUERIES.items()}
SQL = {name: s for m in MODULES for name, s in m.SQL.items()}
