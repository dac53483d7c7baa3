"""The queries of this subpackage and the SQL that some of them can be held against."""

from __future__ import annotations

from . import q_chat, q_html, q_jpeg, q_lattice, q_mixing, q_packing, q_pii, q_quality, q_simhash, q_substrings

_MODULES = (q_chat, q_html, q_jpeg, q_lattice, q_mixing, q_packing, q_pii, q_quality, q_simhash, q_substrings)
QUERIES = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in _MODULES for name, sql in m.ORACLE_SQL.items()}
