"""All queries of the library's own operators, with SQL where it can express them."""

from __future__ import annotations

from blockalloc.jobs import blocks, cues, integrity, statistics

ALL = {**statistics.QUERIES, **blocks.QUERIES, **cues.QUERIES, **integrity.QUERIES}
QUERIES = {name: f for name, (f, _) in ALL.items()}
SQL = {name: sql for name, (_, sql) in ALL.items() if sql}
