"""The registered queries and their SQL."""

from __future__ import annotations

from .plans import aggregates, audio, composites, corpora, joins, labels, reports, rows, sequences, shapes, speakers, texts

QUERIES: dict = {}
SQL: dict = {}
for _part in (joins, sequences, aggregates, texts, rows, composites, corpora, labels, reports, audio, shapes, speakers):
    QUERIES |= _part.QUERIES
    SQL |= _part.SQL
FLAGSHIP = "jn1_map_speakers"
