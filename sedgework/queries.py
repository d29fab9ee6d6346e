"""All queries of the library's own operators, and their SQL."""

from __future__ import annotations

from sedgework.plans import board_queries, column_queries, date_queries, entry_queries, label_queries, markdown_queries, nearest_queries, page_queries, record_queries, parse_queries, shape_queries, skill_queries, text_queries, tracker_queries, wish_queries

FLAGSHIP = "bullet_quality"
_ALL = (text_queries.R, record_queries.R, date_queries.R, shape_queries.R, skill_queries.R, label_queries.R, parse_queries.R, board_queries.R, wish_queries.R, entry_queries.R, column_queries.R, page_queries.R, markdown_queries.R, tracker_queries.R, nearest_queries.R)
QUERIES = {name: q for r in _ALL for name, q in r.queries.items()}
SQL = {name: q for r in _ALL for name, q in r.sql.items()}
