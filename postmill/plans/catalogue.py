"""All queries outside the llm subpackage."""

from __future__ import annotations

from postmill.plans import board_queries, listing_queries, pipeline_queries

assert board_queries.query is listing_queries.query  # they register in the same tables

QUERIES = {**listing_queries.QUERIES, **pipeline_queries.QUERIES}
ORACLES = {**listing_queries.ORACLES, **pipeline_queries.ORACLES}
FLAGSHIP = listing_queries.result_rows_37
