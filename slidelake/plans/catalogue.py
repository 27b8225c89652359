"""All core queries by name, with their equivalent SQL."""

from __future__ import annotations

from slidelake.operators.common_units import source_report, units_found
from slidelake.operators.instants import instants_found
from slidelake.operators.packed_values import packed_found
from slidelake.operators.schema_drift import changes_found, records_table
from slidelake.plans import codestream_queries, serve_queries, text_queries, tile_queries

FLAGSHIP = "contiguous_runs"

QUERIES = {
    "p1_found": units_found,
    "p1_sources": source_report,
    "p2_found": packed_found,
    "p3_found": changes_found,
    "p3_table": records_table,
    "p5_found": instants_found,
    **tile_queries.registry.queries,
    **text_queries.registry.queries,
    **codestream_queries.registry.queries,
    **serve_queries.registry.queries,
}

ORACLE: dict[str, str] = {**tile_queries.registry.oracle, **text_queries.registry.oracle, **codestream_queries.registry.oracle, **serve_queries.registry.oracle}
