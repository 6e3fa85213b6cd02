"""All queries of the library and their SQL."""

from __future__ import annotations

from jobscope.plans import job_queries, report_queries, stream_queries

QUERIES = {**report_queries.QUERIES, **job_queries.QUERIES, **stream_queries.QUERIES}
SQL = {**report_queries.SQL, **job_queries.SQL, **stream_queries.SQL}
