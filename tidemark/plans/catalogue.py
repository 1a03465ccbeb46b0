"""All registered queries and their SQL counterparts."""

from tidemark.plans import evaluation_queries, market_queries, pipeline_queries, text_queries

PARTS = (market_queries, text_queries, evaluation_queries, pipeline_queries)
QUERIES: dict = {name: query for part in PARTS for name, query in part.QUERIES.items()}
ORACLES: dict = {name: sql for part in PARTS for name, sql in part.ORACLES.items()}
