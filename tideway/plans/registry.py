"""All registered queries of the flow engine: name to (function, SQL or None)."""

from tideway.plans import embedding_queries, flow_queries, stream_queries

QUERIES = {**flow_queries.QUERIES, **embedding_queries.QUERIES, **stream_queries.QUERIES}
