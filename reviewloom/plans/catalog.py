"""All registered queries, and the SQL that checks them."""

from reviewloom.plans import chat_queries, file_queries, retrieval_queries, review_queries, table_queries

_PARTS = (review_queries, retrieval_queries, chat_queries, table_queries, file_queries)

QUERIES = {name: query for part in _PARTS for name, query in part.QUERIES.items()}
SQL = {name: text for part in _PARTS for name, text in part.SQL.items()}
