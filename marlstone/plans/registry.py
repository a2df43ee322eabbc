"""All queries of the library by name, and their SQL."""

from marlstone.plans import data_queries, lookup_queries, structure_queries, text_queries

QUERIES = text_queries.QUERIES | data_queries.QUERIES | structure_queries.QUERIES | lookup_queries.QUERIES
SQL = text_queries.SQL | data_queries.SQL | structure_queries.SQL | lookup_queries.SQL
