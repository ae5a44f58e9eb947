"""All queries of the subpackage and their DuckDB SQL."""

from quadrille.llm import queries_corpus, queries_native, queries_pii, queries_python

QUERIES = {**queries_native.QUERIES, **queries_python.QUERIES, **queries_pii.QUERIES, **queries_corpus.QUERIES}
ORACLE_SQL = {**queries_native.ORACLE_SQL, **queries_corpus.ORACLE_SQL}
