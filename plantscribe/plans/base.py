"""What the registered queries share: table access and SQL fragments that mirror the column functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..functions import text as X

Query = Callable[[SparkSession, str], DataFrame]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Registry:
    """Queries and their SQL by name."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, sql: str | None = None) -> Callable[[Query], Query]:
        def put(f: Query) -> Query:
            self.queries[f.__name__] = f
            if sql:
                self.sql[f.__name__] = sql
            return f

        return put


def sql_list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


WORDS_SQL = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def tokens_sql(text: str) -> str:
    return rf"list_filter(regexp_extract_all(lower(coalesce({text}, '')), '[a-zA-Z0-9_\-]+'), lambda x: length(x) > 1 AND NOT list_contains({sql_list(X.INDEX_STOP_WORDS)}, x))"


#: Chunks of documents by windows of 768 words with 64 overlap.
CHUNKS_SQL = f"""d AS (SELECT doc_id, text, {WORDS_SQL} AS w FROM documents),
s AS (SELECT doc_id, text, w, len(w) AS n, unnest(CASE WHEN len(w) <= 768 THEN [0] ELSE range(0, len(w) - 64, 704) END) AS s FROM d WHERE len(w) > 0),
chunks AS (SELECT doc_id, (s // 704)::INT AS chunk_index, CASE WHEN n <= 768 THEN text ELSE array_to_string(w[s + 1:s + 768], ' ') END AS text, least(768, n - s)::INT AS token_count FROM s)"""
POSTINGS_SQL = f"""{CHUNKS_SQL},
t AS (SELECT doc_id, chunk_index, {tokens_sql('text')} AS t FROM chunks),
postings AS (SELECT doc_id, chunk_index, term, count(*) / any_value(n) AS tf FROM (SELECT doc_id, chunk_index, len(t) AS n, unnest(t) AS term FROM t) GROUP BY doc_id, chunk_index, term)"""
