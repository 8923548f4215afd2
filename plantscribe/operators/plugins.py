"""Scorers, judges and parsers that a caller brings, and what holds where one fails or is missing.

A plug-in is a plain function of values; it runs where the rows are and its failure stays with the call: the row keeps a null and, if asked
for, the message, and the others go on. A question's pool or a text is one call, both bounded by the operators before.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions import mime as M

Scorer = Callable[[str, list[str]], list[float]]
Judge = Callable[[str, str], bool]
Parser = Callable[[str], list[str]]


def called(rows: DataFrame, inputs: list[str], function: Callable[..., Any], name: str, kind: str, arrow: pa.DataType) -> DataFrame:
    """``rows`` with ``name``, what the function gives for the inputs, and ``name_error``, why it gave nothing."""
    at = [rows.columns.index(c) for c in inputs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, errors = [], []
            for args in zip(*(batch.column(k).to_pylist() for k in at), strict=True):
                try:
                    value, error = function(*args), None
                    pa.array([value], arrow)
                except Exception as failure:  # noqa: BLE001 - whatever a plug-in does, the other rows go on
                    value, error = None, f"{type(failure).__name__}: {failure}"
                values.append(value)
                errors.append(error)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, arrow), pa.array(errors, pa.string())], [*batch.schema.names, name, f"{name}_error"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{schema}, `{name}` {kind}, `{name}_error` string")


def rerank(pool: DataFrame, keys: list[str], scorer: Scorer | None = None, query_text: str = "query_text", text: str = "text", score: str = "score") -> DataFrame:
    """``query_id, keys, rerank_score, final_rank, by_model``: candidates of a question by the model's score of the question and all its texts.

    Without a model, and for a question on which it fails or gives another number of scores, the retrieval score and its order hold.
    """
    if scorer is None:
        told = pool.select("query_id", *keys, F.col(score).cast("double").alias("rerank_score"), F.lit(False).alias("by_model"))
    else:
        def whole(question: str, texts: list[str]) -> list[float]:
            found = [float(x) for x in scorer(question, texts)]
            if len(found) != len(texts):
                raise ValueError(f"{len(found)} scores for {len(texts)} texts")
            return found

        each = F.struct(F.col(score).cast("double").alias("score"), *keys, F.col(text).alias("text"))
        asked = pool.groupBy("query_id", query_text).agg(F.sort_array(F.collect_list(each), asc=False).alias("_pool"))  # as many as the pool's cap
        asked = called(asked.withColumn("_texts", F.col("_pool.text")), [query_text, "_texts"], whole, "_model", "array<double>", pa.list_(pa.float64()))
        rows = asked.select("query_id", "_model", F.posexplode("_pool").alias("_k", "_c"))
        model = F.get("_model", F.col("_k"))
        told = rows.select("query_id", *(F.col(f"_c.{k}").alias(k) for k in keys), F.coalesce(model, "_c.score").alias("rerank_score"), model.isNotNull().alias("by_model"))
    order = W.partitionBy("query_id").orderBy(F.desc("rerank_score"), *keys)
    return told.withColumn("final_rank", F.row_number().over(order))


def judged(rows: DataFrame, judge: Judge | None, question: str = "query_text", text: str = "text", name: str = "relevant") -> DataFrame:
    """``rows`` with the judge's verdict; no judge, a failing one and one that gives no truth value count as false."""
    if judge is None:
        return rows.withColumn(name, F.lit(False))
    found = called(rows, [question, text], judge, name, "boolean", pa.bool_())
    return found.withColumn(name, F.coalesce(name, F.lit(False))).drop(f"{name}_error")


def paragraphs_of(text: str) -> list[str]:
    return [p for x in text.replace("\r\n", "\n").split("\n\n") if (p := x.strip(" \t\r\n"))]


class Parsers:
    """Parsers by type; ``add`` extends the registry or replaces one. Types without a parser fail with a message."""

    def __init__(self) -> None:
        self.known: dict[str, Parser] = {kind: paragraphs_of for kind in (*M.PARSERS["text"], *M.PARSERS["markdown"])}

    def add(self, types: tuple[str, ...], parser: Parser) -> Parsers:
        self.known |= dict.fromkeys(types, parser)
        return self

    def parse(self, docs: DataFrame, key: str = "doc_id", mime: str = "mime", text: str = "text") -> DataFrame:
        """``key, status, n_chunks, error, chunks``: CHUNKED with the texts of the chunks, or FAILED with why; the other documents go on."""
        known = self.known

        def run(kind: str | None, body: str | None) -> list[str]:
            if kind not in known:
                raise LookupError(f"no parser for {kind}")
            return known[kind](body or "")

        found = called(docs.select(key, mime, text), [mime, text], run, "chunks", "array<string>", pa.list_(pa.string()))
        failed = F.col("chunks_error").isNotNull()
        error = F.regexp_replace("chunks_error", "^LookupError: ", "")
        return found.select(key, F.when(failed, "FAILED").otherwise("CHUNKED").alias("status"), F.greatest(F.size("chunks"), F.lit(0)).alias("n_chunks"), error.alias("error"), F.coalesce("chunks", F.array().cast("array<string>")).alias("chunks"))


def chunk_rows(parsed: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key, chunk_index, text`` of what ``Parsers.parse`` gives."""
    return parsed.select(key, F.posexplode("chunks").alias("chunk_index", "text"))
