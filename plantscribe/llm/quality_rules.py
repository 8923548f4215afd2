"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document. The ledger row keeps the measurements and one bit per failed rule;
a policy is a versioned mask over those bits, so that verdicts, policy changes and ablations read the small ledger
and never the texts again.

Null text counts as no words; empty texts fail ``few_words``. Repeated rows are judged alike, each on its own. Texts of any length are
measured whole, in their own task. A measure that equals a rule's bound passes. An empty table gives an empty ledger, and ablations without
rows. Other columns of the input are left out of the ledger.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import split_words

SYMBOLS = "#*$%&|<>"
UPPER, LETTERS = (bytes(c for c in range(128) if chr(c).isalpha() and (chr(c).isupper() or not up)) for up in (True, False))
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper", "n_letters")

#: name -> failure over the measurements. The position is the bit; append, never reorder: stored ledgers depend on it.
RULES: dict[str, str] = {
    "few_words": "n_words < 10",
    "repeated_windows": "100 * n_repeat_words > 20 * n_words",
    "symbols": "10 * n_symbols > 3 * n_words",
    "shouting": "n_letters >= 20 AND 2 * n_upper > n_letters",
    "repeated_lines": "n_lines >= 4 AND 2 * n_dup_lines > n_lines",
    "long_words": "word_chars > 25 * n_words",
}
BITS = {name: 1 << k for k, name in enumerate(RULES)}
#: version -> rules that reject. The base rules reject in every version.
BASE = ("few_words", "repeated_windows")
POLICIES: dict[str, tuple[str, ...]] = {
    "base": BASE,
    "v1": (*BASE, "symbols", "shouting", "repeated_lines", "long_words"),
}


def mask(rules) -> int:
    return sum(BITS[x] for x in rules)


def repeated_window_words(words: list[bytes], width: int = 5) -> int:
    """Words inside windows of ``width`` words that the text has twice or more; exact, by ranking windows of doubling width."""
    n = len(words)
    if n <= width:
        return 0
    known: dict[bytes, int] = {}
    word = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, n)
    rank, have = word, 1
    while have < width:
        step = min(have, width - have)
        pair = rank[:-step] * (int(rank.max()) + 1) + rank[step:]
        rank, have = np.unique(pair, return_inverse=True)[1], have + step
    twice = np.bincount(rank)[rank] > 1
    covered = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(covered, at, 1)
    np.add.at(covered, at + width, -1)
    return int((np.cumsum(covered)[:n] > 0).sum())


def _measure(text: str | None) -> tuple[int, ...]:
    text = text or ""
    raw, words = text.encode("utf-8", "replace"), split_words(text)
    lines = [x for x in text.split("\n") if x.encode("utf-8", "replace").strip()]
    return (
        len(words),
        len(text) - (len(raw) - len(raw.translate(None, b" \t\n\v\f\r"))),
        sum(map(text.count, SYMBOLS)),
        len(lines),
        len(lines) - len(set(lines)),
        repeated_window_words(words),
        len(raw) - len(raw.translate(None, UPPER)),
        len(raw) - len(raw.translate(None, LETTERS)),
    )


def _measure_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = list(zip(*map(_measure, (x.as_py() for x in batch.column(1))), strict=True)) or [()] * len(MEASURES)
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in found)], ["doc_id", *MEASURES])


def ledger(docs: DataFrame) -> DataFrame:
    """``(doc_id, text)`` -> measurements and ``fail_bits``; one pass over the texts, no shuffle."""
    measured = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_measure_batches, "doc_id long, " + ", ".join(f"{m} long" for m in MEASURES))
    bits = [F.when(F.expr(failed), F.lit(BITS[name]).cast("long")).otherwise(F.lit(0).cast("long")) for name, failed in RULES.items()]
    total: Column = bits[0]
    for b in bits[1:]:
        total = total.bitwiseOR(b)
    return measured.withColumn("fail_bits", total)


def stored_ledger(docs: DataFrame, path: str) -> DataFrame:
    """The ledger, written to ``path`` once and read back: policies and ablations need nothing else."""
    ledger(docs).write.parquet(path)
    return docs.sparkSession.read.parquet(path)


def apply_policy(rows: DataFrame, version: str = "v1") -> DataFrame:
    """``base_failed`` and ``kept`` from stored bits only."""
    failed = lambda rules: F.col("fail_bits").bitwiseAND(F.lit(mask(rules)).cast("long")) != 0
    return rows.withColumns({"base_failed": failed(BASE), "kept": ~failed({*BASE, *POLICIES[version]})})


def ablations(rows: DataFrame, version: str = "v1") -> DataFrame:
    """For each rule of a policy: rows that fail it, rows that fail only it (kept again without it), and what any rejects.

    One bitwise aggregation over the ledger: ledger rows are first counted by bit pattern (at most 2**rules of them).
    """
    active = F.col("fail_bits").bitwiseAND(F.lit(mask(POLICIES[version])).cast("long"))
    patterns = rows.groupBy(active.alias("bits")).agg(F.count("*").alias("n"))
    each = F.explode(F.array(*(F.struct(F.lit(x).alias("rule"), F.lit(BITS[x]).cast("long").alias("bit")) for x in POLICIES[version])))
    return (
        patterns.withColumn("r", each)
        .groupBy("r.rule")
        .agg(
            F.sum(F.when(F.col("bits").bitwiseAND(F.col("r.bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
            F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("n_only"),
            F.sum(F.when(F.col("bits") != 0, F.col("n")).otherwise(0)).alias("n_rejected"),
        )
    )


LEDGER_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, w FROM d),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS win, len(w) AS n FROM p WHERE i + 4 <= len(w)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS c FROM g) WHERE c > 1),
c AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM r, (SELECT unnest([0, 1, 2, 3, 4]) AS k) GROUP BY doc_id),
l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d),
s AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
m AS (SELECT d.doc_id, len(w) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
  len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0) AS n_dup_lines,
  coalesce(n_repeat_words, 0) AS n_repeat_words, len(regexp_extract_all(t, '[A-Z]')) AS n_upper, len(regexp_extract_all(t, '[A-Za-z]')) AS n_letters
  FROM d LEFT JOIN s USING (doc_id) LEFT JOIN c USING (doc_id)),
b AS (SELECT *, (n_words < 10)::BIGINT + 2 * (100 * n_repeat_words > 20 * n_words)::BIGINT + 4 * (10 * n_symbols > 3 * n_words)::BIGINT
  + 8 * (n_letters >= 20 AND 2 * n_upper > n_letters)::BIGINT + 16 * (n_lines >= 4 AND 2 * n_dup_lines > n_lines)::BIGINT + 32 * (word_chars > 25 * n_words)::BIGINT AS fail_bits FROM m)
"""
_JUDGED = "SELECT doc_id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_upper, n_letters, fail_bits, (fail_bits & 3) <> 0 AS base_failed, "
ORACLE_SQL = LEDGER_SQL + _JUDGED + "fail_bits = 0 AS kept FROM b"
BASE_SQL = LEDGER_SQL + _JUDGED + "(fail_bits & 3) = 0 AS kept FROM b"
ABLATION_SQL = LEDGER_SQL + """SELECT rule, count(*) FILTER (fail_bits & bit <> 0) AS n_failed, count(*) FILTER (fail_bits = bit) AS n_only, count(*) FILTER (fail_bits <> 0) AS n_rejected
FROM b, (SELECT unnest(['few_words', 'repeated_windows', 'symbols', 'shouting', 'repeated_lines', 'long_words']) AS rule, unnest([1, 2, 4, 8, 16, 32]) AS bit) GROUP BY rule"""
