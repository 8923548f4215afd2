"""Answers of language models as data: citation markers, noisy JSON, reports and rendered lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import text as X
from .ranking import positions

SOURCE_MARKER = r"(?i)\[source_(\d+)\]"
CHUNK_MARKER = r"\[\[chunk:([^\]]+)\]\]"
# Severities of gaps.
SEVERITIES = ("CRITICAL", "MAJOR", "MINOR")
RELATION = "array<struct<source_tag:string,source_type:string,relation_type:string,target_tag:string,target_type:string,confidence:double>>"
GAP = "array<struct<clause:string,description:string,severity:string>>"
# Fixed value: relations of less confidence are tentative.
TENTATIVE_BELOW = 0.6


def source_markers(answers: DataFrame, keys: list[str], answer: str = "answer") -> DataFrame:
    """``keys, pos, n``: numbers of ``[source_N]`` markers in order."""
    found = F.regexp_extract_all(F.col(answer), F.lit(SOURCE_MARKER), F.lit(1))
    return answers.select(*keys, F.posexplode(found).alias("pos", "_n")).select(*keys, "pos", F.expr("try_cast(_n as int)").alias("n"))


def citation_report(answers: DataFrame, keys: list[str], answer: str = "answer", sources: str = "n_sources") -> DataFrame:
    """Distinct valid markers, occurrences of markers beyond the sources, and the flag; answers without markers are OK."""
    numbers = F.transform(F.regexp_extract_all(F.col(answer), F.lit(SOURCE_MARKER), F.lit(1)), lambda n: n.try_cast("int"))
    good = lambda n: F.coalesce((n >= 1) & (n <= F.col(sources)), F.lit(False))
    valid = F.size(F.array_distinct(F.filter(numbers, good)))
    bad = F.size(F.filter(numbers, lambda n: ~good(n)))
    return answers.select(*keys, valid.alias("n_valid"), bad.alias("n_hallucinated"), F.when(bad > 0, "CITATION_WARNING").otherwise("OK").alias("flag"))


def drop_invalid_markers(answer: Column, sources: Column) -> Column:
    """The answer without markers beyond its sources: text between markers and kept markers, in turn."""
    parts = F.split(answer, SOURCE_MARKER.replace("(\\d+)", "\\d+"), -1)
    marks = F.regexp_extract_all(answer, F.lit(SOURCE_MARKER), F.lit(0))
    kept = F.transform(marks, lambda m: F.when(F.coalesce(F.regexp_extract(m, r"\d+", 0).try_cast("int").between(F.lit(1), sources), F.lit(False)), m).otherwise(F.lit("")))
    return F.concat(F.element_at(parts, 1), F.array_join(F.zip_with(kept, F.slice(parts, 2, F.size(parts)), lambda m, t: F.concat(m, t)), ""))


def resolve_citations(answers: DataFrame, ranked: DataFrame, keys: list[str]) -> DataFrame:
    """Markers joined to the ranked chunk they name; null where none has that rank."""
    return source_markers(answers, keys).join(ranked.withColumnRenamed("rank", "n"), [*keys, "n"], "left")


def chunk_citations(answers: DataFrame, retrieved: DataFrame, keys: list[str], answer: str = "answer") -> DataFrame:
    """First occurrence of each ``[[chunk:id]]`` that was retrieved, with its footnote number."""
    ids = F.array_distinct(F.regexp_extract_all(F.col(answer), F.lit(CHUNK_MARKER), F.lit(1)))
    named = answers.select(*keys, F.posexplode(ids).alias("pos", "chunk_id")).join(retrieved.select(*keys, "chunk_id").distinct(), [*keys, "chunk_id"], "left_semi")
    return named.withColumn("footnote", F.row_number().over(W.partitionBy(*keys).orderBy("pos")))


def render_footnotes(answer: Column, ids: Column) -> Column:
    """``[[chunk:id]]`` becomes its footnote number, unknown ones go; the sources are listed below."""
    numbered = F.aggregate(F.transform(ids, lambda x, k: F.struct(x.alias("id"), (k + 1).alias("n"))), answer, lambda t, x: F.replace(t, F.concat(F.lit("[[chunk:"), x["id"], F.lit("]]")), F.concat(F.lit("["), x["n"].cast("string"), F.lit("]"))))
    clean = F.regexp_replace(numbered, r"\[\[chunk:[^\]]*\]\]", "")
    listed = F.array_join(F.transform(ids, lambda x, k: F.concat(F.lit("["), (k + 1).cast("string"), F.lit("] "), x)), "\n")
    return F.when(F.size(ids) > 0, F.concat(clean, F.lit("\n\nSources:\n"), listed)).otherwise(clean)


def relation_items(answers: DataFrame, keys: list[str], answer: str = "answer") -> DataFrame:
    """Relations in noisy answers: five keys needed, confidence 1 by default and kept within 0..1, weak ones tentative."""
    items = answers.select(*keys, F.posexplode(F.from_json(X.noisy_json(F.col(answer)), RELATION)).alias("pos", "r")).select(*keys, "pos", "r.*")
    needed = F.lit(True)
    for c in ("source_tag", "source_type", "relation_type", "target_tag", "target_type"):
        needed = needed & F.col(c).isNotNull() & (F.col(c) != "")
    kept = items.where(needed).withColumn("confidence", F.least(F.greatest(F.coalesce("confidence", F.lit(1.0)), F.lit(0.0)), F.lit(1.0)))
    return kept.withColumn("tentative", F.col("confidence") < TENTATIVE_BELOW)


def gap_items(answers: DataFrame, keys: list[str], answer: str = "answer") -> DataFrame:
    """Compliance gaps with all three keys and a known severity."""
    items = answers.select(*keys, F.posexplode(F.from_json(X.noisy_json(F.col(answer)), GAP)).alias("pos", "g")).select(*keys, "pos", "g.*")
    return items.withColumn("severity", F.upper(F.trim("severity"))).where(F.col("severity").isin(*SEVERITIES) & F.col("clause").isNotNull() & F.col("description").isNotNull())


def has_critical(gaps: Column) -> Column:
    return F.exists(gaps, lambda g: g["severity"] == "CRITICAL")


def markdown_table(header: list[str], cells: list[str], order: list[str]) -> Column:
    """Aggregate of a group's rows as a Markdown table."""
    row = F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    rows = F.transform(F.array_sort(F.collect_list(F.struct(*order, row.alias("_row")))), lambda x: x["_row"])
    top = f"| {' | '.join(header)} |\n|{'---|' * len(header)}\n"
    return F.concat(F.lit(top), F.array_join(rows, "\n"))


def markdown_lines(rows: DataFrame, keys: list[str], header: list[str], cells: list[str], order: list[str]) -> DataFrame:
    """``keys, line_no, line``: the same tables as rows, two lines of header first. Lines are numbered over all tasks, so a group may have any number.

    Keys aren't null; rows that are equal in ``order`` come in any order.
    """
    placed = positions(rows.select(*keys, *order, F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line")), [*map(F.col, keys), *map(F.col, order)], "_at")
    starts = placed.groupBy(*keys).agg(F.min("_at").alias("_first"))
    body = placed.join(starts, keys).select(*keys, (F.col("_at") - F.col("_first") + 2).alias("line_no"), "line")
    tops = F.array(F.lit(f"| {' | '.join(header)} |"), F.lit(f"|{'---|' * len(header)}"))
    return starts.select(*keys, F.posexplode(tops).alias("line_no", "line")).select(*keys, F.col("line_no").cast("long").alias("line_no"), "line").unionByName(body)


def render_template(template: Column, values: dict[str, Column]) -> tuple[Column, Column]:
    """Rendered text and, where a ``{name}`` is left, the error that names it."""
    out = template
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), value)
    left = F.regexp_extract(out, r"\{([a-z_]+)\}", 1)
    return out, F.when(left != "", F.concat(F.lit("missing variable: "), left))


def why_chain(steps: DataFrame, session: str, order: str, question: str, answer: str, least: int = 5) -> DataFrame:
    """``session, answered, complete, chain``: questions with their answers, or that one is awaited; complete at ``least`` answers."""
    given = F.coalesce(F.trim(answer), F.lit("")) != ""
    line = F.concat(F.col(order).cast("string"), F.lit(". "), question, F.lit(": "), F.when(given, F.col(answer)).otherwise("(awaiting answer)"))
    lines = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("t"))))
    return steps.groupBy(session).agg(F.count_if(given).alias("answered"), (F.count_if(given) >= least).alias("complete"), F.array_join(F.transform(lines, lambda x: x["t"]), "\n").alias("chain"))
