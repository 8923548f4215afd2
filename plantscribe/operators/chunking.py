"""Chunks: windows of words, paragraphs, sections, tables, flattened JSON and mail."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import text as X
from .trees import json_walk, leaves, xml_walk

WINDOW, OVERLAP = 768, 64


def token_windows(docs: DataFrame, keys: list[str], text: str = "text", window: int = WINDOW, overlap: int = OVERLAP, whole: Column | None = None) -> DataFrame:
    """``keys, chunk_index, text, token_count``: windows of ``window`` words with ``overlap``, the last one ends the text.

    Texts of up to ``window`` words, and rows where ``whole`` holds, stay one chunk with their text as it is.
    Empty texts give no chunk. No shuffle: windows are numbered within their row.
    """
    step = window - overlap
    some = docs.where(F.col(text).rlike(X.WORD))  # a filter on the words' number would split every text a second time
    rows = some.withColumn("_w", X.words(F.col(text))).withColumn("_n", F.size("_w"))
    single = (F.col("_n") <= window) | (F.coalesce(whole, F.lit(False)) if whole is not None else F.lit(False))
    # Never empty; outer, since explode infers a filter that would split the text again.
    starts = F.when(single, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.greatest(F.lit(0), F.col("_n") - overlap - 1), F.lit(step)))
    rows = rows.select(*keys, text, "_w", "_n", single.alias("_one"), F.posexplode_outer(starts).alias("chunk_index", "_s"))
    part = F.slice("_w", F.col("_s") + 1, window)
    return rows.select(*keys, "chunk_index", F.when(F.col("_one"), F.col(text)).otherwise(F.array_join(part, " ")).alias("text"), F.when(F.col("_one"), F.col("_n")).otherwise(F.size(part)).alias("token_count"))


def chunk_id(document_id: Column, chunk_index: Column) -> Column:
    """The same id for the same place on every run."""
    return F.sha2(F.concat_ws(":", document_id.cast("string"), chunk_index.cast("string")), 256)


def paragraphs(docs: DataFrame, keys: list[str], text: str = "text", separator: str = "\n\n") -> DataFrame:
    """Trimmed non-empty stretches between separators, numbered from 0."""
    clean = F.replace(F.col(text), F.lit("\r\n"), F.lit("\n"))
    parts = F.filter(F.transform(F.split(clean, separator.replace("\n", r"\n")), lambda p: F.regexp_replace(p, r"^[ \t\r\n]+|[ \t\r\n]+$", "")), lambda p: p != "")
    return docs.select(*keys, F.posexplode(parts).alias("chunk_index", "text"))


def markdown_sections(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """``keys, chunk_index, chunk_type, parent_section_header, text``.

    Lines that start with ``#`` are headings; the lines between them up to a blank line are paragraphs under the last heading.
    Windows run within one document.
    """
    order = W.partitionBy(*keys).orderBy("_k")
    lines = docs.select(*keys, F.posexplode(F.split(F.replace(F.col(text), F.lit("\r\n"), F.lit("\n")), r"\n")).alias("_k", "_l")).withColumn("_t", F.trim("_l"))
    heading = F.col("_t").startswith("#")
    header = F.trim(F.regexp_replace("_t", r"^#+", ""))
    marked = lines.withColumns({"_h": heading, "_cut": (heading | (F.col("_t") == "") | F.lag(heading, 1, True).over(order)).cast("int")})
    marked = marked.withColumns({"_b": F.sum("_cut").over(order), "_head": F.last(F.when(F.col("_h"), header), ignorenulls=True).over(order)}).where("_t <> ''")
    blocks = marked.groupBy(*keys, "_b").agg(F.first("_h").alias("_h"), F.min("_k").alias("_k"), F.max("_head").alias("_head"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_k", "_t"))), lambda x: x["_t"]), "\n").alias("_text"))
    return blocks.select(
        *keys, (F.row_number().over(order) - 1).alias("chunk_index"), F.when(F.col("_h"), "heading").otherwise("paragraph").alias("chunk_type"),
        F.when(~F.col("_h"), F.col("_head")).alias("parent_section_header"), F.when(F.col("_h"), F.col("_head")).otherwise(F.col("_text")).alias("text"),
    )


def delimited_cells(docs: DataFrame, keys: list[str], text: str = "text", separator: str = ",") -> DataFrame:
    """Non-empty trimmed cells ``keys, row, col, value`` of delimited text; rows without any are not counted.

    A cell that starts with a quote goes on to the closing one, over separators and line breaks; a doubled quote is one. A quote that
    is never closed is an ordinary character.
    """
    sep = rf"\Q{separator}\E"
    cell = rf'(?:"(?:[^"]++|"")*+"(?:(?!{sep})[^\n])*+|(?:(?!{sep})[^\n])*+)'
    clean = F.replace(F.replace(F.col(text), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    lines = F.regexp_extract_all(clean, F.lit(rf"{cell}(?:{sep}{cell})*+"), F.lit(0))
    full = F.filter(lines, lambda x: F.regexp_replace(x, rf'{sep}|[\s"]', "") != "")
    rows = docs.select(*keys, F.posexplode(full).alias("row", "_r"))
    cells = rows.select(*keys, "row", F.posexplode(F.regexp_extract_all(F.concat(F.lit(separator), "_r"), F.lit(rf"{sep}({cell})"), F.lit(1))).alias("col", "_v"))
    quoted = r'(?s)^"((?:[^"]++|"")*+)"(.*)$'
    value = F.when(F.col("_v").rlike(quoted), F.concat(F.replace(F.regexp_extract("_v", quoted, 1), F.lit('""'), F.lit('"')), F.regexp_extract("_v", quoted, 2))).otherwise(F.col("_v"))
    return cells.select(*keys, "row", "col", F.regexp_replace(value, r"^\s+|\s+$", "").alias("value")).where("value <> ''")


def readable_rows(cells: DataFrame, keys: list[str]) -> DataFrame:
    """One ``header: value | ...`` line per row; the header row itself and columns without one are called ``colN``."""
    head = cells.where("row = 0").select(*keys, "col", F.col("value").alias("_head"))
    named = cells.join(head, [*keys, "col"], "left").withColumn("_name", F.when((F.col("row") > 0) & F.col("_head").isNotNull(), F.col("_head")).otherwise(F.concat(F.lit("col"), F.col("col"))))
    line = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col", F.concat_ws(": ", "_name", "value").alias("t")))), lambda x: x["t"]), " | ")
    return named.groupBy(*keys, "row").agg(line.alias("line"))


def json_leaves(rows: DataFrame, keys: list[str], json: str, depth: int | None = None) -> DataFrame:
    """``keys, pos, path, value``: dotted path of each scalar in document order, at any level or down to ``depth``; invalid JSON gives
    its paragraphs, without a path. One pass, whatever the depth."""
    parsed = leaves(rows, keys, json, json_walk)
    found = parsed.select(*keys, F.posexplode("_leaves").alias("pos", "_e")).select(*keys, "pos", F.col("_e.name").alias("path"), "_e.value")
    if depth is not None:
        found = found.where(F.when(F.col("path") == "", 0).otherwise(F.size(F.split("path", r"\."))) <= depth)
    broken = paragraphs(parsed.where("_leaves IS NULL AND _text IS NOT NULL"), keys, "_text")
    return found.unionByName(broken.select(*keys, F.col("chunk_index").alias("pos"), F.lit(None).cast("string").alias("path"), F.col("text").alias("value")))


def xml_leaves(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """``keys, pos, line``: ``tag: text`` of each element that starts with text, without namespaces; of malformed XML, and of XML
    without text, the paragraphs."""
    parsed = leaves(docs, keys, text, xml_walk)
    lines = parsed.select(*keys, F.posexplode("_leaves").alias("pos", "_e")).select(*keys, "pos", F.concat("_e.name", F.lit(": "), "_e.value").alias("line"))
    rest = paragraphs(parsed.where("_text IS NOT NULL AND coalesce(size(_leaves), 0) <= 0"), keys, "_text")
    return lines.unionByName(rest.select(*keys, F.col("chunk_index").alias("pos"), F.col("text").alias("line")))


MAIL_FIELDS = ("From", "To", "Cc", "Date", "Subject")  # fixed values, in this order


def mail_chunks(docs: DataFrame, keys: list[str], text: str = "text", name: str | None = None) -> DataFrame:
    """MAIL_FIELDS as a heading chunk, body paragraphs and the attachments' names of RFC 822 text.

    The subject is every chunk's section header, or the file name (column ``name``); a mail without any content is one chunk that
    names the file. Folded fields are put on one line. Parts of a multipart body aren't decoded.
    """
    file = F.coalesce(F.col(name), F.lit("")) if name else F.lit("")
    clean = F.replace(F.col(text), F.lit("\r\n"), F.lit("\n"))
    halves = docs.select(*keys, file.alias("_file"), F.split(clean, r"\n\n", 2).alias("_p")).withColumns({"_head": F.regexp_replace(F.col("_p")[0], r"\n[ \t]+", " "), "_body": F.when(F.size("_p") > 1, F.col("_p")[1]).otherwise("")})
    field = lambda f: F.trim(F.regexp_extract("_head", rf"(?im)^{f}:[ \t]*(.*)$", 1))
    header = F.array_join(F.filter(F.array(*(F.when(field(f) != "", F.concat(F.lit(f"{f}: "), field(f))) for f in MAIL_FIELDS)), lambda x: x.isNotNull()), "\n")
    attached = F.array_distinct(F.regexp_extract_all("_body", F.lit(r'(?im)^content-disposition:[ \t]*attachment;[^\n]*?(?:\n[ \t][^\n]*?)?filename="?([^"\n;]+)'), F.lit(1)))
    struct = lambda kind, t: F.struct(F.lit(kind).alias("chunk_type"), t.alias("text"))
    body = F.filter(F.transform(F.split("_body", r"\n\n"), lambda p: F.regexp_replace(p, r"^[ \t\r\n]+|[ \t\r\n]+$", "")), lambda p: p != "")
    some = lambda kind, t: F.when(t != "", F.array(struct(kind, t))).otherwise(F.array().cast("array<struct<chunk_type:string,text:string>>"))
    names = F.when(F.size(attached) > 0, F.concat(F.lit("Attachments: "), F.array_join(attached, ", "))).otherwise("")
    parts = F.concat(some("heading", header), F.transform(body, lambda p: struct("paragraph", p)), some("paragraph", names))
    own = halves.select(*keys, "_file", F.coalesce(F.nullif(field("Subject"), F.lit("")), F.nullif("_file", F.lit(""))).alias("_subject"), parts.alias("_parts"))
    empty = F.size("_parts") == 0
    own = own.select(*keys, F.when(~empty, F.col("_subject")).alias("parent_section_header"), F.when(empty, F.array(struct("paragraph", F.concat(F.lit("[Email: "), "_file", F.lit("]"))))).otherwise(F.col("_parts")).alias("_parts"))
    return own.select(*keys, "parent_section_header", F.posexplode("_parts").alias("chunk_index", "_c")).select(*keys, "parent_section_header", "chunk_index", "_c.chunk_type", "_c.text")


def listing(chunks: DataFrame, width: int = 500) -> DataFrame:
    """Chunks as a list view shows them: cut texts and flags in place of tables and figures."""
    has = lambda c: F.col(c).isNotNull() if c in chunks.columns else F.lit(False)
    return chunks.withColumns({"text": F.substring("text", 1, width), "has_table_data": has("table_data"), "has_figure": has("figure_storage_key")}).drop("table_data", "figure_storage_key")
