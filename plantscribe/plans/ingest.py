"""Admission, typing, parsing and loading over ``documents``, ``pages``, ``orders`` and ``conversations``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import language as L, mime as M, text as X
from ..operators import chunking as C, language as N, plugins as P, relational as O
from ..session import cut, scratch
from ..sources import tables as T
from ..sources.keyed import KeyedTables
from .base import Registry, read, sql_list
from .operations import WO_SQL, work_orders

registry = Registry()

NAMES = (".pdf", ".CSV", "", ".tar.unknown", ".eml", ".md", "/", ".HTML")
DECLARED = ("application/octet-stream", "text/html; charset=utf-8", "", "application/x-odd")
HEADS = (*M.MAGIC, "20207B2261223A31", "0A3C3F586D6C207665", "", "", "")
UP_SQL = f"""raw AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN '' WHEN doc_id % 8 = 6 THEN '' ELSE source || '-' || doc_id || {sql_list(NAMES)}[doc_id % 8 + 1] END AS name, {sql_list(DECLARED)}[doc_id % 4 + 1] AS declared,
 CASE WHEN doc_id % 9 = 0 THEN '' ELSE {sql_list(HEADS)}[doc_id % {len(HEADS)} + 1] || hex(encode(text)) END AS code, doc_id % 10 = 0 AS archive FROM documents),
up AS (SELECT doc_id, name, declared, left(code, 1024) AS head, length(code) // 2 * CASE WHEN archive THEN 1048576 ELSE 1 END AS size FROM raw)"""
SNIFF_SQL = "CASE WHEN head = '' THEN NULL " + " ".join(f"WHEN starts_with(head, '{k}') THEN '{v}'" for k, v in M.MAGIC.items()) + " WHEN regexp_matches(head, '^(20|09|0A|0B|0C|0D)*(7B|5B)') THEN 'application/json' WHEN regexp_matches(head, '^(20|09|0A|0B|0C|0D)*3C3F[57]8[46]D[46]C') THEN 'application/xml' END"
EXT_SQL = "CASE lower(regexp_extract(name, '[^/.](\\.[^./]+)$', 1)) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in M.EXTENSIONS.items()) + " END"
MIME_SQL = f"{UP_SQL}, mm AS (SELECT *, {SNIFF_SQL} AS sniffed, coalesce({EXT_SQL}, CASE WHEN declared NOT IN ({sql_list(M.GENERIC)[1:-1]}) THEN trim(split_part(declared, ';', 1)) END, {SNIFF_SQL}, nullif(declared, ''), 'text/plain') AS mime FROM up)"


def uploads(spark, sf_dir):
    """Documents as uploaded files: the texts' own bytes, most behind one of all known first bytes; every ninth is empty, every tenth an
    archive whose unpacked size counts."""
    d = F.col("doc_id")
    pick = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (d % n + 1).cast("int"))
    rows = read(spark, sf_dir, "documents")
    content = F.when(d % 9 == 0, F.lit(b"")).otherwise(F.concat(F.unhex(pick(HEADS, len(HEADS))), F.encode("text", "UTF-8")))
    name = F.when((d % 7 == 0) | (d % 8 == 6), "").otherwise(F.concat("source", F.lit("-"), d, pick(NAMES, 8)))
    size = F.octet_length(content).cast("long") * F.when(d % 10 == 0, 1048576).otherwise(1)
    rows = rows.select("doc_id", name.alias("name"), pick(DECLARED, 4).alias("declared"), F.substring(content, 1, 512).alias("head"), size.alias("size"))
    return rows.withColumn("mime", M.resolve(F.col("declared"), F.col("name"), F.col("head")))


@registry.add(f"WITH {MIME_SQL} SELECT doc_id, mime, sniffed FROM mm")
def resolve_types(spark, sf_dir):
    return uploads(spark, sf_dir).select("doc_id", "mime", M.sniff(F.col("head")).alias("sniffed"))


REASON_SQL = f"CASE WHEN size = 0 THEN 'EMPTY_FILE' WHEN size > {M.MAX_BYTES} THEN 'FILE_TOO_LARGE' WHEN mime NOT IN ({sql_list(M.ALLOWED)[1:-1]}) THEN 'UNSUPPORTED_TYPE' END"


@registry.add(f"WITH {MIME_SQL} SELECT doc_id, {REASON_SQL} AS reject_reason FROM mm")
def upload_admission(spark, sf_dir):
    return uploads(spark, sf_dir).select("doc_id", M.reject_reason(F.col("size"), F.col("mime")).alias("reject_reason"))


KIND_SQL = "CASE " + " ".join(f"WHEN mime IN ({sql_list(v)[1:-1]}) THEN '{k}'" for k, v in M.PARSERS.items()) + " END"


@registry.add(f"WITH {MIME_SQL} SELECT doc_id, {KIND_SQL} AS parse_kind, CASE WHEN {KIND_SQL} IS NULL THEN 'no parser for ' || mime END AS error, CASE WHEN {KIND_SQL} IS NULL THEN 'FAILED' ELSE 'CHUNKED' END AS status FROM mm")
def parser_routing(spark, sf_dir):
    """A document without a parser fails with a message; the others go on."""
    rows = uploads(spark, sf_dir).withColumn("parse_kind", M.parse_kind(F.col("mime")))
    missing = F.col("parse_kind").isNull()
    return rows.select("doc_id", "parse_kind", F.when(missing, F.concat(F.lit("no parser for "), "mime")).alias("error"), F.when(missing, "FAILED").otherwise("CHUNKED").alias("status"))


PARTS_SQL = r"list_filter(list_transform(string_split(replace(replace(body, chr(13) || chr(10), chr(10)), chr(10), chr(10) || chr(10)), chr(10) || chr(10)), lambda p: regexp_replace(p, '^[ \t\r\n]+|[ \t\r\n]+$', '', 'g')), lambda p: p <> '')"


@registry.add(f"""WITH {MIME_SQL}, b AS (SELECT m.*, d.text AS body FROM mm m JOIN documents d USING (doc_id)), p AS (SELECT doc_id, mime, {PARTS_SQL} AS parts, coalesce(len(body), 0) AS n_chars FROM b)
SELECT doc_id, CASE WHEN mime IN ('text/plain', 'text/markdown') OR mime = 'text/csv' AND doc_id % 3 <> 0 THEN 'CHUNKED' ELSE 'FAILED' END AS status, CASE WHEN mime IN ('text/plain', 'text/markdown') THEN len(parts) WHEN mime = 'text/csv' AND doc_id % 3 <> 0 THEN 1 ELSE 0 END AS n_chunks,
 CASE WHEN mime IN ('text/plain', 'text/markdown') THEN NULL WHEN mime = 'text/csv' THEN CASE WHEN doc_id % 3 = 0 THEN 'ValueError: a broken table' END ELSE 'no parser for ' || mime END AS error FROM p""")
def parse_outcomes(spark, sf_dir):
    """Whole texts through a registry that a caller extends by a parser which fails on some: chunks of each document, or why it has none."""
    def tables(text):
        if text.startswith("broken"):
            raise ValueError("a broken table")
        return [text]

    body = F.replace(F.replace("text", F.lit("\r\n"), F.lit("\n")), F.lit("\n"), F.lit("\n\n"))
    rows = read(spark, sf_dir, "documents").select("doc_id", body.alias("text")).join(uploads(spark, sf_dir).select("doc_id", "mime"), "doc_id")
    text = F.when((F.col("mime") == "text/csv") & (F.col("doc_id") % 3 == 0), F.concat(F.lit("broken"), "text")).otherwise(F.col("text"))
    return P.Parsers().add(("text/csv",), tables).parse(rows.withColumn("text", text)).drop("chunks")


@registry.add("SELECT doc_id, sha256(text) AS sha256, min(doc_id) OVER (PARTITION BY sha256(text)) AS first_id, doc_id = min(doc_id) OVER (PARTITION BY sha256(text)) AS is_first FROM documents")
def exact_duplicates(spark, sf_dir):
    """The hash, not the text, is shuffled; the smallest id is counted before the shuffle."""
    d = read(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))
    return d.join(d.groupBy("sha256").agg(F.min("doc_id").alias("first_id")), "sha256").withColumn("is_first", F.col("doc_id") == F.col("first_id"))


@registry.add(f"WITH {WO_SQL} SELECT wo_id, asset_tag, CASE WHEN CAST(substr(wo_id, 4) AS BIGINT) % 2 = 0 THEN 'REOPENED' ELSE status END AS status, scheduled_date, completed_date FROM wo")
def work_order_load(spark, sf_dir):
    """CSV lines with blank dates; a later line of the same order wins."""
    wo = work_orders(spark, sf_dir).withColumn("seq", F.lit(1))
    again = wo.where("cast(substr(wo_id, 4) as bigint) % 2 = 0").withColumns({"status": F.lit("REOPENED"), "seq": F.lit(2)})
    day = lambda c: F.coalesce(F.date_format(c, "yyyy-MM-dd"), F.lit(""))
    lines = wo.unionByName(again).select("seq", F.concat_ws(",", "wo_id", "asset_tag", F.lit("text"), "status", "priority", day("scheduled_date"), day("completed_date")).alias("line"))
    parsed = T.typed_work_orders(lines.select("seq", F.from_csv("line", T.WORK_ORDER).alias("r")).select("seq", "r.*"))
    return O.latest(parsed, ["wo_id"], [F.desc("seq")]).select("wo_id", "asset_tag", "status", "scheduled_date", "completed_date")


@registry.add("SELECT item_id, CASE WHEN item_id % 2 = 0 THEN 'tag' ELSE 'general' END AS category, 0 AS n_mentions, CASE WHEN item_id % 3 = 0 THEN 2 ELSE 0 END AS n_alternates FROM benchmark")
def golden_load(spark, sf_dir):
    k = F.col("item_id")
    js = F.to_json(F.struct(F.col("text").alias("question"), F.when(k % 2 == 0, "tag").alias("category"), F.when(k % 3 == 0, F.array(F.lit("a"), F.lit("b"))).alias("alternate_sources")))
    rows = T.golden_defaults(read(spark, sf_dir, "benchmark").select("item_id", F.from_json(js, T.GOLDEN).alias("g")).select("item_id", "g.*"))
    return rows.select("item_id", "category", F.size("expected_entity_mentions").alias("n_mentions"), F.size("alternate_sources").alias("n_alternates"))


@registry.add("SELECT conv_id, turn, CASE WHEN conv_id % 10 = 0 THEN 'new' ELSE role END AS role FROM conversations WHERE conv_id % 10 <> 0 OR turn <= 2")
def replace_chunks(spark, sf_dir):
    """Every tenth document is parsed anew into two chunks that replace all its old ones."""
    base = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    return O.replace_by(base, base.where("conv_id % 10 = 0 AND turn <= 2").withColumn("role", F.lit("new")), "conv_id")


@registry.add("SELECT vec_id, label FROM embeddings WHERE vec_id % 2 = 0 OR vec_id % 3 = 0")
def insert_absent_rows(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings").select("vec_id", "label")
    return O.insert_absent(e.where("vec_id % 2 = 0"), e.where("vec_id % 3 = 0"), ["vec_id"])


@registry.add("""SELECT vec_id, CASE WHEN vec_id % 4 = 0 THEN -1 ELSE label END AS label, round(CASE WHEN vec_id % 4 = 0 THEN -2 ELSE 1 END * list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 6) AS total, len(embedding)::INT AS dimensions
FROM embeddings WHERE vec_id % 5 <> 0 OR vec_id % 15 = 0""")
def vector_upsert(spark, sf_dir):
    """Vectors on disk: points with an id replace it, the points of some documents are deleted, and some of these come back."""
    e = read(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    tables = KeyedTables(spark, scratch(spark, "vectors"), "vec_id")
    tables.replace({"points": e})
    changed = e.where("vec_id % 4 = 0").withColumns({"label": F.lit(-1).cast(e.schema["label"].dataType), "embedding": F.transform("embedding", lambda x: x * -2).cast(e.schema["embedding"].dataType)})
    tables.replace({"points": changed})
    tables.commit(tables.batch(), e.where("vec_id % 5 = 0"))
    again = e.where("vec_id % 15 = 0").join(changed, "vec_id", "left_anti").unionByName(changed.where("vec_id % 15 = 0"))
    tables.replace({"points": again})
    total = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return tables.read("points").select("vec_id", "label", F.round(total, 6).alias("total"), F.size("embedding").alias("dimensions"))


HTML_SQL = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)\b.*?</(script|style)\s*>', chr(10), 'g'), '(?s)<!--.*?-->', chr(10), 'g'), '<[^>]*>', chr(10), 'g'), '[ \t\r\n]*\n[ \t\r\n]*', chr(10), 'g'), '^[ \t\r\n]+|[ \t\r\n]+$', '', 'g')"


# Tags first, then the references that the pages hold, one by one: not how the library goes about it.
STRIPPED_SQL = HTML_SQL.replace("'<[^>]*>', chr(10), 'g')", "'<[^>]*>', chr(10), 'g'), '&copy;', '©'), '&middot;', '·'), '&quot;', '\"'), '&amp;', '&')")
STRIPPED_SQL = STRIPPED_SQL.replace("regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html", "regexp_replace(regexp_replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(html")


@registry.add(f"SELECT page_id, coalesce(nullif({STRIPPED_SQL}, ''), html) AS text FROM pages")
def html_text(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", X.strip_html(F.col("html")).alias("text"))


@registry.add(r"""SELECT doc_id, md5(CASE WHEN doc_id % 4 = 3 THEN array_to_string(list_transform(range(1, 2 * strlen(text), 2), lambda k: chr(('0x' || substr(hex(encode(text)), k::INT, 2))::INT)), '') || 'ÿ' ELSE text END) AS text_md5 FROM documents""")
def byte_decoding(spark, sf_dir):
    """By id: UTF-8; Latin-1 bytes (UTF-8 where a sign has none); UTF-8 behind its mark; UTF-8 with a broken byte, which is read as Latin-1."""
    d, text = F.col("doc_id") % 4, F.encode("text", "UTF-8")
    narrow = F.col("text").rlike(r"^[\x00-\xFF]*$")
    content = F.when((d == 1) & narrow, F.encode("text", "ISO-8859-1")).when(d == 2, F.concat(F.unhex(F.lit("EFBBBF")), text)).when(d == 3, F.concat(text, F.unhex(F.lit("FF")))).otherwise(text)
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(X.decode_bytes(content)).alias("text_md5"))


TRIMMED_SQL = "regexp_replace(text, '^[\\s]+|[\\s]+$', '', 'g')"
CELL_SQL = f"""SELECT * FROM (SELECT doc_id, 0 AS "row", 0 AS col, 'id' AS value FROM documents UNION ALL SELECT doc_id, 0, 1, 'full "text"' FROM documents UNION ALL SELECT doc_id, 1, 0, doc_id::VARCHAR FROM documents
UNION ALL SELECT doc_id, 1, 1, {TRIMMED_SQL} FROM documents UNION ALL SELECT doc_id, 1, 2, source FROM documents UNION ALL SELECT doc_id, 2, 1, lang || ', x' FROM documents) WHERE value <> ''"""


def tables(spark, sf_dir):
    """Whole texts as quoted cells, with their separators, quotes and line breaks; a blank row between."""
    quoted = F.concat(F.lit('"'), F.replace("text", F.lit('"'), F.lit('""')), F.lit('"'))
    text = F.concat(F.lit('id,"full ""text"""\r\n'), "doc_id", F.lit(","), quoted, F.lit(","), "source", F.lit("\r\n , ,\r\n,\""), "lang", F.lit(', x"\r\n'))
    return C.delimited_cells(read(spark, sf_dir, "documents").select("doc_id", text.alias("text")), ["doc_id"])


@registry.add(f"SELECT doc_id, \"row\", col, md5(value) AS value_md5 FROM ({CELL_SQL})")
def delimited_cells(spark, sf_dir):
    return tables(spark, sf_dir).select("doc_id", "row", "col", F.md5("value").alias("value_md5"))


@registry.add(f"""SELECT doc_id, "row", md5(string_agg(CASE WHEN "row" = 0 OR col = 2 THEN 'col' || col WHEN col = 0 THEN 'id' ELSE 'full "text"' END || ': ' || value, ' | ' ORDER BY col)) AS line_md5 FROM ({CELL_SQL}) GROUP BY doc_id, "row" """)
def delimited_lines(spark, sf_dir):
    return C.readable_rows(tables(spark, sf_dir), ["doc_id"]).select("doc_id", "row", F.md5("line").alias("line_md5"))


@registry.add("""WITH l AS (SELECT doc_id, source, lang, n_chars, string_split(text, chr(10)) AS ls, replace(replace(text, chr(13) || chr(10), chr(10)), chr(10), chr(10) || chr(10)) AS spread FROM documents),
p AS (SELECT doc_id, unnest(string_split('{"id": ' || doc_id || ', ' || spread, chr(10) || chr(10))) AS part FROM l WHERE doc_id % 5 = 0)
SELECT doc_id, unnest(['id', 'meta.source', 'meta.size.0', 'meta.size.1.deep.a', 'meta.size.1.ok', 'meta.size.1.none'] || list_transform(range(len(ls)), lambda k: 'body.' || k || '.line')) AS path,
 unnest(list_transform([doc_id::VARCHAR, source, n_chars || '.50', '1e3', 'true', NULL] || ls, lambda v: md5(v))) AS value_md5, unnest(range(6 + len(ls)))::INT AS pos FROM l WHERE doc_id % 5 <> 0
UNION ALL SELECT doc_id, NULL, md5(t), (row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1)::INT FROM (SELECT doc_id, k, regexp_replace(part, '^[ \\t\\r\\n]+|[ \\t\\r\\n]+$', '', 'g') AS t
 FROM (SELECT doc_id, unnest(string_split('{"id": ' || doc_id || ', ' || spread, chr(10) || chr(10))) AS part, unnest(range(len(string_split('{"id": ' || doc_id || ', ' || spread, chr(10) || chr(10))))) AS k FROM l WHERE doc_id % 5 = 0)) WHERE t <> ''""")
def json_leaves(spark, sf_dir):
    """Whole texts line by line in nested JSON, beside numbers, flags and null; every fifth document is cut off and falls back to its paragraphs."""
    lines = F.to_json(F.transform(F.split("text", r"\n", -1), lambda t: F.struct(t.alias("line"))))
    good = F.concat(F.lit('{"id": '), "doc_id", F.lit(', "meta": {"source": "'), "source", F.lit('", "size": ['), "n_chars", F.lit('.50, {"deep": {"a": 1e3}, "ok": true, "none": null}], "empty": {}, "also": []}, "body": '), lines, F.lit("}"))
    spread = F.replace(F.replace("text", F.lit("\r\n"), F.lit("\n")), F.lit("\n"), F.lit("\n\n"))
    rows = read(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit('{"id": '), "doc_id", F.lit(", "), spread)).otherwise(good).alias("js"))
    return C.json_leaves(rows, ["doc_id"], "js").select("doc_id", "pos", "path", F.md5("value").alias("value_md5"))


@registry.add(r"""WITH x AS (SELECT doc_id, lang, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t, text FROM documents), p AS (SELECT doc_id, unnest(string_split('<r><a>' || replace(replace(text, chr(13) || chr(10), chr(10)), chr(10), chr(10) || chr(10)) || '</b></r>', chr(10) || chr(10))) AS part FROM documents WHERE doc_id % 5 = 0)
SELECT doc_id, md5(line) AS line_md5 FROM (SELECT doc_id, unnest(['id: ' || doc_id, 'body: ' || t, 'in: 1 < 2 & é', 'raw: <q a="b">' || t || '</q> and', 'lang: ' || lang]) AS line FROM x WHERE doc_id % 5 <> 0) WHERE line <> 'body: '
UNION ALL SELECT doc_id, md5(regexp_replace(part, '^[ \t\r\n]+|[ \t\r\n]+$', '', 'g')) FROM p WHERE regexp_replace(part, '^[ \t\r\n]+|[ \t\r\n]+$', '', 'g') <> ''""")
def xml_leaves(spark, sf_dir):
    """Whole texts, escaped and as CDATA, among mixed content, attributes with marks, references and comments; every fifth document is
    malformed and falls back to its paragraphs."""
    escaped = F.replace(F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    inner = F.lit('<c.in kind="x>y"> <!-- <no>tag</no> --><in>1 &lt; 2 &amp; &#233;</in> tail </c.in>')
    raw = F.concat(F.lit('<raw><![CDATA[<q a="b">'), F.regexp_replace("text", r"^\s+|\s+$", ""), F.lit("</q>]]> and<empty/> more</raw>"))
    good = F.concat(F.lit("<r><id>"), "doc_id", F.lit('</id>\n <x:body xmlns:x="u" kind=\'a>"b\'> '), escaped, inner, F.lit(" after </x:body><empty/>"), raw, F.lit("<b><lang>"), "lang", F.lit("</lang></b></r>"))
    bad = F.concat(F.lit("<r><a>"), F.replace(F.replace("text", F.lit("\r\n"), F.lit("\n")), F.lit("\n"), F.lit("\n\n")), F.lit("</b></r>"))
    rows = read(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 5 == 0, bad).otherwise(good).alias("text"))
    return C.xml_leaves(rows, ["doc_id"]).select("doc_id", F.md5("line").alias("line_md5"))


@registry.add("""WITH c AS (SELECT conv_id, turn, regexp_replace(text, '^[ \\t\\r\\n]+|[ \\t\\r\\n]+$', '', 'g') AS t, role, turn % 2 = 0 AS files FROM (SELECT *, replace(text, chr(10), ' ') AS line FROM conversations)),
l AS (SELECT conv_id, turn, list_filter([{'k': 'heading', 't': 'From: ' || role || chr(10) || 'To: plant, shift' || chr(10) || 'Subject: conv ' || conv_id}], lambda x: true) || list_transform(list_filter(list_transform(string_split(replace(t, chr(13) || chr(10), chr(10)), chr(10) || chr(10)), lambda p: regexp_replace(p, '^[ \\t\\r\\n]+|[ \\t\\r\\n]+$', '', 'g')), lambda p: p <> ''), lambda p: {'k': 'paragraph', 't': p})
 || CASE WHEN files THEN [{'k': 'paragraph', 't': 'Content-Disposition: attachment; filename="log.csv"'}, {'k': 'paragraph', 't': 'Content-Disposition: attachment;' || chr(10) || ' filename=plan.pdf'}, {'k': 'paragraph', 't': 'Attachments: log.csv, plan.pdf'}] ELSE [] END AS parts FROM c),
u AS (SELECT conv_id, turn, unnest(parts) AS p, generate_subscripts(parts, 1) - 1 AS i FROM l) SELECT conv_id, turn, i::INT AS chunk_index, p.k AS chunk_type, 'conv ' || conv_id AS parent_section_header, md5(p.t) AS text_md5 FROM u""")
def mail_chunks(spark, sf_dir):
    """Whole messages as bodies; a folded and an unwanted field; every second mail names two attachments."""
    files = '\r\n\r\nContent-Disposition: attachment; filename="log.csv"\r\n\r\nContent-Disposition: attachment;\r\n filename=plan.pdf'
    text = F.concat(F.lit("X-Odd: 1\r\nSubject: conv "), "conv_id", F.lit("\r\nto: plant,\r\n shift\r\nFrom: "), "role", F.lit("\r\n\r\n"), "text", F.when(F.col("turn") % 2 == 0, files).otherwise(""))
    return C.mail_chunks(read(spark, sf_dir, "conversations").select("conv_id", "turn", text.alias("text")), ["conv_id", "turn"]).select("conv_id", "turn", "chunk_index", "chunk_type", "parent_section_header", F.md5("text").alias("text_md5"))


LANG_SQL = ", ".join(f"{{'n': len(list_filter(w, lambda x: x IN ({sql_list(v)[1:-1]}))), 'k': {-k}, 'code': '{c}'}}" for k, (c, v) in enumerate(L.PROFILES.items()))


@registry.add(rf"""WITH s AS (SELECT doc_id, left(trim(text), 2000) AS t FROM documents), w AS (SELECT doc_id, t, regexp_extract_all(lower(t), '[^\x20\x09-\x0D]+') AS w FROM s),
b AS (SELECT doc_id, t, list_sort([{LANG_SQL}])[-1] AS b FROM w) SELECT doc_id, CASE WHEN length(t) >= 20 AND b.n > 0 THEN b.code END AS detected FROM b""")
def detect_language(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", L.detect(F.col("text")).alias("detected"))


NGRAM_SQL = r"""pl AS (SELECT doc_id, lang, ' ' || trim(regexp_replace(lower(left(trim(text), 2000)), '[^\p{L}]+', ' ', 'g')) || ' ' AS t FROM documents WHERE length(left(trim(text), 2000)) >= 20),
gr AS (SELECT doc_id, gram, count(*) AS n FROM (SELECT doc_id, unnest(list_transform(range(1, length(t) - 1), lambda k: t[k:k + 2])) AS gram FROM pl) GROUP BY ALL),
sa AS (SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5(doc_id::VARCHAR), doc_id) AS k FROM documents WHERE lang IS NOT NULL) WHERE k <= 200),
pr AS (SELECT * FROM (SELECT lang, gram, row_number() OVER (PARTITION BY lang ORDER BY sum(n) DESC, gram) - 1 AS rank FROM gr JOIN sa USING (doc_id) GROUP BY lang, gram) WHERE rank < 300),
dr AS (SELECT * FROM (SELECT doc_id, gram, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, gram) - 1 AS rank FROM gr) WHERE rank < 300),
ds AS (SELECT doc_id, lang, sum(abs(dr.rank - pr.rank) - 300) AS near FROM dr JOIN pr USING (gram) GROUP BY ALL), df AS (SELECT doc_id, count(*) * 300 AS far FROM dr GROUP BY doc_id),
de AS (SELECT doc_id, lang AS language, (far + near)::BIGINT AS distance FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY near, lang) AS k FROM ds) JOIN df USING (doc_id) WHERE k = 1)"""


@registry.add(f"""WITH {NGRAM_SQL} SELECT doc_id, language, distance, CASE WHEN language IS NULL THEN 'source=' || source ELSE 'language=' || language || ',language_name=' || CASE language WHEN 'de' THEN 'German' WHEN 'en' THEN 'English' WHEN 'es' THEN 'Spanish' ELSE 'French' END || ',source=' || source END AS metadata
FROM documents LEFT JOIN de USING (doc_id)""")
def language_profiles(spark, sf_dir):
    """The nearest of the languages' trigram profiles, merged into each document's metadata in place of a wrong entry."""
    docs = read(spark, sf_dir, "documents")
    found = cut(N.detect(docs, N.profiles(docs, "doc_id"), "doc_id"))
    known = F.create_map(F.lit("source"), F.col("source"), F.lit("language"), F.lit("?"))
    plain = F.map_filter(known, lambda k, _: k == "source")
    told = N.with_language(docs.select("doc_id", F.when(F.col("doc_id") % 2 == 0, known).otherwise(plain).alias("metadata")), found, "doc_id")
    pairs = F.filter(F.transform(F.map_entries("metadata"), lambda e: F.concat_ws("=", e["key"], e["value"])), lambda x: x != "language=?")
    return told.join(found, "doc_id", "left").select("doc_id", "language", "distance", F.array_join(F.array_sort(pairs), ",").alias("metadata"))


@registry.add(f"""WITH {NGRAM_SQL} SELECT d.lang, count(*) AS n, count(*) FILTER (language = d.lang) AS hits FROM documents d JOIN de USING (doc_id) WHERE d.lang IS NOT NULL AND doc_id NOT IN (SELECT doc_id FROM sa) GROUP BY d.lang""")
def language_accuracy(spark, sf_dir):
    """Documents that no profile has learned from: how many are told right."""
    docs = read(spark, sf_dir, "documents")
    found = N.detect(docs, N.profiles(docs, "doc_id"), "doc_id")
    fresh = docs.select("doc_id", "lang").where("lang IS NOT NULL").join(N.labelled_sample(docs.select("doc_id", "lang"), "doc_id"), "doc_id", "left_anti")
    return fresh.join(found, "doc_id").groupBy("lang").agg(F.count("*").alias("n"), F.count_if(F.col("language") == F.col("lang")).alias("hits"))


@registry.add("SELECT doc_id, round(CASE WHEN doc_id % 3 = 0 THEN (3.0 + 2) / (5 + len(regexp_extract_all(text, '\\p{L}'))) WHEN doc_id % 3 = 1 AND regexp_matches(text, '\\p{L}') THEN 0.0 END, 6) AS indic FROM documents")
def indic_share(spark, sf_dir):
    """Whole texts, every third among Devanagari and Tamil letters, every third stripped of its letters."""
    d = F.col("doc_id") % 3
    text = F.when(d == 0, F.concat(F.lit("कखक "), "text", F.lit(" தம"))).when(d == 1, F.col("text")).otherwise(F.regexp_replace("text", r"\p{L}", ""))
    return read(spark, sf_dir, "documents").select("doc_id", F.round(X.indic_share(text), 6).alias("indic"))
