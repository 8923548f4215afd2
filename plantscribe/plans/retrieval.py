"""Chunking, lexical, dense and merged retrieval over ``documents``, ``benchmark`` and ``embeddings``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ..functions import text as X
from ..operators import chunking as C, evaluation as E, plugins as P, retrieval as R
from ..session import cut
from .base import CHUNKS_SQL, POSTINGS_SQL, Registry, read, sql_list, tokens_sql

registry = Registry()
KEYS = ["doc_id", "chunk_index"]


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.token_windows(read(spark, sf_dir, "documents"), ["doc_id"])


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query_text"))


@registry.add(f"WITH {CHUNKS_SQL} SELECT doc_id, chunk_index, token_count, md5(text) AS text_md5, sha256(doc_id || ':' || chunk_index) AS chunk_id FROM chunks")
def chunk_windows(spark, sf_dir):
    return chunks(spark, sf_dir).select(*KEYS, "token_count", F.md5("text").alias("text_md5"), C.chunk_id(F.col("doc_id"), F.col("chunk_index")).alias("chunk_id"))


@registry.add(f"WITH {CHUNKS_SQL} SELECT doc_id, chunk_index, left(text, 500) AS text, token_count, false AS has_table_data, false AS has_figure FROM chunks")
def chunk_listing(spark, sf_dir):
    return C.listing(chunks(spark, sf_dir))


@registry.add("""SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::INT AS chunk_index, text FROM (
  SELECT doc_id, i, regexp_replace(p, '^[ \\t\\r\\n]+|[ \\t\\r\\n]+$', '', 'g') AS text FROM (
    SELECT doc_id, unnest(string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10))) AS p, generate_subscripts(string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)), 1) AS i FROM documents)) WHERE text <> ''""")
def paragraph_chunks(spark, sf_dir):
    return C.paragraphs(read(spark, sf_dir, "documents"), ["doc_id"], separator="\n")


MARKDOWN = "concat('## ', doc_id, char(10), text, char(10), char(10), ' # ', source, char(13), char(10), source, ' of ', lang, char(10), 'length ', n_chars)"


@registry.add("""WITH md AS (SELECT doc_id, string_split('## ' || doc_id || chr(10) || text || chr(10) || chr(10) || ' # ' || source || chr(10) || source || ' of ' || lang || chr(10) || 'length ' || n_chars, chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, trim(unnest(ls)) AS t, unnest(range(len(ls))) AS k FROM md), h AS (SELECT *, starts_with(t, '#') AS h FROM l),
c AS (SELECT *, (h OR t = '' OR coalesce(lag(h) OVER (PARTITION BY doc_id ORDER BY k), true))::INT AS cut FROM h),
b AS (SELECT *, sum(cut) OVER w AS b, last_value(CASE WHEN h THEN trim(regexp_replace(t, '^#+', '')) END IGNORE NULLS) OVER w AS head FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY k)),
g AS (SELECT doc_id, b, min(k) AS k, bool_or(h) AS h, max(head) AS head, string_agg(t, chr(10) ORDER BY k) AS t FROM b WHERE t <> '' GROUP BY doc_id, b)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1)::INT AS chunk_index, CASE WHEN h THEN 'heading' ELSE 'paragraph' END AS chunk_type, CASE WHEN NOT h THEN head END AS parent_section_header, md5(CASE WHEN h THEN head ELSE t END) AS text_md5 FROM g""")
def markdown_chunks(spark, sf_dir):
    """Whole texts between headings of two kinds; lines of a text that start with a number sign are headings too."""
    rows = read(spark, sf_dir, "documents").select("doc_id", F.expr(MARKDOWN).alias("text"))
    return C.markdown_sections(rows, ["doc_id"]).withColumn("text_md5", F.md5("text")).drop("text")


@registry.add(r"""WITH p AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^[ \t\r\n]+|[ \t\r\n]+$', '', 'g')), lambda x: x <> '') AS ps FROM documents)
SELECT doc_id, unnest(range(len(ps)))::INT AS chunk_index, md5(unnest(ps)) AS text_md5 FROM p""")
def blank_line_paragraphs(spark, sf_dir):
    """Lines of the texts with a blank line between them, in two kinds of line ends."""
    between = F.when(F.col("doc_id") % 2 == 0, "\r\n\r\n").otherwise("\n\n")
    rows = read(spark, sf_dir, "documents").select("doc_id", F.replace("text", F.lit("\n"), between).alias("text"))
    return C.paragraphs(rows, ["doc_id"]).select("doc_id", "chunk_index", F.md5("text").alias("text_md5"))


@registry.add(f"WITH {POSTINGS_SQL} SELECT doc_id, chunk_index, term, round(tf, 9) AS tf FROM postings")
def term_frequencies(spark, sf_dir):
    return R.postings(chunks(spark, sf_dir), KEYS).withColumn("tf", F.round("tf", 9))


@registry.add(f"WITH {POSTINGS_SQL} SELECT term, count(DISTINCT doc_id) AS df, (SELECT count(DISTINCT doc_id) FROM postings) AS n_docs FROM postings GROUP BY term")
def document_frequencies(spark, sf_dir):
    rows = R.postings(chunks(spark, sf_dir), KEYS)
    return R.document_frequencies(rows).crossJoin(F.broadcast(rows.agg(F.countDistinct("doc_id").alias("n_docs"))))  # one row


BM25_SQL = f"""{POSTINGS_SQL},
q AS (SELECT DISTINCT query_id, term FROM (SELECT item_id AS query_id, unnest({tokens_sql('text')}) AS term FROM benchmark)),
df AS (SELECT term, count(DISTINCT doc_id) AS df FROM postings GROUP BY term), n AS (SELECT count(DISTINCT doc_id) AS n FROM postings),
sc AS (SELECT query_id, doc_id, chunk_index, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5)), 9) AS s FROM q JOIN postings USING (term) JOIN df USING (term), n GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, doc_id, chunk_index)::INT AS rank, max(s) OVER (PARTITION BY query_id) AS m FROM sc),
bm25 AS (SELECT query_id, doc_id, chunk_index, round(s / CASE WHEN m = 0 THEN 1 ELSE m END, 6) AS score, rank FROM rk WHERE rank <= %d)"""


def lexical(spark, sf_dir, k=10):
    return R.bm25(chunks(spark, sf_dir), R.query_terms(questions(spark, sf_dir)), KEYS, k=k)


@registry.add(f"WITH {BM25_SQL % 10} SELECT query_id, doc_id, chunk_index, score, rank FROM bm25")
def bm25_topk(spark, sf_dir):
    return lexical(spark, sf_dir)


SCOPED_SQL = f"""WITH {POSTINGS_SQL}, sp AS (SELECT p.*, d.lang AS role_scope FROM postings p JOIN documents d USING (doc_id)),
q AS (SELECT DISTINCT query_id, role_scope, term FROM (SELECT item_id AS query_id, ['en', 'de', 'fr', 'es'][item_id % 4 + 1] AS role_scope, unnest({tokens_sql('text')}) AS term FROM benchmark)),
df AS (SELECT role_scope, term, count(DISTINCT doc_id) AS df FROM sp GROUP BY role_scope, term), n AS (SELECT role_scope, count(DISTINCT doc_id) AS n FROM sp GROUP BY role_scope),
sc AS (SELECT query_id, doc_id, chunk_index, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5)), 9) AS s FROM q JOIN sp USING (role_scope, term) JOIN df USING (role_scope, term) JOIN n USING (role_scope) GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, doc_id, chunk_index)::INT AS rank, max(s) OVER (PARTITION BY query_id) AS m FROM sc)
SELECT query_id, doc_id, chunk_index, round(s / CASE WHEN m = 0 THEN 1 ELSE m END, 6) AS score, rank FROM rk WHERE rank <= 5"""


@registry.add(SCOPED_SQL)
def bm25_by_scope(spark, sf_dir):
    """The scope stands for the caller's role: only postings of the query's own scope match."""
    docs = read(spark, sf_dir, "documents").withColumnRenamed("lang", "role_scope")
    rows = C.token_windows(docs, ["doc_id", "role_scope"])
    asked = questions(spark, sf_dir).withColumn("role_scope", F.element_at(F.array(*map(F.lit, ("en", "de", "fr", "es"))), (F.col("query_id") % 4 + 1).cast("int")))
    return R.bm25(rows, R.query_terms(asked, extra=["role_scope"]), KEYS, scope=["role_scope"], k=5)


KNN_SQL = """kv AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
ku AS (SELECT vec_id, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS e FROM kv),
ks AS (SELECT a.vec_id AS query_id, b.vec_id, round(list_dot_product(a.e, b.e), 9) AS s FROM ku a, ku b WHERE a.vec_id % 20 = 0),
knn AS (SELECT query_id, vec_id, round(s, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id)::INT AS rank FROM ks) WHERE rank <= 10)"""


def dense(spark, sf_dir, k=10, asked=None):
    """Neighbours of every twentieth vector, or of those among them that ``asked`` names: a query's neighbours don't depend on other queries."""
    rows = read(spark, sf_dir, "embeddings")
    queries = rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return R.nearest(queries if asked is None else queries.join(asked, "query_id", "left_semi"), rows, k)


@registry.add(f"WITH {KNN_SQL} SELECT query_id, vec_id, score, rank FROM knn")
def knn_topk(spark, sf_dir):
    return dense(spark, sf_dir)


MERGED_SQL = f"""{BM25_SQL % 20}, {KNN_SQL},
dense AS (SELECT query_id, vec_id AS doc_id, 0 AS chunk_index, score, rank FROM knn WHERE query_id IN (SELECT item_id FROM benchmark)),
un AS (SELECT *, 'lexical' AS source FROM bm25 UNION ALL SELECT *, 'vector' FROM dense),
merged AS (SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id, chunk_index ORDER BY score DESC, source) AS r FROM un) WHERE r = 1),
pool AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id, chunk_index)::INT AS pool_rank FROM merged) WHERE pool_rank <= 12)"""


def merged(spark, sf_dir):
    """Each branch over-fetches twice the wanted ten."""
    asked = questions(spark, sf_dir).select("query_id")
    vectors = dense(spark, sf_dir, asked=asked).select("query_id", F.col("vec_id").alias("doc_id"), F.lit(0).alias("chunk_index"), "score", "rank")
    return R.merge_candidates(lexical(spark, sf_dir, 20), vectors, KEYS)


@registry.add(f"WITH {MERGED_SQL} SELECT query_id, doc_id, chunk_index, score, rank, source FROM merged")
def hybrid_merge(spark, sf_dir):
    return merged(spark, sf_dir)


@registry.add(f"WITH {MERGED_SQL}, arrived AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY source, rank, doc_id, chunk_index)::INT AS arrival_rank FROM merged) SELECT query_id, doc_id, chunk_index, score, source, arrival_rank FROM arrived WHERE arrival_rank <= 12")
def rerank_pool_by_arrival(spark, sf_dir):
    """The cap in the order of insertion, lexical hits first."""
    return R.rerank_pool(merged(spark, sf_dir), KEYS, by="arrival").select("query_id", *KEYS, "score", "source", F.col("pool_rank").alias("arrival_rank"))


@registry.add(f"WITH {MERGED_SQL} SELECT query_id, doc_id, chunk_index, score, source, pool_rank FROM pool")
def rerank_pool(spark, sf_dir):
    return R.rerank_pool(merged(spark, sf_dir), KEYS).drop("rank")


def reranked(spark, sf_dir):
    """Pool rows with their texts (joined only now) and the model-free scorer."""
    pool = cut(R.rerank_pool(merged(spark, sf_dir), KEYS))  # twelve rows a question at most
    texts = C.token_windows(read(spark, sf_dir, "documents").join(pool.select("doc_id").distinct(), "doc_id", "left_semi"), ["doc_id"])
    pool = pool.join(texts, KEYS).join(questions(spark, sf_dir), "query_id")
    scored = pool.withColumn("rerank_score", F.round(R.overlap_scorer("query_text", "text"), 6))
    order = W.partitionBy("query_id").orderBy(F.desc("rerank_score"), *KEYS)
    return scored.withColumn("final_rank", F.row_number().over(order))


RERANK_SQL = f"""{MERGED_SQL},
rr AS (SELECT p.*, c.text, round(CASE WHEN len(qt) > 0 THEN len(list_intersect(qt, {tokens_sql('c.text')})) / len(qt) ELSE 0 END, 6) AS rerank_score
  FROM pool p JOIN chunks c USING (doc_id, chunk_index) JOIN (SELECT item_id AS query_id, list_distinct({tokens_sql('text')}) AS qt FROM benchmark) USING (query_id)),
fin AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, doc_id, chunk_index)::INT AS final_rank FROM rr)"""


FALLBACK_SQL = f"""{RERANK_SQL}, fb AS (SELECT query_id, doc_id, chunk_index, query_id % 3 <> 0 AS by_model, CASE WHEN query_id % 3 <> 0 THEN length(text) % 97 ELSE score END::DOUBLE AS rerank_score FROM rr)"""


@registry.add(f"WITH {FALLBACK_SQL} SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, doc_id, chunk_index)::INT AS final_rank FROM fb")
def rerank_fallback(spark, sf_dir):
    """A scorer that fails on every third question: its candidates keep the retrieval score and order."""
    def scorer(question, texts):
        if question.startswith("fail"):
            raise RuntimeError("the model is away")
        return [len(t) % 97 for t in texts]

    pool = reranked(spark, sf_dir).drop("rerank_score", "final_rank")
    pool = pool.withColumn("query_text", F.when(F.col("query_id") % 3 == 0, F.concat(F.lit("fail "), "query_text")).otherwise(F.col("query_text")))
    return P.rerank(pool, KEYS, scorer).select("query_id", *KEYS, "by_model", "rerank_score", "final_rank")


@registry.add(f"WITH {RERANK_SQL} SELECT query_id, round(avg((doc_id % 5 <> 0 AND length(text) % 2 = 0)::INT), 4) AS precision FROM rr GROUP BY query_id")
def judge_fallback(spark, sf_dir):
    """A judge that fails on some chunks: they count as not relevant."""
    def judge(question, text):
        if text.startswith("odd"):
            raise TimeoutError("no answer")
        return len(text) % 2 == 1

    rows = reranked(spark, sf_dir).select("query_id", "query_text", F.concat(F.when(F.col("doc_id") % 5 == 0, "odd").otherwise("x"), "text").alias("text"))
    return E.context_precision(P.judged(rows, judge).select("query_id", "relevant"), questions(spark, sf_dir)).join(rows.select("query_id").distinct(), "query_id", "left_semi")


@registry.add(f"WITH {RERANK_SQL} SELECT query_id, doc_id, chunk_index, rerank_score, final_rank FROM fin")
def rerank_scores(spark, sf_dir):
    return reranked(spark, sf_dir).select("query_id", *KEYS, "rerank_score", "final_rank")


@registry.add(f"""WITH {RERANK_SQL}, sp AS (SELECT *, sum(length(text) // 4) OVER (PARTITION BY query_id ORDER BY final_rank ROWS UNBOUNDED PRECEDING) AS spent FROM fin),
nb AS (SELECT query_id, final_rank, '[source_' || final_rank || '] ' || text AS t FROM sp WHERE spent <= 6000)
SELECT query_id, count(*) AS n_sources, md5(string_agg(t, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY final_rank)) AS context_md5, sum(length(t) // 4)::BIGINT AS tokens FROM nb GROUP BY query_id""")
def token_budget_context(spark, sf_dir):
    kept = R.token_budget(reranked(spark, sf_dir), rank="final_rank").withColumn("t", F.concat(F.lit("[source_"), F.col("final_rank"), F.lit("] "), F.col("text")))
    return kept.groupBy("query_id").agg(F.count("*").alias("n_sources"), F.md5(R.ordered_text("t", "final_rank")).alias("context_md5"), F.sum(X.approximate_tokens(F.col("t"))).alias("tokens"))


@registry.add(f"""WITH {RERANK_SQL}, b AS (SELECT query_id, doc_id, chunk_index, final_rank, '[Source: doc ' || doc_id || ', p.' || (chunk_index + 1) || ']' || chr(10) || text AS block FROM fin),
sp AS (SELECT *, sum(length(block) // 4) OVER (PARTITION BY query_id ORDER BY final_rank ROWS UNBOUNDED PRECEDING) AS spent FROM b)
SELECT query_id, count(*) AS n_blocks, md5(string_agg(block, chr(10) || chr(10) ORDER BY final_rank)) AS context_md5 FROM sp WHERE spent <= 4000 GROUP BY query_id""")
def context_blocks(spark, sf_dir):
    block = F.concat(F.lit("[Source: doc "), F.col("doc_id"), F.lit(", p."), F.col("chunk_index") + 1, F.lit("]\n"), F.col("text"))
    kept = R.token_budget(reranked(spark, sf_dir).withColumn("block", block), 4000, "block", "final_rank")
    return kept.groupBy("query_id").agg(F.count("*").alias("n_blocks"), F.md5(R.ordered_text("block", "final_rank", "\n\n")).alias("context_md5"))


@registry.add(f"""WITH {RERANK_SQL} SELECT query_id, count(*) AS n_blocks, md5(string_agg('[chunk_id: ' || sha256(doc_id || ':' || chunk_index) || ' | doc ' || doc_id || ', p.' || CASE WHEN chunk_index = 0 THEN '?' ELSE chunk_index::VARCHAR END || ']' || chr(10) || text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY final_rank)) AS context_md5 FROM fin GROUP BY query_id""")
def chunk_id_blocks(spark, sf_dir):
    """Blocks with chunk ids; the first chunk stands for one without a page."""
    block = R.chunk_block(C.chunk_id(F.col("doc_id"), F.col("chunk_index")), F.concat(F.lit("doc "), "doc_id"), F.col("chunk_index"), F.col("text"))
    return reranked(spark, sf_dir).withColumn("block", block).groupBy("query_id").agg(F.count("*").alias("n_blocks"), F.md5(R.ordered_text("block", "final_rank")).alias("context_md5"))


OEM_WORDS = "|".join(X.TITLE_CLASSES["oem_manual"])


@registry.add(f"""WITH {BM25_SQL % 10}, tt AS (SELECT b.*, CASE doc_id % 4 WHEN 0 THEN 'Pump OEM Manual ' WHEN 1 THEN 'DATA SHEET ' WHEN 2 THEN 'Service Guide ' ELSE 'Note ' END || doc_id AS title FROM bm25 b)
SELECT query_id, doc_id, chunk_index, rank FROM tt WHERE regexp_matches(lower(title), '{OEM_WORDS}')""")
def oem_manual_lookup(spark, sf_dir):
    """Maker's documents among the top ten of a question, filtered after the ranking."""
    kind = F.col("doc_id") % 4
    title = F.concat(F.when(kind == 0, "Pump OEM Manual ").when(kind == 1, "DATA SHEET ").when(kind == 2, "Service Guide ").otherwise("Note "), F.col("doc_id"))
    return lexical(spark, sf_dir).where(X.title_class(title, "oem_manual")).select("query_id", *KEYS, "rank")


FANNED_SQL = BM25_SQL.replace("SELECT item_id AS query_id, unnest(", "SELECT item_id * 10 + k AS query_id, unnest(").replace("FROM benchmark)", "FROM (SELECT item_id, k, text || ' ' || c AS text FROM benchmark, (SELECT unnest(range(6)) AS k, unnest(['Equipment', 'Method', 'Material', 'Man', 'Environment', 'Measurement']) AS c)))")


@registry.add(f"WITH {FANNED_SQL % 3} SELECT query_id // 10 AS incident_id, ['Equipment', 'Method', 'Material', 'Man', 'Environment', 'Measurement'][query_id % 10 + 1] AS category, doc_id, chunk_index, score, rank FROM bm25")
def cause_evidence(spark, sf_dir):
    """One retrieval for each incident and cause category; a category without a hit has no rows."""
    from ..operators import relational as O

    asked = O.fan_out(read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("incident_id"), "text"))
    number = F.array_position(F.array(*map(F.lit, O.CAUSE_CATEGORIES)), F.col("category")) - 1
    terms = R.query_terms(asked.withColumn("query_id", F.col("incident_id") * 10 + number))
    found = R.bm25(chunks(spark, sf_dir), terms, KEYS, k=3)
    category = F.element_at(F.array(*map(F.lit, O.CAUSE_CATEGORIES)), (F.col("query_id") % 10 + 1).cast("int"))
    return found.select(F.floor(F.col("query_id") / 10).alias("incident_id"), category.alias("category"), *KEYS, "score", "rank")


COMPRESS_SQL = f"""{CHUNKS_SQL}, c AS (SELECT doc_id, string_agg(text, ' ' ORDER BY chunk_index) AS context FROM chunks GROUP BY doc_id),
cw AS (SELECT doc_id, context, length(context) // 4 >= 2000 AS long, regexp_extract_all(context, '[^\\x20\\x09-\\x0D]+') AS w FROM c),
cc AS (SELECT doc_id, context, long, CASE WHEN long THEN array_to_string(list_filter(w, lambda x: NOT list_contains({sql_list(X.INDEX_STOP_WORDS)}, lower(x)))[1:ceil(len(w) * 0.7)::INT], ' ') ELSE context END AS compressed FROM cw)"""


@registry.add(f"WITH {COMPRESS_SQL} SELECT doc_id, length(context) // 4 AS tokens, long AS was_compressed, md5(compressed) AS compressed_md5, round((length(compressed) // 4) / (length(context) // 4), 6) AS ratio FROM cc WHERE length(context) // 4 > 0")
def context_compression(spark, sf_dir):
    """Contexts of 2,000 tokens and more keep about 70 % of their words; shorter ones pass. Whole documents stand for contexts."""
    whole = chunks(spark, sf_dir).groupBy("doc_id").agg(R.ordered_text("text", "chunk_index", " ").alias("context")).where(X.approximate_tokens(F.col("context")) > 0)
    return R.compress(whole, scorer=R.keep_share).select("doc_id", X.approximate_tokens(F.col("context")).alias("tokens"), "was_compressed", F.md5("compressed").alias("compressed_md5"), F.round("ratio", 6).alias("ratio"))


@registry.add("""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings)
SELECT vec_id, round(sqrt(list_dot_product(e, e)), 6) AS norm, round(list_dot_product(list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))), list_transform(e, lambda x: x / sqrt(list_dot_product(e, e)))), 6) AS unit_norm, len(e)::INT AS dimensions FROM v""")
def unit_vectors(spark, sf_dir):
    v = F.col("embedding")
    return read(spark, sf_dir, "embeddings").select("vec_id", F.round(F.sqrt(X.dot(v, v)), 6).alias("norm"), F.round(X.dot(X.unit(v), X.unit(v)), 6).alias("unit_norm"), F.size(v).alias("dimensions"))


@registry.add("""SELECT item_id AS query_id, sha256(concat_ws('|', text, 'public', '10')) AS request_key FROM benchmark""")
def request_keys(spark, sf_dir):
    return questions(spark, sf_dir).select("query_id", X.request_key(F.col("query_text"), F.lit("public"), F.lit(10)).alias("request_key"))


@registry.add(f"""WITH {BM25_SQL % 10}, tt AS (SELECT b.*, CASE doc_id % 5 WHEN 0 THEN 'Safety Standard ' WHEN 1 THEN 'Operating Procedure ' WHEN 2 THEN 'Pump Manual ' ELSE 'Note ' END || doc_id AS title FROM bm25 b)
SELECT query_id, doc_id, chunk_index, rank, regexp_matches(lower(title), 'regulation|osha|cfr|code of federal|standard|ansi|iso |api rp|nfpa|epa') AS is_regulation,
 regexp_matches(lower(title), 'sop|procedure|work instruction|standard operating procedure|checklist|instructions') AS is_procedure FROM tt
WHERE regexp_matches(lower(title), 'regulation|osha|cfr|code of federal|standard|ansi|iso |api rp|nfpa|epa|sop|procedure|work instruction|checklist|instructions')""")
def class_filtered_retrieval(spark, sf_dir):
    """Title classes after the top ten, so fewer than ten may remain; regulations and procedures are the citation universe."""
    kind = F.col("doc_id") % 5
    title = F.concat(F.when(kind == 0, "Safety Standard ").when(kind == 1, "Operating Procedure ").when(kind == 2, "Pump Manual ").otherwise("Note "), F.col("doc_id"))
    found = lexical(spark, sf_dir).withColumns({"is_regulation": X.title_class(title, "regulation"), "is_procedure": X.title_class(title, "procedure")})
    return found.where("is_regulation OR is_procedure").select("query_id", *KEYS, "rank", "is_regulation", "is_procedure")


@registry.add(f"WITH {CHUNKS_SQL} SELECT doc_id, sha256(doc_id || ':' || chunk_index) AS chunk_id FROM chunks")
def has_chunk_edges(spark, sf_dir):
    return chunks(spark, sf_dir).select("doc_id", C.chunk_id(F.col("doc_id"), F.col("chunk_index")).alias("chunk_id"))


@registry.add(f"""WITH t AS (SELECT item_id, unnest({tokens_sql('text')}) AS t FROM benchmark), c AS (SELECT item_id, (('0x' || substr(md5(t), 1, 7))::BIGINT % 64)::INT AS dimension, count(*) AS n FROM t GROUP BY ALL)
SELECT item_id, dimension, round(n / sqrt(sum(n * n) OVER (PARTITION BY item_id)), 6) AS weight FROM c""")
def hashed_vectors(spark, sf_dir):
    """The embedder that needs no model: unit vectors of hashed term counts, sparse."""
    return R.term_vectors(read(spark, sf_dir, "benchmark"), ["item_id"])
