from plantscribe.operators import plugins as P


def test_rerank_falls_back_by_question(spark):
    rows = [(1, "q", 10, 0.2, "aa"), (1, "q", 11, 0.9, "b"), (2, "bad", 10, 0.1, "aaaa"), (2, "bad", 12, 0.5, "b"), (3, "short", 1, 0.3, "x"), (3, "short", 2, 0.2, None)]
    pool = spark.createDataFrame(rows, "query_id int, query_text string, doc_id int, score double, text string")

    def scorer(question, texts):
        if question == "bad":
            raise ValueError("no")
        return [len(t) for t in texts] if question == "q" else [1.0]

    got = [(r.query_id, r.doc_id, r.final_rank, r.by_model) for r in P.rerank(pool, ["doc_id"], scorer).orderBy("query_id", "final_rank").collect()]
    assert got == [(1, 10, 1, True), (1, 11, 2, True), (2, 12, 1, False), (2, 10, 2, False), (3, 1, 1, False), (3, 2, 2, False)]
    none = [(r.query_id, r.doc_id) for r in P.rerank(pool, ["doc_id"]).orderBy("query_id", "final_rank").collect()]
    assert none == [(1, 11), (1, 10), (2, 12), (2, 10), (3, 1), (3, 2)]


def test_judges_that_fail_count_as_false(spark):
    rows = spark.createDataFrame([(1, "q", "yes"), (2, "q", "no"), (3, "q", None), (4, "q", "odd")], "id int, query_text string, text string")

    def judge(question, text):
        return {"yes": True, "no": False, "odd": "perhaps"}[text]

    assert [r.relevant for r in P.judged(rows, judge).orderBy("id").collect()] == [True, False, False, False]
    assert not any(r.relevant for r in P.judged(rows, None).collect())


def test_parsers_of_a_registry(spark):
    docs = spark.createDataFrame([(1, "text/plain", "a\r\n\r\nb"), (2, "application/x-odd", "z"), (3, "text/csv", "1,2"), (4, "text/csv", ""), (5, None, "x"), (6, "text/plain", None)], "doc_id int, mime string, text string")
    parsed = P.Parsers().add(("text/csv",), lambda t: [str(int(x)) for x in t.split(",")]).parse(docs)
    got = {r.doc_id: (r.status, r.n_chunks, r.error) for r in parsed.collect()}
    assert got[1] == ("CHUNKED", 2, None) and got[3] == ("CHUNKED", 2, None) and got[6] == ("CHUNKED", 0, None)
    assert got[2] == ("FAILED", 0, "no parser for application/x-odd") and got[5] == ("FAILED", 0, "no parser for None")
    assert got[4][:2] == ("FAILED", 0) and got[4][2].startswith("ValueError")
    assert [(r.doc_id, r.chunk_index, r.text) for r in P.chunk_rows(parsed).orderBy("doc_id", "chunk_index").collect()] == [(1, 0, "a"), (1, 1, "b"), (3, 0, "1"), (3, 1, "2")]
