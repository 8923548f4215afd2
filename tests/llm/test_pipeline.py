import corpus_pipeline
from plantscribe.llm.common import table

from .test_duplicates import brute_substrings
from .test_shingles import brute_components

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = table(spark, SF, "documents")
    kept = {r.doc_id: r for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        rows = out.collect()
        assert tuple(out.columns) == corpus_pipeline.COLUMNS and {r.doc_id for r in rows} <= set(kept)
        if name in ("quality_classifier", "language_id"):
            assert all(kept[r.doc_id] == r for r in rows) and len(rows) > 0.7 * len(kept)
        if name == "simhash_near_dedup":
            comp, _ = brute_components([(d, r.text) for d, r in kept.items()])
            assert {r.doc_id for r in rows} == {d for d, c in comp.items() if d == c}
        if name == "substring_dedup":
            want = {d: n - gone for d, n, gone, _ in brute_substrings([(d, r.text) for d, r in kept.items()])}
            assert {r.doc_id: len((r.text or "").encode().split()) for r in rows} == want
        kept = {r.doc_id: r for r in rows}
        docs = spark.createDataFrame(rows, out.schema)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {r.doc_id for r in packed} == set(kept)


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 100


def test_stages_on_odd_rows(spark):
    """Null ids and texts, repeated rows, ties, long texts, clashing columns, an empty table."""
    base = table(spark, SF, "documents")
    names = ["upper", "digits", "lang_pred", "score", "row", "low", "digest", "spans", "node", "component", "_found", "pack_group", "number"]
    odd = spark.createDataFrame([(None, "alpha beta gamma delta epsilon zeta eta theta iota kappa " * 3, "en", "s", 5), (None, None, None, None, None), (5000, "", "en", "s", 0), (5001, "word " * 400_000, "en", "s", 9)], base.schema)
    docs = base.union(base.limit(30)).union(odd)
    wide = docs.selectExpr("*", *(f"1 AS `{n}`" for n in names))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, wide, SF)
        rows = out.count()
        assert stage(spark, wide.limit(0), SF).count() == 0
        if name == "simhash_near_dedup":
            ids = [r.doc_id for r in out.collect()]
            assert len({d for d in ids if d is not None}) == len([d for d in ids if d is not None]) and None in ids
        elif name == "substring_dedup":
            assert rows == docs.count()
        elif name == "best_fit_packing":
            assert out.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
