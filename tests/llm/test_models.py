import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from plantscribe.llm import language_id, quality_model, toxicity
from plantscribe.llm.common import table

from .conftest import TEXTS

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, SF, "documents")


@pytest.fixture(scope="module")
def labels(spark):
    return table(spark, SF, "labels")


def test_language_held_out_accuracy(docs, odd_docs, no_docs):
    model = language_id.train(docs)
    assert (model.weights == 0).mean() > 0.2  # sparse
    got = language_id.predict(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").select("lang", "lang_pred", "score").toPandas()
    assert (got.lang == got.lang_pred).mean() > 0.97 and got.score.between(0, 1).all()
    odd = {r.doc_id: r for r in language_id.predict(odd_docs, model).collect()}
    assert all((odd[k].lang_pred == "und") == (not any(map(str.isalpha, t or ""))) for k, t in enumerate(TEXTS))
    nothing = language_id.train(no_docs)
    assert {r.lang_pred for r in language_id.predict(odd_docs, nothing).collect()} == {"und"}
    assert language_id.predict(no_docs, model).count() == 0


def test_quality_held_out_accuracy(docs, labels, odd_docs, no_docs):
    got = quality_model.classify(docs, labels).where("held_out").join(labels, "doc_id").toPandas()
    assert (got.predicted == got.quality).mean() > 0.95 and got.score.between(0, 1).all()
    odd = quality_model.classify(odd_docs, labels)
    assert odd.count() == len(TEXTS) and odd.where("score IS NULL OR isnan(score)").count() == 0
    assert quality_model.classify(no_docs, labels).count() == 0
    unlearned = quality_model.classify(odd_docs, labels.limit(0)).collect()
    assert {r.score for r in unlearned} == {0.5}


def test_pairs_rank_what_they_prefer():
    rng = np.random.default_rng(0)
    good, bad = rng.normal(1, 1, (300, 3)) * [1, 0, 1], rng.normal(-1, 1, (40, 3)) * [1, 0, 1]
    w = quality_model.bradley_terry(good, bad)
    assert w[0] > 0.3 and w[2] > 0.3 and abs(w[1]) < 1e-6


def test_toxicity_held_out(docs, labels, odd_docs, no_docs):
    got = toxicity.classify(docs, labels).where("held_out").join(labels, "doc_id").toPandas()
    clean, toxic = got[got.toxic == 0], got[got.toxic == 1]
    assert (clean.predicted == 0).mean() > 0.97 and got.score.between(0, 1).all()
    assert (toxic.predicted == 1).mean() > 0.6  # few examples at this size, and some texts are junk
    odd = toxicity.classify(odd_docs.union(odd_docs), labels)
    assert odd.count() == 2 * len(TEXTS) and odd.groupBy("doc_id").agg(F.countDistinct("score").alias("n")).where("n > 1").count() == 0
    assert toxicity.classify(odd_docs, labels.limit(0)).where("score BETWEEN 0 AND 1").count() == len(TEXTS)
    assert toxicity.classify(no_docs, labels).count() == 0


def brute_terms(text):
    from collections import Counter

    word, out = "", Counter()
    for c in (text or "").lower() + " ":
        if ord(c) > 127 or c.isalpha():
            word += c
        elif word:
            out[toxicity.TERMS[word.encode()]] += 1
            word = ""
    return out


def test_toxicity_query_against_brute_force(spark, docs, labels):
    """Every step anew: document frequencies, emphasis, cosines with all examples, votes; only the calibration is shared."""
    import zlib

    small = docs.where("doc_id < 160").union(docs.where("doc_id < 3"))
    texts = [(r.doc_id, r.text) for r in small.collect()]
    marked = {r.doc_id: r.toxic for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 3 != 1}
    found = [brute_terms(t) for _, t in texts]
    df = np.zeros(toxicity.DIMENSIONS)
    for f in found:
        df[list(f)] += 1
    idf = np.log((1 + len(texts)) / (1 + df)) + 1
    examples = [(d, marked[d], f) for (d, _), f in zip(texts, found, strict=True) if d in marked and f]
    share = (sum(y for _, y, _ in examples) + 0.5) / (len(examples) + 1)
    have, bad = np.zeros(len(df)), np.zeros(len(df))
    for _, y, f in examples:
        have[list(f)] += 1
        bad[list(f)] += y
    weight = idf * np.maximum(1, (bad + 10 * share) / (have + 10) / share) ** 2

    def vector(f):
        v = np.zeros(len(df))
        v[list(f)] = (1 + np.log(list(f.values()))) * weight[list(f)]
        return v / max(np.linalg.norm(v), 1e-12)

    vectors = np.stack([vector(f) for *_, f in examples])
    index = toxicity.train(small, labels)
    got = sorted(toxicity.score(small, index).collect(), key=lambda r: r.doc_id)
    for r, (_, f) in zip(got, sorted(zip([d for d, _ in texts], found, strict=True), key=lambda x: x[0]), strict=True):
        if not f:
            assert r.score == pytest.approx(share) and not r.evidence
            continue
        cos = vectors @ vector(f)
        order = sorted(range(len(examples)), key=lambda k: (-round(cos[k], 6), examples[k][0]))[:15]
        order = [k for k in order if cos[k] > 0]
        assert [e.cosine for e in r.evidence] == pytest.approx([cos[k] for k in order], abs=1e-5)
        w = [1 / (1.05 - min(e.cosine, 1)) for e in r.evidence]
        vote = (sum(x * e.toxic for x, e in zip(w, r.evidence, strict=True)) + 0.5 * share) / (sum(w) + 0.5)
        assert all(e.toxic == marked[e.doc_id] for e in r.evidence)
        odds = np.log(min(max(vote, 1e-4), 1 - 1e-4) / (1 - min(max(vote, 1e-4), 1 - 1e-4)))
        assert r.score == pytest.approx(1 / (1 + np.exp(-(index.slope * odds + index.shift))), abs=1e-6)


def test_block_max_neighbours_are_exact():
    rng = np.random.default_rng(2)
    rows = []
    for k in range(700):
        at = np.unique(rng.integers(0, 30 if k % 2 else 1500, rng.integers(1, 160)))
        rows.append(toxicity.Example(k, int(rng.integers(0, 2)), at, rng.integers(1, 4, len(at))))
    index = toxicity.Index(rng.random(toxicity.DIMENSIONS) + 0.5, rows)
    place = {d: k for k, d in enumerate(index.ids.tolist())}
    dense = np.zeros((700, 1500))
    for e in rows:
        dense[place[e.doc_id], e.terms] = index.weigh(e.terms, e.counts).astype(np.float32)
    for e in rows:
        cos = dense @ dense[place[e.doc_id]]
        want = np.sort(cos[cos > 1e-9])[::-1][:15]
        got, c = next(index.neighbours([(e.terms, e.counts)]))
        assert c == pytest.approx(want, abs=1e-6) and c == pytest.approx(cos[got], abs=1e-6)
    assert (index.length > toxicity.SHORT).sum() > 300  # lists of all three kinds
    alone = list(index.neighbours([(rows[d].terms, rows[d].counts) for d in index.ids.tolist()], own=True))
    assert all(k not in found for k, (found, _) in enumerate(alone))


def test_contradicting_and_null_labels(spark, docs):
    odd = spark.createDataFrame([(0, 0, 1), (0, 1, 0), (2, None, None), (None, 1, 1), (3, 7, 7)], "doc_id long, quality int, toxic int")
    assert quality_model.classify(docs.limit(20), odd).select(F.max("score"), F.min("score")).first() == (0.5, 0.5)
    assert toxicity.classify(docs.limit(20), odd).count() == 20


def test_language_query_against_brute_force(docs, odd_docs):
    """Each n-gram, weight and probability anew; only the learned numbers are shared."""
    model = language_id.train(docs.limit(300))
    size, mask = language_id.DIMENSIONS, (1 << 64) - 1

    def brute(text):
        kept = "".join(c if c.isalpha() else " " for c in (text or "").lower())
        kept = " " + " ".join(kept.split()) + " "
        counts = {}
        for n in (1, 2, 3):
            for k in range(len(kept) - n + 1):
                code = 0
                for c in kept[k : k + n]:
                    code = (code * 0x100000001B3 + ord(c)) & mask
                h = ((code + n) * int(language_id.SALTS[n - 1]) & mask) >> (64 - language_id.DIMENSION_BITS)
                counts[h] = counts.get(h, 0) + 1
        if not kept.strip():
            return "und", 0.0
        x = {h: (1 + np.log(c)) * model.idf[h] for h, c in counts.items()}
        norm = sum(v * v for v in x.values()) ** 0.5
        s = np.array([sum(v / norm * model.weights[h, k] for h, v in x.items()) + model.weights[size, k] for k in range(len(model.languages))])
        p = np.exp((s - s.max()) / model.temperature)
        return model.languages[int(p.argmax())], float((p / p.sum()).max())

    rows = odd_docs.union(odd_docs).select("doc_id", "text").union(docs.limit(40).select("doc_id", "text"))
    texts = {(r.doc_id, i): r.text for i, r in enumerate(rows.collect())}
    got = [(r.doc_id, r.lang_pred, r.score) for r in language_id.predict(rows, model).collect()]
    for ((d, _), text), (doc_id, lang, score) in zip(texts.items(), got, strict=True):
        assert d == doc_id and (lang, score) == (brute(text)[0], pytest.approx(brute(text)[1], abs=1e-4))


def test_shares_of_words_and_trigrams():
    """Each word and each byte trigram falls into one bucket; texts of any length have less than unit length, short ones little."""
    at, value = quality_model.shares("Abc, abc. é")
    words = {zlib.crc32(w) & (quality_model.BUCKETS - 1) for w in (b"abc", "é".encode())}
    assert {k for k in at.tolist() if k < quality_model.BUCKETS} == words
    n = {int(k): round(float(v) ** 2 * (3 + 10 + quality_model.FEW)) for k, v in zip(at, value, strict=True)}
    assert n[zlib.crc32(b"abc") & (quality_model.BUCKETS - 1)] == 2 and sum(n.values()) == 3 + 10
    for text in (None, "", " ", "a", "ab", "x" * 1_000_000):
        at, value = quality_model.shares(text)
        assert len(at) == len(value) and float((value**2).sum()) < 1


def test_shares_rank_pairs_without_counts():
    rng = np.random.default_rng(6)
    word = lambda few: " ".join(rng.choice(few, 120))
    texts = [word(["pump", "seal", "valve", "flow"]) for _ in range(60)] + [word(["spam", "buy", "now", "flow"]) for _ in range(60)]
    y = np.array([1] * 60 + [0] * 60)
    order = rng.permutation(120)
    rows = [quality_model.shares(texts[k]) for k in order]
    weights, given = quality_model.two_halves([(a.astype(np.int64), v) for a, v in rows], y[order])
    assert given[y[order] == 1].min() > given[y[order] == 0].max()
    assert weights.any() and not quality_model.two_halves([(a.astype(np.int64), v) for a, v in rows], np.ones(120, int))[0].any()


def test_quality_query_against_brute_force(docs, labels, odd_docs):
    """Scores from each text's features, by the plain formula; repeated rows score alike."""
    model = quality_model.train(docs, labels)
    rows = odd_docs.union(odd_docs).select("doc_id", "text").union(docs.limit(60).select("doc_id", "text"))
    for r, want in zip(quality_model.score(rows, model).collect(), rows.collect(), strict=True):
        at, value = quality_model.shares(want.text)
        own = (*quality_model.features(want.text), sum(float(model.grams[k]) * float(v) for k, v in zip(at, value, strict=True)))
        s = sum((x - m) / d * w for x, m, d, w in zip(own, model.mean, model.scale, model.weights, strict=True))
        z = min(max((s - model.threshold) / model.temperature, -40), 40)
        assert r.doc_id == want.doc_id and r.score == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-6) and r.predicted == int(r.score >= 0.5)
