import random

import numpy as np
import pytest

import corpus_pipeline
from plantscribe.llm import shingle_dedup

from .conftest import TEXTS


def brute_set(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def brute_jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def changed_copies(seed):
    """Copies with single changed words; similarities to both sides of 0.8."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    docs = []
    for base in range(12):
        words = [word() for _ in range(rng.randint(60, 500))]
        for _ in range(10):
            w = list(words)
            for _ in range(int(len(w) * rng.choice([0, 0.005, 0.015, 0.02, 0.03, 0.06]))):
                w[rng.randrange(len(w))] = word()
            docs.append((len(docs) * 3 + 1, " ".join(w).upper() if base % 2 else "\n".join(w)))
    return docs


def brute_components(docs):
    sets = [(d, brute_set(t)) for d, t in docs]
    pairs = [(a, b) for k, (a, x) in enumerate(sets) for b, y in sets[k + 1 :] if brute_jaccard(x, y) >= 0.8]
    comp = {d: d for d, _ in docs}
    while any(comp[a] != comp[b] for a, b in pairs):
        for a, b in pairs:
            comp[a] = comp[b] = min(comp[a], comp[b])
    return comp, pairs


@pytest.mark.parametrize("chunk", [1024, 4])
def test_near_duplicates_against_brute_jaccard(spark, no_docs, chunk):
    docs = changed_copies(4) + list(enumerate(TEXTS, 1000))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    comp, pairs = brute_components(docs)
    assert len(pairs) > 100
    assert {r.doc_id: r.component_id for r in shingle_dedup.near_duplicates(df, chunk).collect()} == comp
    assert shingle_dedup.near_duplicates(no_docs).count() == 0


def test_stage_drops_copies_with_changed_words(spark):
    rows = [(d, t, "en", "s", len(t)) for d, t in changed_copies(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    comp, _ = brute_components([r[:2] for r in rows])
    kept = {r.doc_id for r in corpus_pipeline.simhash_near_dedup(spark, docs, "").collect()}
    assert kept == {d for d, c in comp.items() if d == c}


def test_large_group_travels_once(spark, monkeypatch):
    """Near copies of one text link to the leader: nothing is left to compare in pairs of chunks; an outlier in the group is compared with all."""
    from plantscribe.llm import shingle_dedup as S

    rng = np.random.default_rng(4)
    base = [f"w{x}" for x in rng.integers(0, 1 << 40, 120)]

    def copy(k, changed):
        own = list(base)
        for at in range(changed):
            own[119 - at] = f"x{k}-{at}"
        return " ".join(own)

    texts = [copy(k, 6) for k in range(300)] + [copy(1000, 18), copy(1000, 17) + " end", "quite another text of its own here"]
    docs = S.numbered(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3))
    sent = []
    monkeypatch.setattr(S, "_meet", lambda rows, dealt, meet=S._meet: (sent.append(dealt.selectExpr("sum(size(buckets))").first()[0] or 0), meet(rows, dealt))[1])
    got = {r.doc_id: r.component_id for r in S.near_duplicates(docs.select("doc_id", "text"), chunk=16).collect()}
    sets = [S.shingles(t) for t in texts]
    want = {k: k for k in range(len(texts))}
    for i in range(len(texts)):
        for j in range(i):
            if want[i] != want[j] and S.jaccard(sets[i], sets[j]) >= 0.8:
                low, high = sorted((want[i], want[j]))
                want = {k: low if v == high else v for k, v in want.items()}
    assert got == want
    assert sent[0] < 2 * len(texts) and sum(sent) < 5 * len(texts)
