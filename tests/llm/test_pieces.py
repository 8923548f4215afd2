import random
import zlib

import numpy as np
import pytest

from plantscribe.llm import nbest_pieces, queries
from plantscribe.llm.nbest_pieces import BLANK

from .conftest import TEXTS


@pytest.fixture(scope="module")
def own():
    return nbest_pieces.lattice(nbest_pieces.default_vocabulary())


def all_paths(own, text):
    ending = own.arcs(text)
    todo = [(len(text), 0.0, ())]
    while todo:
        node, score, ids = todo.pop()
        if node == 0:
            yield round(score, 9), ids
        todo += [(s, score + x, piece + ids) for s, x, piece in ending[node]] if node else []


@pytest.mark.parametrize("text", ["the cat", "naïve", "a b", "xyzzy,", "日本 ok", "  two", "x\ny", "f(x). g!"])
def test_whole_text_against_all_paths(own, text):
    want = sorted({s for s, _ in all_paths(own, BLANK + text.replace(" ", BLANK))}, reverse=True)
    ids, nbest, spelt = next(own.encode([text], 4))
    assert spelt
    scores = [round(s, 9) for s, _ in nbest]
    every = sorted((s for s, _ in all_paths(own, BLANK + text.replace(" ", BLANK))), reverse=True)
    assert scores == pytest.approx(every[: len(scores)]) and len(scores) == min(4, len(every)) and scores[0] == pytest.approx(want[0])
    assert nbest[0][1] == ids and len({x for _, x in nbest}) == len(nbest)
    for _, x in nbest:
        assert own.decode(x) == text


def test_vector_and_single_solutions_agree(own):
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdeoé▁t.日") for _ in range(rng.randint(1, 12))) for _ in range(300)]
    words = sorted(set(words))
    own._forget()
    own.learn(words)
    for w in words:
        k = own.number[w]
        two = own.n_best(w, 2)
        assert own.best[k] == pytest.approx(two[0][0])
        assert own.best[k] - own.loss[k] == pytest.approx(two[1][0]) if len(two) > 1 else own.loss[k] == np.inf
        assert own.spelt[k]
        assert b"".join(own.spelling[i] for i in np.frombuffer(own.packed[k], "<u4").tolist()) == w.replace(BLANK, " ").encode()
    own._forget()


def test_round_trip_on_tables(spark, odd_docs, no_docs):
    rows = {r.doc_id: r for r in nbest_pieces.encode(odd_docs, keep_ids=True).collect()}
    assert all(r.round_trip for r in rows.values()) and len(rows) == len(TEXTS)
    for r in rows.values():
        assert r.nbest_scores == sorted(r.nbest_scores, reverse=True) and r.nbest_scores[0] == pytest.approx(r.best_score)
    back = {r.doc_id: r.text for r in nbest_pieces.decode(nbest_pieces.encode(odd_docs, keep_ids=True)).collect()}
    assert back == {k: t or "" for k, t in enumerate(TEXTS)}
    assert nbest_pieces.encode(no_docs).count() == 0


def test_query_against_all_paths(spark, own, tmp_path):
    """The registered query on short texts of one to four words, several times each: its n best are the best of all segmentations."""
    rng = random.Random(11)
    texts = ["".join(rng.choice("ab the.é1日 ") for _ in range(rng.randint(1, 9))) for _ in range(60)] + ["a a a a", "the the", " ", "  a", "a\n\na"]
    rows = [(k, t, "en", "s", len(t)) for k, t in enumerate(texts + texts[:20])]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in queries.op8_nbest_pieces(spark, str(tmp_path)).collect()}
    assert set(got) == {k for k, *_ in rows}
    for k, text, *_ in rows:
        r, every = got[k], {}
        for score, ids in all_paths(own, BLANK + text.replace(" ", BLANK)):
            crc = zlib.crc32(np.array(ids, "<u4").tobytes())
            every[crc] = max(score, every.get(crc, -np.inf))
        best = sorted(every.values(), reverse=True)[: nbest_pieces.N_BEST]
        assert r.nbest_scores == pytest.approx(best), text
        assert len(set(r.nbest_crc32)) == len(r.nbest_crc32) and r.round_trip
        assert [every[c] for c in r.nbest_crc32] == pytest.approx(r.nbest_scores), text
        assert r.best_score == pytest.approx(best[0]) and every[r.ids_crc32] == pytest.approx(best[0])
