import zlib

import numpy as np
from tokenizers import Tokenizer

from plantscribe.llm import packing, token_orc
from plantscribe.llm.common import scratch
from plantscribe.llm.tokens import default_vocabulary

from .conftest import TEXTS


def whole_text_ids():
    t = Tokenizer.from_file(default_vocabulary())
    return [np.array(t.encode(x or "", add_special_tokens=False).ids + [1], "<u4") for x in TEXTS]


def test_orc_files_hold_the_library_s_ids(spark, odd_docs):
    want, start, expect = whole_text_ids(), 0, []
    for k, ids in enumerate(want):
        expect.append((k, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    path = token_orc.write_tokens(odd_docs.repartition(5), scratch(spark, "t"))
    assert sorted(map(tuple, token_orc.token_index(spark, path).collect())) == expect
    one = token_orc.look_up(spark, path, [4]).collect()
    assert [r.ids for r in one] == [want[4].tolist()]
    plan = token_orc.look_up(spark, path, [4, 5])._jdf.queryExecution().toString()
    assert "PushedFilters: [In(doc_id" in plan


def test_orc_of_no_rows_and_of_repeated_ids(spark, odd_docs, no_docs):
    assert token_orc.token_index(spark, token_orc.write_tokens(no_docs, scratch(spark, "t"))).count() == 0
    twice = odd_docs.union(odd_docs)
    got = token_orc.token_index(spark, token_orc.write_tokens(twice, scratch(spark, "t"))).orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted([*range(len(TEXTS))] * 2)
    assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got)])[:-1].tolist()


def check_packing(rows, want):
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for k, ids in enumerate(want):
        pieces = sorted(by_doc[k], key=lambda r: r.piece)
        assert [p.start for p in pieces] == [*range(0, len(ids), 4096)]
        assert b"".join(ids[p.start : p.start + p.length].tobytes() for p in pieces) == ids.tobytes()
        assert all(zlib.crc32(ids[p.start : p.start + p.length].tobytes()) == p.ids_crc32 for p in pieces)
    for places in by_seq.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 4096


def test_packing_round_trip(spark, odd_docs, no_docs):
    check_packing(packing.pack(packing.token_pieces(odd_docs)).collect(), whole_text_ids())
    assert packing.pack(packing.token_pieces(no_docs)).count() == 0
    assert packing.pack(packing.token_pieces(odd_docs.union(odd_docs))).count() == 2 * packing.token_pieces(odd_docs).count()


def test_sum_of_squares_places_as_brute_force_and_wastes_little():
    lengths = np.sort(np.random.default_rng(1).integers(1, 21, 400))[::-1]
    sequence, offset = packing.sum_of_squares(lengths, 40)
    gaps, mine = [], []
    for size in lengths.tolist():  # brute force over every open sequence
        best = None
        for gap in sorted({g for g in gaps if g >= size} | {40}):
            after = [g for g in gaps]
            if gap != 40:
                after.remove(gap)
            after += [gap - size] * (gap > size)
            cost = sum(after.count(g) ** 2 for g in set(after))
            if best is None or cost < best[0] or (cost == best[0] and gap != 40 and best[1] == 40):
                best = (cost, gap, after)
        gaps = best[2]
        mine.append(best[1])
    assert len(set(sequence)) == mine.count(40)
    assert len(set(sequence)) <= 1.03 * -(-lengths.sum() // 40) + 1


def test_one_row_many_times_spreads(spark):
    rows = spark.range(0, 9000, 1, 6).selectExpr("cast(7 as long) doc_id", "'the same few words' text")
    got = packing.pack(packing.token_pieces(rows), group_pieces=1000).selectExpr("sequence_id div 4294967296 as g").groupBy("g").count().collect()
    assert len(got) == 9 and max(r["count"] for r in got) < 1300
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small ranges would be put together
    path = token_orc.write_tokens(rows, scratch(spark, "t"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    parts = token_orc.read_tokens(spark, path).groupBy("part").count().collect()
    assert len(parts) == 4 and max(r["count"] for r in parts) < 4500
    index = token_orc.token_index(spark, path).orderBy("start").collect()
    assert [r.start for r in index] == [*range(0, 9000 * index[0].n_tokens, index[0].n_tokens)]


def test_random_texts_have_the_library_s_ids():
    import random

    from plantscribe.llm.tokens import WordEncoder

    own, library, rng = WordEncoder(default_vocabulary()), Tokenizer.from_file(default_vocabulary()), random.Random(1)
    signs = [*"aAbéÉzZ09.,!?;:#$%&*|'\"()-_<>=/@ \n\t\r\x0b\x00\x7f́;İΣσß”“—日ñ", "'s", "<|startoftext|>", "<|ENDOFTEXT|>", " the ", "ing,"]
    for _ in range(5000):
        text = "".join(rng.choice(signs) for _ in range(rng.randint(1, 14)))
        assert np.frombuffer(next(own.packed([text])), "<u4").tolist() == [*library.encode(text, add_special_tokens=False).ids, 1], text
