import hashlib
import struct
import zlib
from collections import Counter

import pytest

from plantscribe.llm import iso_media, quality_rules

from .conftest import TEXTS


def brute_repeats(words):
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    n = Counter(windows)
    return len({i + k for i, w in enumerate(windows) if n[w] > 1 for k in range(5)})


def test_ledger_against_brute_force(spark, odd_docs, no_docs):
    rows = {r.doc_id: r for r in quality_rules.apply_policy(quality_rules.ledger(odd_docs)).collect()}
    for k, t in enumerate(TEXTS):
        words = (t or "").encode().split()
        r = rows[k]
        assert (r.n_words, r.word_chars, r.n_repeat_words) == (len(words), sum(len(w.decode()) for w in words), brute_repeats(words))
        assert r.base_failed == (len(words) < 10 or 100 * r.n_repeat_words > 20 * len(words))
        assert not (r.kept and r.base_failed)
    assert quality_rules.apply_policy(quality_rules.ledger(no_docs)).count() == 0


@pytest.mark.parametrize("text", ["a b a b a b a b a b", "a a a a a a", "x y z " * 4 + "q " * 3, "p q r s t u p q r s t", "abcde"])
def test_repeated_windows(text):
    words = text.encode().split()
    assert quality_rules.repeated_window_words(words) == brute_repeats(words)


def test_ablation_counts(spark):
    only = quality_rules.BITS
    rows = spark.createDataFrame([(b,) for b in (0, only["symbols"], only["symbols"] | only["shouting"], only["few_words"])], "fail_bits long")
    got = {r.rule: (r.n_failed, r.n_only, r.n_rejected) for r in quality_rules.ablations(rows).collect()}
    assert got["symbols"] == (2, 1, 3) and got["shouting"] == (1, 0, 3) and got["few_words"] == (1, 1, 3)


def test_media_round_trip(spark, odd_docs, no_docs):
    rows = {r.doc_id: r for r in iso_media.probe_media(iso_media.to_media(odd_docs)).collect()}
    for k, t in enumerate(TEXTS):
        raw = (t or "").encode()
        want = raw.ljust(max(192, -(-len(raw) // 192) * 192))
        r = rows[k]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(want), hashlib.sha256(want).hexdigest(), zlib.crc32(want[-16:]))
        assert r.codec == "raw" and r.duration_s == len(want) / 8000 and r.error is None
        stored = iso_media.mux(iso_media.pad(raw))
        assert hashlib.sha256(stored).hexdigest() == r.media_sha256
        for j, span in enumerate(r.keyframes):
            assert stored[span.offset : span.offset + span.length] == want[j * 16 * 192 :][:192]
    assert iso_media.probe_media(iso_media.to_media(no_docs)).count() == 0


def test_broken_media_is_reported(spark):
    good = iso_media.mux(iso_media.pad(b"abc" * 100))
    bad = [b"", b"\0\0\0\1", good[:60], good[:-10], b"\xff" * 64]
    rows = spark.createDataFrame([(k, 0, x) for k, x in enumerate([*bad, None])], "doc_id long, n_bytes long, media binary")
    assert all(r.error and r.codec is None for r in iso_media.probe_media(rows).collect())


def test_large_chunks_and_many_runs():
    for n in (1, 63, 64, 65, 128, 1000):
        data = bytes(range(192)) * n
        stored = iso_media.mux(data)
        track = iso_media.probe(stored)
        assert len(track.sizes) == n and iso_media.read_samples(stored, track) == data


def box(kind, *parts):
    body = b"".join(parts)
    return struct.pack(">I4s", len(body) + 8, kind) + body


def u4(*numbers):
    return struct.pack(f">{len(numbers)}I", *numbers)


def trak(number, codec, scale, duration, *stbl, edits=b""):
    entry = box(codec, bytes(8))
    table = box(b"stbl", box(b"stsd", u4(0, 1), entry), *stbl)
    return box(b"trak", box(b"tkhd", u4(0, 0, 0, number, 0, duration)), edits, box(b"mdia", box(b"mdhd", u4(0, 0, 0, scale, duration)), box(b"minf", table)))


def film(fragments=b""):
    """Two tracks by hand: packed sizes of four bits with an edit list, and sizes of 16 bits; the samples lie behind one another in mdat."""
    samples = [b"abc", b"de", b"fghij", b"K" * 300, b"L" * 7]
    head = box(b"ftyp", b"isom")
    first = (box(b"stz2", u4(0, 4, 3), bytes([0x32, 0x50])), box(b"stsc", u4(0, 2, 1, 2, 1, 2, 1, 1)), box(b"stss", u4(0, 2, 1, 3)))
    second = (box(b"stz2", u4(0, 16, 2), struct.pack(">HH", 300, 7)), box(b"stsc", u4(0, 1, 1, 2, 1)))
    edits = box(b"edts", box(b"elst", u4(0, 2, 500, 0xFFFFFFFF, 0x10000, 1000, 0, 0x10000)))
    mvex = box(b"mvex", box(b"trex", u4(0, 2, 1, 40, 4, 0x10000)))

    def moov(at):
        return box(b"moov", box(b"mvhd", u4(0, 0, 0, 1000, 1500)), trak(1, b"raw ", 8000, 30, *first, box(b"stco", u4(0, 2, at, at + 5)), edits=edits), trak(2, b"mp4v", 90, 180, *second, box(b"co64", u4(0, 1, 0, at + 10))), mvex)

    at = len(head) + len(moov(0)) + 8
    return head + moov(at) + box(b"mdat", *samples) + fragments, at, samples


def test_all_tracks_by_hand():
    data, at, samples = film()
    first, second = iso_media.probe_tracks(data)
    assert (first.codec, first.timescale, first.duration) == ("raw ", 8000, 12000)  # 1.5 s as edited
    assert first.offsets.tolist() == [at, at + 3, at + 5] and first.sizes.tolist() == [3, 2, 5] and first.sync.tolist() == [0, 2]
    assert (second.codec, second.duration) == ("mp4v", 180) and second.offsets.tolist() == [at + 10, at + 310] and second.sync.tolist() == [0, 1]
    assert iso_media.read_samples(data, first) == b"".join(samples[:3]) and iso_media.read_samples(data, second) == b"".join(samples[3:])
    assert iso_media.probe(data).codec == "raw "


def test_fragments_by_hand():
    run = box(b"trun", u4(0x205, 3, 108, 0, 5, 6, 7))  # data offset, flags of the first sample, a size each
    other = box(b"trun", u4(0, 2))  # preset size and flags, right behind
    moof = box(b"moof", box(b"mfhd", u4(0, 1)), box(b"traf", box(b"tfhd", u4(0x20000, 2)), run, other))
    assert len(moof) == 100
    data, at, _ = film(moof + box(b"mdat", b"12345", b"678901", b"2345678", b"wxyz", b"WXYZ"))
    first, second = iso_media.probe_tracks(data)
    assert len(first.sizes) == 3
    assert second.sizes.tolist() == [300, 7, 5, 6, 7, 4, 4] and second.sync.tolist() == [0, 1, 2]
    assert second.duration == 180 + 5 * 40
    assert iso_media.read_samples(data, second)[307:] == b"123456789012345678wxyzWXYZ"


def test_stored_media_and_feature(spark, odd_docs, tmp_path):
    """The stored table, null and repeated doc_ids included, against boxes read by hand."""
    docs = odd_docs.unionByName(odd_docs).selectExpr("if(doc_id = 2, null, doc_id) AS doc_id", "text", "1 AS media", "2 AS codec")
    path = iso_media.store(iso_media.to_media(docs), str(tmp_path / "media"))
    stored = spark.read.parquet(path)
    media = {r.doc_id: bytes(r.media) for r in stored.collect()}
    rows = iso_media.probe_media(stored).collect()
    assert len(rows) == 2 * len(TEXTS)
    for r in rows:
        raw = (TEXTS[2 if r.doc_id is None else r.doc_id] or "").encode()
        n = max(1, -(-len(raw) // 192))
        data = media[r.doc_id]
        start = data.index(b"mdat") + 4
        keys = b"".join(struct.pack("<qq", start + 192 * k, 192) for k in range(0, n, 16))
        assert r.feature == f"codec=raw;duration={n * 192 / 8000:.3f};samples={n};sync={-(-n // 16)};ranges={zlib.crc32(keys):08x}"
        assert [tuple(t) for t in r.tracks] == [("raw", n * 192 / 8000, n, -(-n // 16))]


def test_megabyte_texts(spark):
    text = "é\n" + "word " * 300_000
    df = spark.createDataFrame([(1, text), (1, text), (None, text)], "doc_id long, text string")
    rows = iso_media.probe_media(iso_media.to_media(df)).collect()
    assert len({r.media_sha256 for r in rows}) == 1 and all(r.n_bytes == len(text.encode()) and r.error is None for r in rows)
    judged = quality_rules.apply_policy(quality_rules.ledger(df)).collect()
    assert [r.n_words for r in judged] == [300_001] * 3 and all(r.base_failed and r.n_repeat_words == 300_000 for r in judged)


def test_stored_ledger_and_versions(spark, odd_docs, no_docs, tmp_path):
    rows = quality_rules.stored_ledger(odd_docs.unionByName(odd_docs), str(tmp_path / "ledger"))
    base, v1 = ({(r.doc_id, r.fail_bits): r.kept for r in quality_rules.apply_policy(rows, v).collect()} for v in ("base", "v1"))
    assert rows.count() == 2 * len(TEXTS)
    assert all(k == (bits & 3 == 0) for (_, bits), k in base.items()) and all(k == (bits == 0) for (_, bits), k in v1.items())
    assert quality_rules.ablations(quality_rules.stored_ledger(no_docs, str(tmp_path / "none"))).count() == 0
