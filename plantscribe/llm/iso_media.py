"""Media columns: ISO base media containers, written and walked box by box.

``mux`` wraps payloads into a container whose track stores fixed-size 8-bit samples. ``probe_tracks`` walks the nested boxes,
decodes the sample tables (stsc, stsz or stz2, stco or co64, stss), edit lists and movie fragments (moof, traf, trun) and reports codec,
duration and the byte ranges of the sync samples of every track without touching the payload; ``read_samples`` follows the same tables to
the stored bytes. An edit list shortens or delays what is presented, not what is stored: its total is the duration told.

Null payloads count as empty. Equal payloads give equal containers: nothing else enters them. A container that can't be
walked gives a null codec and an ``error`` text instead of failing the job; of a file with several tracks the first in the file is told by itself,
and all of them in ``tracks``. Repeated rows are stored each. Rows are handled in stretches of some megabytes, a longer one alone (a container of 2 GB is the format's bound
here). An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, functions as F

SAMPLE_BYTES, SAMPLES_PER_CHUNK, SYNC_EVERY, TIMESCALE = 192, 64, 16, 8000
CODEC = b"raw "
LARGE = 0xFFFFFFFF


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    if len(body) + 8 > LARGE:
        return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body
    return struct.pack(">I4s", len(body) + 8, kind) + body


def _full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", version << 24 | flags), *parts)


def pad(payload: bytes, unit: int = SAMPLE_BYTES) -> bytes:
    """Blanks up to a positive multiple of ``unit``."""
    return payload + b" " * ((-len(payload)) % unit if payload else unit)


def mux(payload: bytes) -> bytes:
    """A container with one sound track of 8-bit samples; ``payload`` is a positive multiple of SAMPLE_BYTES."""
    n = len(payload) // SAMPLE_BYTES
    chunks = -(-n // SAMPLES_PER_CHUNK)
    last = n - (chunks - 1) * SAMPLES_PER_CHUNK
    ftyp = _box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2")
    wide = len(payload) + 4096 + chunks * 8 > LARGE
    duration = n * SAMPLE_BYTES
    matrix = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)

    def moov(base: int) -> bytes:
        at = [base + k * SAMPLES_PER_CHUNK * SAMPLE_BYTES for k in range(chunks)]
        runs = [(1, SAMPLES_PER_CHUNK)] * (chunks > 1) + [(chunks, last)] * (chunks == 1 or last != SAMPLES_PER_CHUNK)
        sync = range(1, n + 1, SYNC_EVERY)
        entry = _box(CODEC, bytes(6), struct.pack(">H", 1), struct.pack(">HHIHHHHI", 0, 0, 0, 1, 8, 0, 0, TIMESCALE << 16))
        stbl = _box(
            b"stbl",
            _full(b"stsd", struct.pack(">I", 1), entry),
            _full(b"stts", struct.pack(">III", 1, n, SAMPLE_BYTES)),
            _full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", first, per, 1) for first, per in runs)),
            _full(b"stsz", struct.pack(">II", SAMPLE_BYTES, n)),
            _full(b"co64" if wide else b"stco", struct.pack(">I", chunks), struct.pack(f">{chunks}{'Q' if wide else 'I'}", *at)),
            _full(b"stss", struct.pack(">I", len(sync)), struct.pack(f">{len(sync)}I", *sync)),
        )
        v, t = (1, "Q") if duration > LARGE else (0, "I")
        dinf = _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _full(b"url ", flags=1)))
        mdia = _box(b"mdia", _full(b"mdhd", struct.pack(f">{t}{t}I{t}HH", 0, 0, TIMESCALE, duration, 0x55C4, 0), version=v), _full(b"hdlr", bytes(4), b"soun", bytes(12), b"\0"), _box(b"minf", _full(b"smhd", bytes(4)), dinf, stbl))
        tkhd = _full(b"tkhd", struct.pack(f">{t}{t}II{t}", 0, 0, 1, 0, duration), bytes(8), struct.pack(">hhHH", 0, 0, 0x100, 0), matrix, bytes(8), version=v, flags=7)
        mvhd = _full(b"mvhd", struct.pack(f">{t}{t}I{t}", 0, 0, TIMESCALE, duration), struct.pack(">IH", 0x10000, 0x100), bytes(10), matrix, bytes(24), struct.pack(">I", 2), version=v)
        return _box(b"moov", mvhd, _box(b"trak", tkhd, mdia))

    head = 16 if len(payload) + 8 > LARGE else 8
    return ftyp + moov(len(ftyp) + len(moov(0)) + head) + _box(b"mdat", payload)


@dataclass
class Track:
    codec: str
    timescale: int
    duration: int  # in units of the timescale, as the edit list presents it
    offsets: np.ndarray  # of each sample in the file
    sizes: np.ndarray
    sync: np.ndarray  # from 0


def boxes(data: memoryview, start: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """``(kind, body start, body end)`` of the boxes from ``start``; refuses sizes that leave their parent."""
    while start < end:
        if end - start < 8:
            raise ValueError("box header cut short")
        size, kind = struct.unpack_from(">I4s", data, start)
        body = start + 8
        if size == 1:
            (size,), body = struct.unpack_from(">Q", data, body), start + 16
        elif size == 0:
            size = end - start
        if size < body - start or start + size > end:
            raise ValueError(f"box {kind!r} doesn't fit its parent")
        yield bytes(kind), body, start + size
        start += size


Span = tuple[int, int]


def inside(data: memoryview, span: Span, *path: bytes) -> list[Span]:
    """Bodies of all boxes at a path below a body, in the file's order."""
    spans = [span]
    for name in path:
        spans = [(a, b) for own in spans for kind, a, b in boxes(data, *own) if kind == name]
    return spans


def one(data: memoryview, span: Span, *path: bytes) -> Span:
    found = inside(data, span, *path)
    if not found:
        raise ValueError(f"no box {b'/'.join(path)!r}")
    return found[0]


def _numbers(data: memoryview, span: Span, skip: int, kind: str = ">u4", count: int | None = None) -> np.ndarray:
    a, b = span[0] + skip, span[1]
    width = np.dtype(kind).itemsize
    n = (b - a) // width if count is None else count
    if n < 0 or a + n * width > b:
        raise ValueError("table cut short")
    return np.frombuffer(data[a : a + n * width], kind).astype(np.int64)


def _sizes(data: memoryview, stbl: Span) -> np.ndarray:
    """Of stsz, or of stz2 with fields of 4, 8 or 16 bits."""
    if inside(data, stbl, b"stsz"):
        span = one(data, stbl, b"stsz")
        fixed, n = _numbers(data, span, 4, count=2).tolist()
        return np.full(n, fixed) if fixed else _numbers(data, span, 12, count=n)
    span = one(data, stbl, b"stz2")
    bits, n = int(_numbers(data, span, 4, count=1)[0]) & 0xFF, int(_numbers(data, span, 8, count=1)[0])
    if bits == 4:
        pairs = _numbers(data, span, 12, ">u1", (n + 1) // 2)
        return np.stack((pairs >> 4, pairs & 15), 1).ravel()[:n]
    if bits not in (8, 16):
        raise ValueError(f"sample sizes of {bits} bits")
    return _numbers(data, span, 12, f">u{bits // 8}", n)


def _table(data: memoryview, stbl: Span) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Offsets, sizes and sync samples of a sample table."""
    sizes = _sizes(data, stbl)
    n, wide = len(sizes), inside(data, stbl, b"co64")
    at = _numbers(data, wide[0], 8, ">u8") if wide else _numbers(data, one(data, stbl, b"stco"), 8)
    runs = _numbers(data, one(data, stbl, b"stsc"), 8).reshape(-1, 3)
    per = np.repeat(runs[:, 1], np.diff(np.append(runs[:, 0], len(at) + 1)))
    if per.sum() != n or len(per) != len(at):
        raise ValueError("sample tables disagree")
    chunk = np.repeat(np.arange(len(at)), per)
    before = np.cumsum(sizes) - sizes
    first = np.cumsum(per) - per
    offsets = at[chunk] + before - before[np.minimum(first, max(n - 1, 0))][chunk] if n else np.zeros(0, np.int64)
    listed = inside(data, stbl, b"stss")
    return offsets, sizes, _numbers(data, listed[0], 8) - 1 if listed else np.arange(n)


def _fragments(data: memoryview, whole: Span, track: int, preset: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Offsets, sizes, sync samples and total duration of a track's runs in movie fragments; ``preset`` are its duration, size and flags."""
    offsets, sizes, sync, total = [], [], [], 0
    for start, end in inside(data, whole, b"moof"):
        ran = start - 8  # the moof box; where nothing else is said, data follows from there
        for traf in inside(data, (start, end), b"traf"):
            head = one(data, traf, b"tfhd")
            flags, own = _numbers(data, head, 0, count=2).tolist()
            at, told, base = head[0] + 8, list(preset), start - 8
            for bit, width in ((1, 8), (2, 4), (8, 4), (16, 4), (32, 4)):
                if flags & bit:
                    value = int.from_bytes(data[at : at + width], "big")
                    at += width
                    base = value if bit == 1 else base
                    if bit > 2:
                        told[{8: 0, 16: 1, 32: 2}[bit]] = value
            if not flags & 1 and not flags & 0x20000:
                base = ran
            following = base
            for run in inside(data, traf, b"trun"):
                flags, n = _numbers(data, run, 0, count=2).tolist()
                flags, at = flags & 0xFFFFFF, run[0] + 8
                place, first_flags = following, None
                if flags & 1:
                    place = base + int.from_bytes(data[at : at + 4], "big", signed=True)
                    at += 4
                if flags & 4:
                    first_flags = int.from_bytes(data[at : at + 4], "big")
                    at += 4
                fields = [f for f in (0x100, 0x200, 0x400, 0x800) if flags & f]
                rows = _numbers(data, (at, run[1]), 0, count=n * len(fields)).reshape(n, len(fields))
                column = {f: rows[:, k] for k, f in enumerate(fields)}
                size = column.get(0x200, np.full(n, told[1]))
                marks = np.array(column.get(0x400, np.full(n, told[2])))
                if first_flags is not None and n:
                    marks[0] = first_flags
                following = place + int(size.sum())
                if own == track:
                    total += int(column.get(0x100, np.full(n, told[0])).sum())
                    sync.append(len(np.concatenate(sizes)) + np.flatnonzero(marks & 0x10000 == 0) if sizes else np.flatnonzero(marks & 0x10000 == 0))
                    offsets.append(place + np.cumsum(size) - size)
                    sizes.append(size)
            ran = following
    joined = lambda parts: np.concatenate([np.zeros(0, np.int64), *parts]).astype(np.int64)
    return joined(offsets), joined(sizes), joined(sync), total


def probe_tracks(data: bytes) -> list[Track]:
    """Every track's codec, duration and samples, in the file's order."""
    view = memoryview(data)
    whole = (0, len(view))
    moov = one(view, whole, b"moov")
    head = one(view, moov, b"mvhd")
    movie_scale = int(_numbers(view, head, 20 if view[head[0]] == 1 else 12, count=1)[0])
    presets = {int(x[0]): [int(x[2]), int(x[3]), int(x[4])] for x in (_numbers(view, t, 4, count=5) for t in inside(view, moov, b"mvex", b"trex"))}
    found = []
    for trak in inside(view, moov, b"trak"):
        tkhd = one(view, trak, b"tkhd")
        number = int(_numbers(view, tkhd, 20 if view[tkhd[0]] == 1 else 12, count=1)[0])
        a, _ = one(view, trak, b"mdia", b"mdhd")
        timescale, duration = struct.unpack_from(">IQ" if view[a] == 1 else ">II", view, a + (20 if view[a] == 1 else 12))
        stbl = one(view, trak, b"mdia", b"minf", b"stbl")
        entry = one(view, stbl, b"stsd")[0] + 12
        codec = bytes(view[entry : entry + 4]).decode("latin-1")
        parts, more = _table(view, stbl), _fragments(view, whole, number, presets.get(number, [0, 0, 0]))
        offsets, sizes = np.concatenate((parts[0], more[0])), np.concatenate((parts[1], more[1]))
        sync = np.concatenate((parts[2], more[2] + len(parts[1]))).astype(np.int64)
        if len(sizes) and ((offsets + sizes).max() > len(data) or offsets.min() < 0):
            raise ValueError("samples lie beyond the file")
        if len(sync) and (sync.min() < 0 or sync.max() >= len(sizes)):
            raise ValueError("sync samples that don't exist")
        duration += more[3]
        for a, _ in inside(view, trak, b"edts", b"elst")[:1]:
            long, (n,) = view[a] == 1, struct.unpack_from(">I", view, a + 4)
            entries = [struct.unpack_from(">QqI" if long else ">IiI", view, a + 8 + k * (20 if long else 12)) for k in range(n)]
            if total := sum(e[0] for e in entries):  # in the movie's time; empty edits count, they delay
                duration = total * timescale // max(movie_scale, 1)
        found.append(Track(codec, timescale, duration, offsets, sizes, sync))
    if not found:
        raise ValueError("no track")
    return found


def probe(data: bytes) -> Track:
    """The first track."""
    return probe_tracks(data)[0]


def read_samples(data: bytes, track: Track) -> bytes:
    """The stored payload; neighbouring samples are read as one range."""
    if not len(track.offsets):
        return b""
    ends = track.offsets + track.sizes
    breaks = np.flatnonzero(track.offsets[1:] != ends[:-1]) + 1
    return b"".join(data[int(track.offsets[a]) : int(ends[b - 1])] for a, b in zip([0, *breaks], [*breaks, len(ends)], strict=True))


def bounded(batch: pa.RecordBatch, column: int, most: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Stretches of a batch with about ``most`` bytes in that column; a longer value stands alone."""
    sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for k, n in enumerate(sizes.tolist()):
        if k > start and held + n > most:
            yield batch.slice(start, k - start)
            start, held = k, 0
        held += n
    if start < batch.num_rows:
        yield batch.slice(start)


def _mux_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in bounded(batch, 1):
            raw = [(x.as_py() or "").encode("utf-8", "replace") for x in part.column(1)]
            media = [mux(pad(x)) for x in raw]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(map(len, raw), pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])


def to_media(docs: DataFrame) -> DataFrame:
    """``(doc_id, text)`` -> ``(doc_id, n_bytes, media)``; no shuffle."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_mux_batches, "doc_id long, n_bytes long, media binary")


def store(media: DataFrame, path: str) -> str:
    """Write the media column as a table of its own, to a folder that driver and executors share."""
    media.write.option("compression", "zstd").parquet(path)
    return path


FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, codec string, duration_s double, n_samples long, keyframes array<struct<offset:long,length:long>>, tracks array<struct<codec:string,duration_s:double,n_samples:long,n_keyframes:long>>, error string"


def _features(doc_id: int, n_bytes: int, media: bytes) -> dict:
    row = {"doc_id": doc_id, "n_bytes": n_bytes, "media_bytes": len(media), "media_sha256": hashlib.sha256(media).hexdigest()}
    try:
        tracks = probe_tracks(media)
        track = tracks[0]
    except (ValueError, KeyError, struct.error, IndexError) as e:
        return row | {"error": f"{type(e).__name__}: {e}"}
    payload = read_samples(media, track)
    seconds = track.duration / max(track.timescale, 1)
    at, sizes = track.offsets[track.sync], track.sizes[track.sync]
    ranges = [{"offset": int(a), "length": int(b)} for a, b in zip(at, sizes, strict=True)]
    digest = zlib.crc32(np.stack([at, sizes], 1).astype("<i8").tobytes())
    return row | {
        "payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-16:]),
        "feature": f"codec={track.codec.strip()};duration={seconds:.3f};samples={len(track.sizes)};sync={len(ranges)};ranges={digest:08x}",
        "codec": track.codec.strip(), "duration_s": seconds, "n_samples": len(track.sizes), "keyframes": ranges, "error": None,
        "tracks": [{"codec": t.codec.strip(), "duration_s": t.duration / max(t.timescale, 1), "n_samples": len(t.sizes), "n_keyframes": len(t.sync)} for t in tracks],
    }


def _probe_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = {"doc_id": pa.int64(), "n_bytes": pa.int64(), "payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string(), "feature": pa.string(), "codec": pa.string(), "duration_s": pa.float64(), "n_samples": pa.int64(), "keyframes": pa.list_(pa.struct({"offset": pa.int64(), "length": pa.int64()})), "tracks": pa.list_(pa.struct({"codec": pa.string(), "duration_s": pa.float64(), "n_samples": pa.int64(), "n_keyframes": pa.int64()})), "error": pa.string()}
    for batch in (part for whole in batches for part in bounded(whole, 2)):
        rows = [_features(d.as_py(), n.as_py(), m.as_py() or b"") for d, n, m in zip(*batch.columns, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([r.get(k) for r in rows], t) for k, t in kinds.items()], list(kinds))


def probe_media(media: DataFrame) -> DataFrame:
    """``(doc_id, n_bytes, media)`` -> FEATURES, digests of what was read back included; no shuffle."""
    return media.select("doc_id", "n_bytes", "media").mapInArrow(_probe_batches, FEATURES)
