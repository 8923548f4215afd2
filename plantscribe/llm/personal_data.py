"""Personal data: patterns and, beyond them, a character-level bidirectional LSTM with CRF transitions.

``base_spans`` are the patterns' finds, which stay whatever the model says. The model is trained in numpy on windows of texts whose
spans the patterns have labelled, with their digits drawn anew, without country codes and with numbers side by side; windows in which a
pattern's find failed its check teach nothing. It is meant for what the patterns drop: numbers that stand so close together that they
make one find, which fails, or phone numbers without a plus. A span of these kinds has a digit or an ``@``, so only the stretches
around these are read, in windows that overlap by half; others can't hold any. Each window is decoded (Viterbi), finds of several windows are
put together with the mean of their posterior probabilities, and of the finds of a whole text that pass their kind's check and leave
the patterns' spans alone, the set without overlaps that has the greatest sum is taken. A find longer than half a window may be missed.

Null and empty texts have no spans. Texts of any length are read whole, windows in blocks of bounded size. Rows are judged one by one,
also those that repeat a doc_id or have none. Ties between sets go to the one whose last find ends first. An empty table gives no rows, and tables
without any labelled span give the patterns' finds alone. Other columns are ignored. Offsets are code points, the end exclusive.
"""

from __future__ import annotations

import hashlib
import io
import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window as W, functions as F

KINDS = ("email", "ip", "card", "phone")
TAGS = 1 + 2 * len(KINDS)  # none, then first and later characters of each kind
WINDOW, HIDDEN, SEED = 96, 16, 7
#: Sample bounds: windows of each kind (and of none) that a model learns from. Passes, batch and step size of the training.
EXAMPLES, PASSES, BATCH, STEP = 250, 5, 64, 0.02
SURE = 0.9
Span = tuple[int, int, int]  # start, kind, end

# The patterns; possessive forms and look-behinds change no find and keep the search linear.
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def digits_of(text: str) -> str:
    return re.sub("[^0-9]", "", text)


def luhn(digits: str) -> bool:
    doubled = [int(d) * 2 for d in digits[-2::-2]]
    return (sum(map(int, digits[-1::-2])) + sum(d - 9 if d > 9 else d for d in doubled)) % 10 == 0


def is_ip(text: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in text.split("."))


def is_card(text: str) -> bool:
    return 14 <= len(d := digits_of(text)) <= 19 and luhn(d)


def is_phone(text: str) -> bool:
    return 10 <= len(digits_of(text)) <= 15


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost finds, by the @ signs: what precedes one back to the last find, then the longest domain."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
        last = found.end() if found else at + 1
        at = text.find("@", last)


def matched(text: str) -> list[tuple[Span, bool]]:
    """All finds of the patterns and whether they pass their check, by start and kind."""
    found = [((a, 0, b), True) for a, b in emails(text)]
    for kind, pattern, check in ((1, IP, is_ip), (2, CARD, is_card), (3, PHONE, is_phone)):
        found += [((m.start(), kind, m.end()), check(m.group())) for m in pattern.finditer(text)]
    return sorted(found)


def base_spans(text: str) -> list[Span]:
    return [span for span, good in matched(text) if good]


def told(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


# Characters: none, a digit, 26 letters whatever their case, white space, each ASCII mark, anything beyond ASCII.
NONE, DIGIT, SPACE = 0, 1, 28
MARKS = [c for c in range(32, 127) if not chr(c).isalnum()]
BEYOND = SPACE + 1 + len(MARKS)
CLASSES = np.full(129, SPACE, np.uint8)
for _c in range(128):
    CLASSES[_c] = DIGIT if chr(_c).isdigit() else 2 + _c % 32 - 1 if chr(_c).isalpha() else SPACE + 1 + MARKS.index(_c) if _c in MARKS else SPACE
CLASSES[128] = BEYOND
ANCHOR = re.compile("[0-9@]")


def classes(text: str) -> np.ndarray:
    return CLASSES[np.minimum(np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32), 128)]


def window_starts(text: str, window: int = WINDOW) -> list[int]:
    """Windows over all stretches within a third of a window of a digit or @, half overlapping, on a fixed raster."""
    half, reach = window // 2, window // 3
    found: list[int] = []
    for m in ANCHOR.finditer(text):
        first, last = max(0, m.start() - reach) // half, (m.start() + reach) // half
        for k in range(max(first - 1, 0 if not found else found[-1] + 1), last + 1):
            if k * half < len(text):
                found.append(k)
    return [k * half for k in found]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


Model = dict[str, np.ndarray]


def new_model(rng: np.random.Generator) -> Model:
    """``input`` has a row of gate inputs for each character (both directions), ``again`` the recurrent weights, ``out`` the emissions."""
    draw = lambda *shape: rng.normal(0, 0.2, shape).astype(np.float32)
    model = {"input": draw(2, BEYOND + 1, 4 * HIDDEN), "again": draw(2, HIDDEN, 4 * HIDDEN), "out": draw(2 * HIDDEN, TAGS), "bias": np.zeros(TAGS, np.float32), "step": np.zeros((TAGS, TAGS), np.float32), "first": np.zeros(TAGS, np.float32)}
    model["input"][:, :, HIDDEN : 2 * HIDDEN] += 1  # remember at first
    return model


ALLOWED = np.zeros((TAGS, TAGS), np.float32)  # a later character follows one of its kind only
for _k in range(len(KINDS)):
    ALLOWED[:, 2 + 2 * _k] = -1e4
    ALLOWED[1 + 2 * _k, 2 + 2 * _k] = ALLOWED[2 + 2 * _k, 2 + 2 * _k] = 0


def recur(model: Model, ids: np.ndarray, keep: list | None = None) -> np.ndarray:
    """States (time, both directions, batch, HIDDEN) of character classes (time, batch); the second direction runs backwards."""
    both = np.stack((ids, ids[::-1]), axis=1)
    n = ids.shape[1]
    h, c = (np.zeros((2, n, HIDDEN), np.float32) for _ in range(2))
    states = np.empty((len(ids), 2, n, HIDDEN), np.float32)
    for t in range(len(ids)):
        z = np.stack((model["input"][0][both[t, 0]], model["input"][1][both[t, 1]])) + h @ model["again"]
        gate, new = sigmoid(z[..., : 3 * HIDDEN]), np.tanh(z[..., 3 * HIDDEN :])
        into, stay, out = np.split(gate, 3, axis=-1)
        was, c = c, stay * c + into * new
        bent = np.tanh(c)
        if keep is not None:
            keep.append((h, was, into, stay, out, new, bent))
        h = out * bent
        states[t] = h
    return states


def joined(states: np.ndarray) -> np.ndarray:
    """(time, batch, 2 * HIDDEN), both directions at the same character."""
    return np.concatenate((states[:, 0], states[::-1, 1]), axis=-1)


def emissions(model: Model, ids: np.ndarray) -> np.ndarray:
    return joined(recur(model, ids)) @ model["out"] + model["bias"]


def decode(model: Model, scores: np.ndarray) -> np.ndarray:
    """The best tags (time, batch)."""
    steps, best = model["step"] + ALLOWED, scores[0] + model["first"]
    back = np.empty(scores.shape, np.int8)
    for t in range(1, len(scores)):
        ways = best[:, :, None] + steps
        back[t] = ways.argmax(axis=1)
        best = ways.max(axis=1) + scores[t]
    tags = np.empty(scores.shape[:2], np.int8)
    tags[-1] = best.argmax(axis=1)
    for t in range(len(scores) - 1, 0, -1):
        tags[t - 1] = np.take_along_axis(back[t], tags[t][:, None].astype(np.int64), axis=1)[:, 0]
    return tags


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def posteriors(model: Model, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log forward and backward sums (time, batch, TAGS) and the log of the whole (batch)."""
    steps = model["step"] + ALLOWED
    ahead, behind = np.empty_like(scores), np.zeros_like(scores)
    ahead[0] = scores[0] + model["first"]
    for t in range(1, len(scores)):
        ahead[t] = _log_sum(ahead[t - 1][:, :, None] + steps, 1) + scores[t]
    for t in range(len(scores) - 2, -1, -1):
        behind[t] = _log_sum(steps + (scores[t + 1] + behind[t + 1])[:, None, :], 2)
    return ahead, behind, _log_sum(ahead[-1], 1)


def gradients(model: Model, ids: np.ndarray, tags: np.ndarray) -> tuple[float, Model]:
    """Mean negative log likelihood of the tags (time, batch) and its gradient: CRF expectations, then back through time."""
    keep: list = []
    states = recur(model, ids, keep)
    wide = joined(states)
    scores = wide @ model["out"] + model["bias"]
    ahead, behind, whole = posteriors(model, scores)
    length, n = ids.shape
    steps = model["step"] + ALLOWED
    pairs = np.zeros((TAGS, TAGS), np.float32)
    for t in range(1, length):
        pairs += np.exp(ahead[t - 1][:, :, None] + steps + (scores[t] + behind[t])[:, None, :] - whole[:, None, None]).sum(axis=0)
    np.add.at(pairs, (tags[:-1].ravel(), tags[1:].ravel()), -1)
    off = np.exp(ahead + behind - whole[:, None])
    one = np.eye(TAGS, dtype=np.float32)[tags]
    likely = (scores * one).sum() + (model["first"] * one[0]).sum() + steps[tags[:-1], tags[1:]].sum()
    off = (off - one) / n
    grad = {"step": pairs / n, "first": off[0].sum(axis=0), "bias": off.sum(axis=(0, 1)), "out": np.tensordot(wide, off, ((0, 1), (0, 1)))}
    down = off @ model["out"].T
    down = np.stack((down[..., :HIDDEN], down[::-1, :, HIDDEN:]), axis=1)
    gates = np.empty((length, 2, n, 4 * HIDDEN), np.float32)
    dh, dc = (np.zeros((2, n, HIDDEN), np.float32) for _ in range(2))
    grad["again"] = np.zeros_like(model["again"])
    back = model["again"].transpose(0, 2, 1)
    for t in range(length - 1, -1, -1):
        h, was, into, stay, out, new, bent = keep[t]
        dh = dh + down[t]
        dc = dc + dh * out * (1 - bent * bent)
        z = np.concatenate((dc * new * into * (1 - into), dc * was * stay * (1 - stay), dh * bent * out * (1 - out), dc * into * (1 - new * new)), axis=-1)
        gates[t] = z
        grad["again"] += h.transpose(0, 2, 1) @ z
        dh, dc = z @ back, dc * stay
    chars = np.eye(BEYOND + 1, dtype=np.float32)
    grad["input"] = np.stack([chars[x].reshape(-1, BEYOND + 1).T @ gates[:, k].reshape(-1, 4 * HIDDEN) for k, x in enumerate((ids, ids[::-1]))])
    return float(whole.sum() - likely) / n, grad


def fit(ids: np.ndarray, tags: np.ndarray, passes: int = PASSES, seed: int = SEED) -> Model:
    """Adam on windows of classes and tags (rows, WINDOW)."""
    rng = np.random.default_rng(seed)
    model, n, done = new_model(rng), 0, -(-len(ids) // BATCH) * passes
    mean, square = ({k: np.zeros_like(v) for k, v in model.items()} for _ in range(2))
    for _ in range(passes):
        order = rng.permutation(len(ids))
        for at in range(0, len(order), BATCH):
            own = order[at : at + BATCH]
            _, grad = gradients(model, ids[own].T.astype(np.int64), tags[own].T.astype(np.int64))
            norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
            n += 1
            for k, g in grad.items():
                g = g * min(1.0, 5 / (norm + 1e-9))
                mean[k] = 0.9 * mean[k] + 0.1 * g
                square[k] = 0.99 * square[k] + 0.01 * g * g
                rate = STEP * (1 - 0.9 * n / done)
                model[k] = (model[k] - rate * (mean[k] / (1 - 0.9**n)) / (np.sqrt(square[k] / (1 - 0.99**n)) + 1e-6)).astype(np.float32)
    return model


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts -> labelled windows ``kind, h, part, spans``; of each kind the EXAMPLES distinct ones with the smallest hashes."""
    best: dict[str, dict[int, tuple[str, str]]] = {k: {} for k in (*KINDS, "none")}

    def trim(k: str, most: int) -> None:
        if len(best[k]) > most:
            best[k] = {h: best[k][h] for h in sorted(best[k])[:EXAMPLES]}

    for batch in batches:
        for value in batch.column(0):
            text = value.as_py()
            if not text or not ANCHOR.search(text):
                continue
            found = matched(text)
            good = [s for s, g in found if g]
            odd = [s for s, g in found if not g and s[2] - s[0] >= 10]
            for start in window_starts(text):
                end = min(start + WINDOW, len(text))
                inside = [s for s in good if start <= s[0] and s[2] <= end]
                touched = [s for s in (*good, *odd) if s[0] < end and s[2] > start and s not in inside]
                crossing = any(x[2] > y[0] for x, y in zip(inside, inside[1:], strict=False))
                if not touched and not crossing:
                    part = text[start:end]
                    k = KINDS[inside[0][1]] if inside else "none"
                    best[k][xxhash.xxh3_64_intdigest(part.encode("utf-8", "replace")) >> 1] = part, told([(a - start, k, b - start) for a, k, b in inside])
                    trim(k, 4 * EXAMPLES)
    rows = [(k, h, *v) for k in best for h, v in sorted(best[k].items())[:EXAMPLES]]
    yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate((pa.string(), pa.int64(), pa.string(), pa.string()))], ["kind", "h", "part", "spans"])


def examples(docs: DataFrame, most: int = EXAMPLES) -> DataFrame:
    """``kind, h, part, spans`` of at most ``most`` distinct windows of each kind and of none; a task sends no more either."""
    found = docs.select(F.col("text").cast("string")).mapInArrow(_examples, "kind string, h long, part string, spans string")
    place = F.row_number().over(W.partitionBy("kind").orderBy("h", "part"))
    return found.dropDuplicates(["kind", "h"]).withColumn("k", place).where(F.col("k") <= most).drop("k")


def varied(part: str, spans: list[Span], rng: np.random.Generator) -> tuple[str, list[Span]]:
    """The window with other digits; now and then a phone number without its country, or a number twice."""
    out, marks, at = [], [], 0
    length = 0

    def put(text: str) -> None:
        nonlocal length
        out.append(text)
        length += len(text)

    fresh = lambda t: re.sub("[0-9]", lambda _: str(rng.integers(10)), t)
    for a, k, b in spans:
        put(fresh(part[at:a]))
        own, again = fresh(part[a:b]), 1
        if KINDS[k] == "ip":
            own = ".".join(str(x) for x in rng.integers(1, 256, 4))
        if KINDS[k] == "phone" and rng.random() < 0.4 and (short := re.sub(r"^\+[0-9]{1,3}[ .-]", "", own)) and len(digits_of(short)) >= 10:
            own = short
        if KINDS[k] in ("card", "phone") and rng.random() < 0.3:
            again = int(rng.integers(2, 4))
        for n in range(again):
            put(" " if n else "")
            marks.append((length, k, length + len(own)))
            put(own)
            own = fresh(own)
        at = b
    put(fresh(part[at:]))
    return "".join(out), marks


def tagged(part: str, spans: list[Span]) -> tuple[np.ndarray, np.ndarray]:
    """Classes and tags of a window, cut or filled up to WINDOW characters; a span that the end cuts goes on to it."""
    ids, tags = np.zeros(WINDOW, np.uint8), np.zeros(WINDOW, np.uint8)
    ids[: len(part)] = classes(part)[:WINDOW]
    for a, k, b in spans:
        tags[a : a + 1], tags[a + 1 : b] = 1 + 2 * k, 2 + 2 * k
    return ids, tags


def _learn(versions: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng, own = np.random.default_rng(seed), []
        for row in sorted((r for batch in batches for r in batch.to_pylist()), key=lambda r: (r["kind"], r["h"])):
            marks = [(int(a), KINDS.index(k), int(b)) for k, a, b in (s.split(":") for s in row["spans"].split(",") if s)]
            own += [(row["part"], marks), *(varied(row["part"], marks, rng) for _ in range(versions))]
        if any(marks for _, marks in own):
            ids, tags = (np.stack(x) for x in zip(*(tagged(*x) for x in own), strict=True))
            np.savez(into := io.BytesIO(), **fit(ids, tags, seed=seed))
            yield pa.RecordBatch.from_arrays([pa.array([into.getvalue()], pa.binary())], ["model"])

    return run


def train(docs: DataFrame, versions: int = 1, seed: int = SEED) -> Model | None:
    """A model of at most EXAMPLES windows a kind and ``versions`` variants of each; None where no pattern finds anything.

    The sample is bounded, so one task learns from it; its weights, some 60 KB, come to the driver.
    """
    told_rows = examples(docs).repartition(1).mapInArrow(_learn(versions, seed), "model binary").collect()
    return dict(np.load(io.BytesIO(told_rows[0].model))) if told_rows else None


def runs_of(tags: np.ndarray) -> list[Span]:
    """Spans of one window's tags; a first character starts one, later ones of its kind carry it on."""
    found: list[Span] = []
    for a in np.flatnonzero(tags % 2 == 1).tolist():
        b = a + 1
        while b < len(tags) and tags[b] == tags[a] + 1:
            b += 1
        found.append((a, (int(tags[a]) - 1) // 2, b))
    return found


def plausible(text: str, span: Span) -> bool:
    """The check of a find that no pattern made; neither neighbour may be a digit."""
    a, kind, b = span
    own = text[a:b]
    if text[max(a - 1, 0) : a].isdigit() or text[b : b + 1].isdigit() or own != own.strip():
        return False
    if KINDS[kind] == "email":
        name, _, domain = own.replace(" ", "").partition("@")
        return bool(name) and DOMAIN.fullmatch(domain) is not None
    if KINDS[kind] == "ip":
        return IP.fullmatch(own) is not None and is_ip(own)
    if KINDS[kind] == "card":
        return CARD.fullmatch(own) is not None and is_card(own)
    parted = len(re.findall(r"[ ().-]+", own)) >= 2
    return re.fullmatch(r"[+(]?[0-9][ ().0-9-]+[0-9]", own) is not None and is_phone(own) and (parted or own[0] == "+")


def reconciled(found: dict[Span, float]) -> list[Span]:
    """Of finds and their weights, the set without overlaps that weighs most."""
    spans = sorted(found, key=lambda s: (s[2], s[0], s[1]))
    ends = [s[2] for s in spans]
    best: list[tuple[float, int, int]] = [(0.0, -1, 0)]  # weight, last find, what comes before it
    for k, span in enumerate(spans):
        before = bisect_right(ends, span[0], 0, k)
        best.append(max(best[k], (best[before][0] + found[span], k, before), key=lambda x: x[0]))
    out, at = [], len(spans)
    while best[at][1] >= 0:
        _, k, before = best[at]
        out.append(spans[k])
        at = before
    return out[::-1]


def decoded(model: Model, texts: list[str], block: int = 512) -> list[dict[Span, list[float]]]:
    """Finds of each text and their mean posterior in each window that has them whole."""
    places = [(k, start) for k, text in enumerate(texts) for start in window_starts(text)]
    found: list[dict[Span, list[float]]] = [{} for _ in texts]
    coded: tuple[int, np.ndarray] = (-1, np.empty(0, np.uint8))
    for at in range(0, len(places), block):
        own = places[at : at + block]
        ids = np.zeros((len(own), WINDOW), np.int64)
        for n, (k, start) in enumerate(own):
            if coded[0] != k:
                coded = k, classes(texts[k])
            part = coded[1][start : start + WINDOW]
            ids[n, : len(part)] = part
        scores = emissions(model, ids.T)
        tags = decode(model, scores)
        some = np.flatnonzero((tags > 0).any(axis=0))
        if not len(some):
            continue
        ahead, behind, whole = posteriors(model, scores[:, some])
        sure = np.exp(ahead + behind - whole[:, None])
        for n, w in enumerate(some.tolist()):
            k, start = own[w]
            for a, kind, b in runs_of(tags[:, w]):
                cut = (a == 0 and start > 0) or (b == WINDOW and start + WINDOW < len(texts[k]))
                if not cut:
                    p = float(sure[np.arange(a, b), n, tags[a:b, w].astype(np.int64)].mean())
                    found[k].setdefault((start + a, kind, start + b), []).append(p)
    return found


def _find(model: Model | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [x or "" for x in part.column(1).to_pylist()]
                base = [base_spans(t) if ANCHOR.search(t) else [] for t in texts]
                more = decoded(model, texts) if model else [{} for _ in texts]
                every, counts, digests = [], [[] for _ in KINDS], []
                for text, own, finds in zip(texts, base, more, strict=True):
                    taken, end = [], 0  # the patterns' spans, joined where they meet
                    for a, _, b in own:
                        if taken and a < end:
                            taken[-1][1] = end = max(end, b)
                        else:
                            taken.append([a, b])
                            end = b
                    ends = [b for _, b in taken]
                    free = lambda s: (k := bisect_right(ends, s[0])) == len(taken) or taken[k][0] >= s[2]  # noqa: B023, E731
                    good = {s: sum(p) for s, p in finds.items() if sum(p) / len(p) >= SURE and free(s) and plausible(text, s)}
                    every.append(told(own + reconciled(good)))
                    digests.append(hashlib.sha256(told(own).encode()).hexdigest())
                    for kind, n in enumerate(counts):
                        n.append(sum(s[1] == kind for s in own))
                arrays = [part.column(0), *(pa.array(n, pa.int64()) for n in counts), pa.array(digests, pa.string()), pa.array(every, pa.string())]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    return run


def find(docs: DataFrame, model: Model | None) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256`` of the patterns' finds and all ``spans``; no shuffle."""
    own = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return own.mapInArrow(_find(model), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
