import hashlib
import random
import re

import numpy as np
import pytest

from plantscribe.llm import personal_data as P

from .conftest import TEXTS

PATTERNS = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))
CARDS = ["4539578763621486", "4716 9829 2715 0047", "4556-7375-8689-9855"]


def good(kind, own):
    digits = [int(c) for c in own if c in "0123456789"]
    if kind == "ip":
        return all(int(x) <= 255 for x in own.split("."))
    if kind == "card":
        total = sum(d if k % 2 == 0 else d * 2 - 9 * (d > 4) for k, d in enumerate(reversed(digits)))
        return 14 <= len(digits) <= 19 and total % 10 == 0
    return kind == "email" or 10 <= len(digits) <= 15


def brute(text):
    found = [(m.start(), k, m.end()) for k, (kind, p) in enumerate(PATTERNS) for m in re.finditer(p, text or "") if good(kind, m.group())]
    return sorted(found)


ODD = ["a@b.c@d.e f@g", "x..@-.-.- @a.b me@@a.b a@b.c.d@e.f", "999.1.2.3.4 1.2.3.4.5.6.7.8 0000255.1.1.1 1.2.3.256", "+1 (555) 010-4477, +12-345 +1((((((( +1234567890123456 ++49 30 1234567-", "ümlaut+tag@ex-ample.co.uk\n4539578763621486 4539578763621486", "5 5-5  5", "+1 4539578763621486", "a@" * 50]


def test_patterns_against_brute_force():
    rng = random.Random(3)
    texts = [*TEXTS, *ODD, *CARDS] + ["".join(rng.choice("a1.@+- (2)_%ü0") for _ in range(rng.randint(1, 60))) for _ in range(4000)]
    for text in texts:
        assert P.base_spans(text or "") == brute(text), text


@pytest.mark.parametrize("text", ["1" * 1_000_000, "a" * 1_000_000, "+1" + "(" * 1_000_000, "a@" * 300_000, "1." * 500_000, "a.b@c." * 100_000, "1 - " * 200_000], ids=range(7))
def test_long_texts_take_linear_time(text):
    P.base_spans(text)
    P.window_starts(text)


def test_gradients():
    rng = np.random.default_rng(1)
    model = {k: v.astype(float) for k, v in P.new_model(rng).items()}
    ids, tags = rng.integers(0, P.BEYOND + 1, (7, 3)), np.zeros((7, 3), int)
    tags[2], tags[3:5] = 3, 4
    _, grad = P.gradients(model, ids, tags)
    for k, g in grad.items():
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        near = [{**model, k: model[k].copy()} for _ in range(2)]
        near[0][k][at] += 1e-3
        near[1][k][at] -= 1e-3
        slope = (P.gradients(near[0], ids, tags)[0] - P.gradients(near[1], ids, tags)[0]) / 2e-3
        assert abs(slope - g[at]) < 1e-3 * max(1, abs(slope)), k


def test_decoding_and_posteriors_against_all_paths():
    rng = np.random.default_rng(2)
    model = P.new_model(rng)
    model["step"] = rng.normal(0, 1, model["step"].shape).astype(np.float32)
    scores = rng.normal(0, 2, (4, 1, P.TAGS)).astype(np.float32)
    steps = model["step"] + P.ALLOWED
    paths = {}
    for path in np.ndindex(*[P.TAGS] * 4):
        paths[path] = float(model["first"][path[0]] + sum(scores[t, 0, x] for t, x in enumerate(path)) + sum(steps[a, b] for a, b in zip(path, path[1:], strict=False)))
    assert tuple(P.decode(model, scores)[:, 0].tolist()) == max(paths, key=paths.get)
    ahead, behind, whole = P.posteriors(model, scores)
    weights = np.exp(np.array(list(paths.values())) - float(whole[0]))
    assert abs(weights.sum() - 1) < 1e-3
    share = sum(w for w, path in zip(weights, paths, strict=True) if path[1] == 5)
    assert abs(np.exp(ahead + behind - whole[:, None])[1, 0, 5] - share) < 1e-3


def test_reconciled_is_the_heaviest_set():
    rng = random.Random(5)
    for _ in range(200):
        found = {(a, rng.randrange(4), a + rng.randint(1, 6)): rng.random() for a in (rng.randrange(20) for _ in range(7))}
        best = max((sum(found[s] for s in own) for m in range(1 << len(found)) for own in [[s for k, s in enumerate(found) if m >> k & 1]] if all(x[2] <= y[0] for x, y in zip(sorted(own), sorted(own)[1:], strict=False))), default=0)
        got = P.reconciled(found)
        assert abs(sum(found[s] for s in got) - best) < 1e-9
        assert all(x[2] <= y[0] for x, y in zip(got, got[1:], strict=False))


def corpus(n, seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("aeiorstln") for _ in range(rng.randint(2, 8)))

    def card():
        d = [4, *(rng.randrange(10) for _ in range(14))]
        total = sum(x * 2 - 9 * (x > 4) if k % 2 == 0 else x for k, x in enumerate(reversed(d)))
        return "".join(map(str, d)) + str(-total % 10)

    kinds = (lambda: f"{word()}.{word()}@{word()}.com", lambda: ".".join(str(rng.randint(1, 255)) for _ in range(4)), card, lambda: f"+{rng.randint(1, 99)} ({rng.randint(100, 999)}) {rng.randint(100, 999)}-{rng.randint(1000, 9999)}")
    other = (lambda: f"version {rng.randint(1, 9)}.{rng.randint(0, 9)}", lambda: f"token {rng.randrange(16**20):x}", lambda: str(rng.randint(1900, 2100)))
    texts, planted = [], []
    for _ in range(n):
        planted.append([])
        parts = [word() for _ in range(rng.randint(5, 120))]
        for _ in range(rng.randint(0, 3)):
            make = rng.choice(kinds + other)
            parts.insert(rng.randrange(len(parts)), own := make())
            planted[-1] += [own] if make in kinds else []
        texts.append(" ".join(parts))
    return texts, card, planted


@pytest.fixture(scope="module")
def trained(spark):
    texts, card, _ = corpus(900, 11)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    return docs, texts, card, P.train(docs)


def test_query_rows_against_brute_force(spark, trained, odd_docs, no_docs):
    docs, texts, card, model = trained
    packed = [*TEXTS, *ODD, f"paid with {card()} {card()} yesterday", "zb " * 150_000 + f"paid with {card()} {card()} yesterday" + " z1" * 100_000]
    every = texts + packed
    rows = P.find(spark.createDataFrame(list(enumerate(every)), "doc_id long, text string").repartition(4), model).collect()
    assert len(rows) == len(every)
    for r in rows:
        text, base = every[r.doc_id], brute(every[r.doc_id])
        said = ",".join(f"{PATTERNS[k][0]}:{a}:{b}" for a, k, b in base)
        assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == n for _, k, _ in base) for n in range(4)]
        spans = [(int(a), [p[0] for p in PATTERNS].index(k), int(b)) for k, a, b in (s.split(":") for s in r.spans.split(",") if s)]
        assert spans == sorted(spans) and set(base) <= set(spans)
        for a, k, b in set(spans) - set(base):
            assert good(PATTERNS[k][0], text[a:b]) and all(b <= x or y <= a for x, _, y in base)
    twins = {r.doc_id: r.spans for r in rows}
    assert twins[len(every) - 2] == "card:10:26,card:27:43"  # the pattern takes both numbers for one and drops it
    assert twins[len(every) - 1] == "card:450010:450026,card:450027:450043"
    again = odd_docs.unionByName(odd_docs).selectExpr("if(doc_id = 3, null, doc_id) AS doc_id", "text", "1 AS spans", "2 AS n_ip")
    assert P.find(again, model).count() == 2 * len(TEXTS)
    assert P.find(no_docs, model).count() == 0


def test_held_out_finds(trained):
    """Of new texts, the model alone has nearly all that the patterns have, and what it adds was put there."""
    _, _, _, model = trained
    texts, _, planted = corpus(300, 12)
    want = [(k, s) for k, t in enumerate(texts) for s in P.base_spans(t)]
    found = P.decoded(model, texts)
    hit = sum(s in found[k] for k, s in want)
    assert hit >= 0.95 * len(want)
    for text, own, finds in zip(texts, planted, found, strict=True):
        base = P.base_spans(text)
        free = [s for s, p in finds.items() if sum(p) / len(p) >= P.SURE and P.plausible(text, s) and all(s[2] <= x[0] or x[2] <= s[0] for x in base)]
        assert [text[a:b] for a, _, b in free if text[a:b] not in own] == []


def test_without_labelled_spans(spark):
    docs = spark.createDataFrame([(1, "no numbers"), (2, "7 of 9"), (3, None)], "doc_id long, text string")
    assert P.train(docs) is None
    assert [r.spans for r in P.find(docs, None).collect()] == ["", "", ""]
    assert P.train(docs.limit(0)) is None
