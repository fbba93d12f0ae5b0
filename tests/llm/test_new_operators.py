"""Whitening, collocations and line de-duplication: brute force on small tables, and edge cases."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import pytest

from quarterlight.llm import collocations, lines, whitening

SCHEMA = "doc_id long, text string, lang string, n long, score double, block long, p int, a long, chunk long"
ROW = (7, 0.5, 3, 1, 2, 9)


# --- whitening ---


def brute_whitening(vectors, k):
    """n, deviations, components' values and shares from plain doubles."""
    dims = max(len(v) for v in vectors)
    c = np.array([list(v) + [0.0] * (dims - len(v)) for v in vectors])
    x = np.floor(64 * c) + 1_000_000
    n = len(x)
    d = x - x.mean(axis=0)
    cov = d.T @ d / n
    e, w = np.linalg.eigh(cov)
    e, w = e[::-1][:k], w[:, ::-1][:, :k]
    total = [int(v) for v in x.sum(axis=0)]
    dev = [sum((n * int(a) - s) ** 2 for a, s in zip(r, total)) for r in x]
    with np.errstate(divide="ignore", invalid="ignore"):
        return n, dev, d @ w / np.sqrt(e), e / np.trace(cov)


def test_products_of_bit_planes():
    rng = np.random.default_rng(1)
    for high in ([1, 7, 0, 300, 12], [2**40, 3, 1, 0, 2**30]):
        x = np.stack([rng.integers(0, h + 1, 777) for h in high], axis=1)
        x[0] = high
        got = whitening.products(x, [int(h).bit_length() for h in high])
        want = x.astype(object).T @ x.astype(object)
        assert (got == np.triu(want)).all()


def test_whitening_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    mix = rng.normal(size=(6, 6))
    vectors = (rng.normal(size=(400, 6)) @ mix).astype(np.float32)
    vectors[7] = vectors[8]
    rows = [(i, [float(x) for x in v], "x", 1) for i, v in enumerate(vectors)]
    rows += [(900, None, "x", 1), (901, [1.0, None, 0.0, 0.0, 0.0, 0.0], "x", 1), (902, [math.nan] * 6, "x", 1), (903, [math.inf] + [0.0] * 5, "x", 1)]
    rows += [(None, [0.5, 0.25], "short", 1), (904, [], "empty", 1), (905, [0.0] * 6, "x", 1), (905, [0.0] * 6, "x", 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, component string, n int").repartition(3)
    got = whitening.whiten(df, 4).collect()
    sound = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    n, dev, values, share = brute_whitening([r[1] for r in sound], 4)
    assert len(got) == 4 * n and {r["n"] for r in got} == {n}
    assert collections.Counter(r["vec_id"] for r in got) == {k: 4 * c for k, c in collections.Counter(r[0] for r in sound).items()}
    by = {(r["vec_id"], r["component"]): r for r in got}
    for i, (own, d) in enumerate(zip(sound, dev)):
        for c in range(4):
            assert by[own[0], c + 1]["deviation"] == d
            assert abs(by[own[0], c + 1]["explained"] - share[c]) < 1e-9
    for c in range(4):
        sign = np.sign(by[0, c + 1]["whitened"] * values[0, c])
        assert all(abs(sign * by[own[0], c + 1]["whitened"] - values[i, c]) < 1e-6 for i, own in enumerate(sound))
    assert {r["identity_error"] for r in got} == {got[0]["identity_error"]} and got[0]["identity_error"] < 1e-9


def test_whitening_edges(spark):
    schema = "vec_id long, embedding array<double>"
    assert whitening.whiten(spark.createDataFrame([], schema)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, None), (2, [None])], schema)).count() == 0
    one = whitening.whiten(spark.createDataFrame([(1, [0.5, 1.0])] * 3, schema)).collect()  # no variance
    assert len(one) == 6 and all(r["whitened"] is None and r["identity_error"] is None and r["deviation"] == 0 and r["explained"] == 0 for r in one)
    wide = whitening.whiten(spark.createDataFrame([(1, [2.0**30, 0.0]), (2, [-(2.0**30), 1.0])], schema)).collect()
    assert {r["deviation"] for r in wide} == {None}  # 2^76: past 64 bits
    first = [r for r in wide if r["component"] == 1]
    assert sorted(abs(r["whitened"]) for r in first) == pytest.approx([1.0, 1.0])
    with pytest.raises(Exception, match="too large"):
        whitening.whiten(spark.createDataFrame([(1, [1e30]), (2, [0.0])], schema)).collect()


# --- collocations ---


def brute_collocations(rows, threshold=10, longest=3, cover=50, top=2000):
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    f, n = collections.Counter(), collections.Counter()
    for text, lang in rows:
        lang = lang if lang is not None else "und"
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(lower)):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    out = collections.defaultdict(list)
    cands = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= threshold}
    for (lang, w), a in cands.items():
        inside = any(lg == lang and len(v) > len(w) and 100 * b >= cover * a and any(v[i : i + len(w)] == w for i in range(len(v))) for (lg, v), b in cands.items())
        if not inside:
            s, _, l, r = min((1000000 * a * a // (f[lang, w[:k]] * f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
            out[lang].append((-s, -a, " ".join(w).encode(), l, r))
    return sorted((lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for lang, own in out.items() for i, (s, a, p, l, r) in enumerate(sorted(own)[:top]))


@pytest.fixture(scope="module")
def talk():
    rng = random.Random(11)
    vocabulary = "stone river light tower garden winter paper cloud Été été naïve ß x1 ÀB \U0001f600 a".split()
    own = []
    for i in range(160):
        text = "".join(rng.choice(vocabulary) + rng.choice([" "] * 12 + [", ", ".\n", "\t", "\x0b", "!", "  "]) for _ in range(rng.randint(0, 90)))
        own.append((text, ["en", "fr", None, "und"][i % 4]))
    own += [(None, "en"), ("", None), ("...,,!!", "fr"), (" \t ", "en"), ("New York City " * 30, "en"), ("new york city, new york " * 12, "en"), ("one", "zz"), ("deep blue sea. " * 10, "zz"), ("same row " * 6, "fr"), ("same row " * 6, "fr")]
    return own


def talk_frame(spark, talk):
    return spark.createDataFrame([(i, t, lang, *ROW) for i, (t, lang) in enumerate(talk)], SCHEMA).repartition(5)


def test_collocations_equal_brute_force(spark, talk, monkeypatch):
    for options in ({}, {"threshold": 4, "longest": 4, "cover": 60, "top": 25}):
        got = sorted(tuple(r) for r in collocations.collocations(talk_frame(spark, talk), **options).collect())
        assert got == brute_collocations(talk, **options) and got
    monkeypatch.setattr(collocations, "BLOCK", 300)  # many blocks, texts cut into parts
    monkeypatch.setattr(collocations, "SPAN", 40)
    got = sorted(tuple(r) for r in collocations.collocations(talk_frame(spark, talk)).collect())
    assert got == brute_collocations(talk)


def test_collocations_of_nothing(spark):
    assert collocations.collocations(spark.createDataFrame([], SCHEMA)).count() == 0
    assert collocations.collocations(spark.createDataFrame([(1, None, None, *ROW), (2, "a b", "en", *ROW)], SCHEMA)).count() == 0


def test_summary_keeps_every_frequent_key():
    rng = np.random.default_rng(3)
    for _ in range(20):
        parts = [np.unique(np.minimum(rng.zipf(1.3, 3000), 1 << 20).astype(np.uint32), return_counts=True) for _ in range(12)]
        total = collections.Counter()
        for k, c in parts:
            total.update(dict(zip(k.tolist(), c.tolist())))
        s = collocations.Summary(sum(total.values()) // 10 + 1)
        for k, c in parts:
            s.add(k, c)
            s.settle()
        alive = set(s.frequent(10).tolist())
        assert len(s.keys) <= s.capacity and s.lost < 10
        assert {k for k, c in total.items() if c >= 10} <= alive


# --- lines ---


def brute_lines(rows):
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(lower)
    docs, top = collections.Counter(), {}
    for i, text in rows:
        for k in {key(line) for line in (text or "").split("\n")}:
            docs[k] += 1
            top[k] = max(top.get(k, -math.inf), -math.inf if i is None else i)
    out = []
    for i, text in rows:
        all_lines = (text or "").split("\n")
        kept = [x for x in all_lines if not (len(k := key(x)) >= 20 and docs[k] >= 3 and top[k] > -math.inf and top[k] != i)]
        out.append((i, len(all_lines), len(all_lines) - len(kept), "\n".join(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def pages():
    rng = random.Random(2)
    pool = [" ".join(rng.choice("stone river light tower Été garden".split()) for _ in range(rng.randint(1, 6))) for _ in range(60)]
    rows = []
    for i in range(120):
        own = [rng.choice(["", " ", "\t", "\r"]) + rng.choice([str, str.upper, str])(rng.choice(pool)) + rng.choice(["", " ", "\x0c", "\r"]) for _ in range(rng.randint(0, 12))]
        rows.append((i, "\n".join(own)))
    rows += [(200, None), (201, ""), (202, "\n\n"), (203, "é" * 19), (204, "é" * 19), (205, "é" * 19), (206, "é" * 20), (207, "é" * 20), (208, "É" * 20), (209, "é" * 20 + "\nlast")]
    rows += [(None, "a line that only rows without an id hold"), (None, "a line that only rows without an id hold"), (None, "a line that only rows without an id hold\nx")]
    rows += [(None, "a line with and without an id here"), (None, "a line with and without an id here"), (-5, "a line with and without an id here")]
    rows += [(300, "row that stands three times, whole\n  row that stands three times, whole")] * 3 + [(301, "\n".join(["long " * 30] * 500))] * 2 + [(302, "long " * 30)]
    return rows


def test_lines_equal_brute_force(spark, pages, monkeypatch):
    frame = spark.createDataFrame([(i, t, "en", *ROW) for i, t in pages], SCHEMA).repartition(4)
    take = lambda: sorted((tuple(r) for r in lines.drop_lines(frame).collect()), key=str)
    assert take() == brute_lines(pages)
    monkeypatch.setattr(lines, "CHUNK", 7)
    monkeypatch.setattr(lines, "SHARDS", 5)
    assert take() == brute_lines(pages)
    assert lines.drop_lines(spark.createDataFrame([], SCHEMA)).count() == 0


def test_perfect_hash_is_minimal():
    rng = np.random.default_rng(4)
    for n in (0, 1, 2, 1000, 50_000):
        h, fp = rng.integers(0, 2**64, (2, n), dtype=np.uint64)
        h[: n // 2] = h[0] if n else h[: n // 2]  # halves of keys may be equal
        own = lines.PerfectHash(h, fp)
        assert len(own) == n and sorted(own.slots(h, fp).tolist()) == list(range(n))
    others = rng.integers(0, 2**64, (2, 20_000), dtype=np.uint64)
    index = lines.LineIndex(h, fp, np.full(n, 3), np.arange(n), 3)
    assert len(index.probe(*others)[0]) == 0
    hit, keepers = index.probe(h, fp)
    assert len(hit) == n and (keepers == np.arange(n)).all()


# --- repeated strings ---


def test_names_are_not_equal_for_periodic_patterns(spark):
    """Texts that polynomials modulo a power of two cannot tell apart: a Thue-Morse string and its complement."""
    from quarterlight.llm import repeats

    bits = [0]
    while len(bits) < 2048:
        bits += [1 - b for b in bits]
    for length, letters in ((400, 512), (400, 1024), (2000, 2048)):
        a, b = ("".join("01"[x ^ flip] for x in bits[:letters]) for flip in (0, 1))
        same = "".join(random.Random(1).choice("xyz ") for _ in range(1200))
        texts = [same + a + same[::-1], same + b + same[::-1]]
        raw = [t.encode() for t in texts]
        seen = collections.Counter(r[i : i + length] for r in raw for i in range(len(r) - length + 1))
        want = []
        for r in raw:
            gone = np.zeros(len(r), bool)
            for i in range(len(r) - length + 1):
                if seen[r[i : i + length]] > 1:
                    gone[i : i + length] = True
            want.append(int(gone.sum()))
        got = repeats.remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), length=length).orderBy("doc_id").collect()
        assert [r["n_removed"] for r in got] == want
