"""Edge cases with defined results, and brute force on a small fixture."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarterlight.llm import bpe, language_model, mixing, quality, repeats, rules, sharding, simhash, topk, toxicity
from quarterlight.llm.components import star_components
from quarterlight.llm.registry import tokenizer_file

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard int, score double, size long, n int, key string, fp long"
WORDS = "the of and river stone light walks under bright small tower garden song winter paper cloud".split()
BLANK = re.compile(r"[^\x20\x09-\x0D]+")


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "s", ","]) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    """Plain texts, copies, near copies, shared passages, nulls, empties, a very long text, repeated rows and ids."""
    rng = random.Random(3)
    texts = [sentence(rng, rng.randint(1, 150)) for _ in range(40)]
    passage = sentence(rng, 90)
    texts += [texts[0]] * 4 + [texts[1] + " end"] + [f"{sentence(rng, 20)}\n{passage}\n{sentence(rng, 20)}" for _ in range(4)]
    texts += ["", None, "   \n\t", "a", "ab\x00c", "A B C", "a b c", sentence(rng, 6000) + "é\U0001f600" * 50, "the the " * 300, "x" * 5000, "<|endoftext|> and <|endoftext|>"]
    own = [(i, t, "en", None if i % 7 == 0 else f"s{i % 3}", None, 1, 0.5, 3, 2, "k", 9) for i, t in enumerate(texts)]
    return [*own, own[5], own[5], own[41], (None, "no id here", None, None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).persist()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark, rows):
    marks = [(r[0], int((r[0] or 0) % 3 > 0), int((r[0] or 0) % 5 == 0)) for r in rows] + [(None, 1, 1), (3, None, None)]
    return spark.createDataFrame(marks, "doc_id long, quality int, toxic int")


def raw(t):
    return (t or "").encode()


def test_sharding(docs, rows, empty):
    got = sharding.shard_rows(docs, 8).collect()
    assert len(got) == len(rows)
    slots = collections.defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    sizes = [len(v) for v in slots.values()]
    assert len(slots) == 8 and max(sizes) - min(sizes) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    want = collections.Counter((r[0], len(raw(r[1])) + 1, None if r[1] is None else zlib.crc32(raw(r[1]))) for r in rows)
    assert collections.Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == want
    assert sorted(map(tuple, sharding.shard_rows(docs.repartition(5)).collect()), key=str) == sorted(map(tuple, got), key=str)
    assert sharding.shard_rows(empty).count() == 0


def test_rules(docs, rows, empty):
    got = collections.Counter(map(tuple, rules.apply_rules(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()))
    want = collections.Counter()
    for r in rows:
        t = r[1] or ""
        w = BLANK.findall(t)
        grams = collections.Counter(zip(w, w[1:], w[2:]))
        hit = {i + k for i, g in enumerate(zip(w, w[1:], w[2:])) if grams[g] > 1 for k in range(3)}
        lines = [x for x in t.split("\n") if BLANK.search(x)]
        want[r[0], len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit), len(w) < 50 or 100 * len(hit) > 50 * len(w)] += 1
    assert got == want
    assert rules.apply_rules(docs).where("kept AND base_failed").count() == 0
    kept = rules.keep_good(docs)
    assert kept.columns == docs.columns and kept.count() == rules.apply_rules(docs).where("kept").count()
    assert rules.apply_rules(empty).count() == 0


def test_simhash_components_match_all_pairs(docs, rows, empty):
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    fps = {r.fingerprint for r in got}
    assert all(len(f) == 16 for f in fps) and {r.fingerprint for r in got if r.doc_id in (49, 50, 51)} == {"0" * 16}
    values, parent = sorted(int(f, 16) for f in fps), {}
    find = lambda x: x if parent.setdefault(x, x) == x else find(parent[x])
    for i, a in enumerate(values):
        for b in values[:i]:
            if (a ^ b).bit_count() <= 4:
                parent[find(a)] = find(b)
    least = {}
    for r in got:
        root = find(int(r.fingerprint, 16))
        ids = [x for x in (least.get(root), r.doc_id) if x is not None]
        least[root] = min(ids) if ids else None
    assert all(r.component_id == least[find(int(r.fingerprint, 16))] for r in got)
    assert simhash.near_duplicates(empty).count() == 0


def test_keep_first_chooses_rows_not_ids(spark, docs, rows, empty):
    rng = random.Random(21)
    near = sentence(rng, 400)
    more = [(None, sentence(rng, 80)), (None, sentence(rng, 80)), (900, near), (901, sentence(rng, 80)), (901, near), (902, sentence(rng, 80)), (902, sentence(rng, 80)), (None, near)]
    own = [*rows, *[(i, t, *rows[0][2:]) for i, t in more]]
    fps = [simhash.fingerprint(r[1] or "") for r in own]
    parent = {f: f for f in fps}
    find = lambda x: x if parent[x] == x else find(parent[x])
    for a in parent:
        for b in parent:
            if (a ^ b).bit_count() <= 4:
                parent[find(a)] = find(b)
    groups = collections.defaultdict(set)
    for r, f in zip(own, fps, strict=True):
        groups[find(f)].add(r)
    all_rows = spark.createDataFrame(own, SCHEMA)
    kept = simhash.keep_first(all_rows)
    got = [tuple(r) for r in kept.collect()]
    assert kept.columns == docs.columns and len(got) == len(groups)
    by_id = lambda r: (r[0] is None, r[0] or 0)
    for r in got:
        group = groups.pop(find(simhash.fingerprint(r[1] or "")))
        assert r in group and by_id(r) == min(map(by_id, group))
    assert sum(r[0] is None for r in got) >= 2 and {t for i, t in more[3:4] + more[5:7]} <= {r[1] for r in got}
    assert sorted(map(tuple, simhash.keep_first(all_rows.repartition(5)).collect()), key=str) == sorted(got, key=str)
    assert simhash.keep_first(empty).count() == 0


@pytest.mark.parametrize("single", [12, 3])  # one part a tree; pairs of parts
def test_vantage_tree_finds_every_link(spark, monkeypatch, single):
    monkeypatch.setattr(simhash, "SINGLE", single)
    assert len(simhash.tree_levels(6)) == (4 if single == 12 else 6)
    monkeypatch.setattr(simhash, "LEAF", 20)
    monkeypatch.setattr(simhash, "CELL", 64)
    rng = random.Random(5)
    values = {rng.getrandbits(64) for _ in range(600)}
    for v in list(values)[:150]:
        for _ in range(3):
            values.add(v ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 5))))
    signed = [(v - 2**64 if v >= 2**63 else v,) for v in values]
    roots = {r.node: r.root for r in star_components(simhash.links(spark.createDataFrame(signed, "fp long").repartition(3))).collect()}
    parent = {v: v for (v,) in signed}
    find = lambda x: x if parent[x] == x else find(parent[x])
    for i, (a,) in enumerate(signed):
        for (b,) in signed[:i]:
            if ((a ^ b) & (2**64 - 1)).bit_count() <= 4:
                parent[find(a)] = find(b)
    groups = collections.defaultdict(set)
    for (v,) in signed:
        groups[find(v)].add(v)
    for members in groups.values():
        assert {roots.get(v, v) for v in members} == {min(members)}


def test_top_k(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 20)).astype("float32")
    rows = [(i, [float(v) for v in e]) for i, e in enumerate(x)]
    rows += [(50, rows[50][1]), (400, None), (450, [1.0, None] + [0.0] * 18), (500, [float("nan")] * 20), (None, rows[3][1]), (550, [])]
    got = collections.defaultdict(list)
    for r in topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), k=5).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    own = [(i, np.floor(256 * np.array(e, float)).astype(int)) for i, e in rows[:301]]
    for j, (q, e) in enumerate(own):
        if q % 50 == 0 and q != 50:
            want = sorted(((-int(e @ f), i) for k, (i, f) in enumerate(own) if k != j))[:5]
            assert got[q] == [(i, -s) for s, i in want]
    assert len(got[50]) == 10 and set(got) == {0, 50, 100, 150, 200, 250}
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    assert topk.top_k(spark.createDataFrame(rows[:3], "vec_id long, embedding array<float>")).count() == 2


def test_bpe_equals_the_library_and_round_trips(spark, docs, rows, empty):
    tokenizers = pytest.importorskip("tokenizers")
    path = tokenizer_file()
    library, spec = tokenizers.Tokenizer.from_file(path), open(path, encoding="utf-8").read()
    got = collections.Counter(map(tuple, bpe.digest_documents(docs, spec).collect()))
    want = collections.Counter()
    for r in rows:
        ids = library.encode(r[1] or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        want[r[0], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()] += 1
    assert got == want
    assert bpe.digest_documents(empty, spec).count() == 0


def test_bpe_memory_does_not_grow_with_the_text():
    import tracemalloc

    v = bpe.Vocabulary(open(tokenizer_file(), encoding="utf-8").read())
    peaks = []
    for unit in ("the quick brown fox, 1234 jumps! ", "abcdefghij"):  # with places to cut at, and one piece without any
        for n in (100_000, 2_000_000):
            raw = memoryview((unit * (n // len(unit))).encode())
            encoder = bpe.Encoder(v)
            tracemalloc.start()
            count, _, text = bpe._digests(v, encoder.blocks(raw))
            peaks.append(tracemalloc.get_traced_memory()[1])
            tracemalloc.stop()
            assert count > n / 20 and text == hashlib.sha256(raw).hexdigest()
    assert peaks[1] < peaks[0] + 3e6 and peaks[3] < 2.2 * 2_000_000 + 6e6  # a piece without a cut is one str; no ids are held


def test_bpe_stream_equals_whole_merge():
    v = bpe.Vocabulary(open(tokenizer_file(), encoding="utf-8").read())
    rng = random.Random(2)
    for alphabet in ("ab", "the ", "ingtion", "=-", " ", "0123456789"):
        piece = "".join(rng.choice(alphabet) for _ in range(4000)).encode()
        assert list(v.stream(piece[i : i + 7] for i in range(0, len(piece), 7))) == v.merge(piece)


def test_language_model(docs, rows, empty, monkeypatch):
    monkeypatch.setattr(language_model, "FREQUENT", 10)
    got = language_model.score(docs).collect()
    crc = lambda i: zlib.crc32(("" if i is None else str(i)).encode())
    words = lambda t: [w.translate(simhash.LOWER) for w in raw(t).split()] + [None]
    counts = collections.Counter(w for r in rows if crc(r[0]) % 7 != 2 for w in words(r[1]))
    n, v = sum(counts.values()), len(counts)
    want = collections.Counter()
    for r in rows:
        w = words(r[1])
        want[r[0], crc(r[0]) % 7 == 2, len(w), sum(counts[x] > 0 for x in w), n, round(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w), 6)] += 1
    assert collections.Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    learnt = [r for r in got if not r.held_out]
    assert sum(r.score for r in learnt) > sum(r.base_score for r in learnt)
    assert language_model.score(empty).count() == 0
    alone = language_model.score(docs, held_out=F.lit(True)).collect()
    assert all(r.n_known == 0 and r.base_score == 0 and r.train_tokens == 0 for r in alone)


def small_model(texts):
    """The model's arrays from counts made one token at a time."""
    counts = collections.Counter(w for t in texts for w in language_model.tokens(t))
    words = sorted(counts, key=lambda w: (-counts[w], w))
    known = language_model.Words(*language_model.Words.parts([(w, counts[w]) for w in words], len(texts)))
    table, groups = np.zeros((language_model.ROWS, language_model.WIDTH), np.float32), np.zeros((32, 32))
    for t in texts:
        _, group, hashes, first, _, _ = language_model.read_texts(known, pa.array([t], pa.string()))
        r, cls, slot = language_model.table_rows(group, hashes, first)
        for i in range(len(group)):
            groups[cls[i], slot[i]] += 1
            for k in range(3):
                table[r[0][k][i], cls[i]] += 1
                table[r[1][k][i], slot[i]] += 1
    valid = np.zeros((32, 32), bool)
    valid[15:31] = True
    valid[31, 0] = True
    for i in range(min(len(words), language_model.OWN)):
        valid[i // 32, i % 32] = True
    return known, counts, table, groups, valid, language_model.prepare(table, groups, valid)


def test_language_model_is_a_softmax(monkeypatch):
    monkeypatch.setattr(language_model, "STEP", 50)
    rng = random.Random(6)
    texts = [sentence(rng, rng.randint(0, 40)) for _ in range(30)] + [None, "odd word"]
    known, counts, table, groups, valid, model = small_model(texts)
    weights = np.random.default_rng(1).uniform(0.1, 0.9, (2, language_model.PARAMETERS))
    _, group, hashes, first, lengths, _ = language_model.read_texts(known, pa.array([*texts, "never seen this"]))
    scorer = language_model.Scorer(model, weights)
    got = language_model.token_scores(scorer, group, hashes, first)
    rows, cls, slot = language_model.table_rows(group, hashes, first)
    assert first.sum() == len(texts) + 1 and lengths.sum() + len(lengths) == len(group)
    for i in [*range(0, len(group), 7), len(group) - 1]:
        want = 0.0
        for factor, (own, width) in enumerate(((cls[i], valid.any(axis=1)), (slot[i], valid[cls[i]]))):
            share = groups.sum(axis=1) if factor == 0 else groups[cls[i]]
            q = [(share[o] + 1) * bool(width[o]) for o in range(32)]
            z = []
            for o in range(32):
                if not width[o]:
                    continue
                base = q[o] / sum(q)
                x = math.log(base)
                for k in range(3):
                    row = table[rows[factor][k][i]]
                    size = sum(row.sum() >= b for b in language_model.SIZES)
                    even = base if factor == 0 else 1 / 32
                    x += weights[factor][k * (len(language_model.SIZES) + 1) + size] * math.log((row[o] + even) / even)
                z.append((o, x))
            most = max(x for _, x in z)
            want += dict(z)[own] - most - math.log(sum(math.exp(x - most) for _, x in z))
        assert got[i] == pytest.approx(want, abs=2e-3)
    # In any context the probabilities of all words, known and unknown, add up to one.
    at = 5
    total = 0.0
    for g in np.flatnonzero(valid.ravel()):
        group[at] = g
        total += math.exp(language_model.token_scores(scorer, group[: at + 1], hashes[: at + 1], first[: at + 1])[at])
    assert total == pytest.approx(1, abs=1e-3)
    assert len(counts) <= language_model.OWN  # here every word has a slot of its own, so its word factor is one


def test_language_model_words_are_those_of_split():
    texts = ["Abc  d\te", "", None, "x", " lead", "trail ", "one", "two\u00a0three É\x0bfour\x0c", "?!... a.b! ??", "w" * 5000]
    column = pa.array(["not read", *texts, "nor this"]).slice(1, len(texts))
    known = language_model.Words(*language_model.Words.parts([(b"one", 9), (b"x", 5), (b"d", 1)], 3))
    at, group, hashes, first, lengths, (low, starts, ends) = language_model.read_texts(known, column)
    want = [language_model.tokens(t) for t in texts]
    assert [low[a:z].tobytes() for a, z in zip(starts, ends, strict=True)] == [w for own in want for w in own] and lengths.tolist() == list(map(len, want))
    flat = [w for own in want for w in [*own, None]]
    assert [{b"one": 0, b"x": 1, b"d": 2}.get(w, -1) for w in flat] == at.tolist()
    assert np.flatnonzero(first).tolist() == [0, *(np.cumsum([len(w) + 1 for w in want])[:-1]).tolist()]
    by_word = {}
    for w, g, h in zip(flat, group.tolist(), hashes.tolist(), strict=True):
        assert by_word.setdefault(w, (g, h)) == (g, h)
    assert len({h for _, h in by_word.values()}) == len(by_word)
    many = [b"%d" % i for i in range(5000)]
    known = language_model.Words(*language_model.Words.parts([(w, 1) for w in many], 1))
    assert known.places(language_model.words_of(many)[3]).tolist() == list(range(5000)) and len(known.tables) > 1
    same_end = language_model.words_of([b"nation", b"station.", b"ration!?"])
    assert len(set((language_model.other_groups(*same_end[:4]) // 32).tolist())) == 1


def test_language_model_gradient():
    rng = random.Random(8)
    texts = [sentence(rng, 30) for _ in range(12)]
    known, _, _, _, _, model = small_model(texts[:8])
    _, group, hashes, first, _, _ = language_model.read_texts(known, pa.array(texts[8:]))
    weights = np.full((2, language_model.PARAMETERS), 0.4)
    likelihood = lambda w: language_model.token_scores(language_model.Scorer(model, w), group, hashes, first).sum()
    g, h = language_model.gradient_sums(language_model.Scorer(model, weights), group, hashes, first)
    for factor, i in ((0, 0), (0, 3), (0, 10), (1, 1), (1, 17)):
        moved = [weights.copy(), weights.copy()]
        moved[0][factor, i] -= 0.05
        moved[1][factor, i] += 0.05
        low, high = map(likelihood, moved)
        assert g[factor, i] == pytest.approx((high - low) / 0.1, rel=0.02, abs=0.05)
    assert (np.linalg.eigvalsh(h[0]) > -1e-2).all()
    better = language_model.newton_step(weights, g, h)
    assert likelihood(better) > likelihood(weights)


def test_language_model_table_is_added_up(spark, docs):
    blocks = [(i % 5, np.full(4, i, np.int64).tobytes()) for i in range(40)]
    import zstandard

    table = spark.createDataFrame([(b, zstandard.compress(x)) for b, x in blocks], "block int, data binary")
    for partitions in (4, 1000):
        got = {r.block: np.frombuffer(zstandard.decompress(r.data), np.int64).tolist() for r in language_model.add_tables(table, partitions).collect()}
        assert got == {b: [sum(i for i in range(40) if i % 5 == b)] * 4 for b in range(5)}


def test_mixing(docs, rows, empty):
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    size = collections.Counter()
    for r in rows:
        size[r[3]] += len(BLANK.findall(r[1] or ""))
    order = sorted(size, key=lambda s: (s is None, s))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target, free, left = {}, set(order), 1.5 * sum(size.values())
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 2 * size[s]}
        if not over:
            target.update(share)
            break
        for s in over:
            target[s] = 2 * size[s]
        left -= sum(target[s] for s in over)
        free -= over
    taken = collections.Counter()
    for r in got:
        assert 0 <= r.taken <= 2 * r["size"] and r.source_size == size[r.source] and r.target == pytest.approx(target[r.source])
        taken[r.source] += r.taken
    biggest = max(r["size"] for r in got)
    assert all(abs(taken[s] - target[s]) <= max(30, biggest / 2) for s in order)
    again = mixing.mix(docs.repartition(4)).collect()
    assert collections.Counter(map(tuple, again)) == collections.Counter(map(tuple, got))
    assert mixing.mix(empty).count() == 0
    repeated = mixing.repeat_rows(docs)
    assert repeated.columns == docs.columns and repeated.count() == sum(r.copies for r in got)


def test_mixing_keeps_every_text_of_an_id(spark):
    """Null ids, one id with several texts, equal rows and two texts with one CRC-32 are told apart."""
    a, b = "plumless words here", "buckeroo words here"
    assert zlib.crc32(a[:8].encode()) == zlib.crc32(b[:8].encode())
    rows = [(i, t, s, x) for s in ("x", None) for x in (1, 2) for i, t in ((None, a[:8]), (None, b[:8]), (1, a), (1, b), (2, "same"))] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, _copies int").repartition(3)
    want = collections.Counter()
    for r in mixing.mix(df, share=2.0).collect():  # every row twice
        want[r.doc_id, r.source, bytes(r.digest)] += r.copies
    got = mixing.repeat_rows(df, share=2.0).collect()
    assert collections.Counter((r.doc_id, r.source, hashlib.sha256(r.text.encode()).digest()) for r in got) == want
    assert collections.Counter(map(tuple, got)) == collections.Counter({r: 2 * n for r, n in collections.Counter(rows).items()})


CLASHES = ("_w", "_h", "_l", "_rules", "row", "_row", "_id", "id", "_crc", "_own", "_copy", "copies", "ranges", "key", "packed", "_k", "h1", "none", "first", "digest", "m")


def test_stages_allow_any_column_names(spark, rows):
    names = ", ".join(f"{c} int" for c in CLASHES)
    own = [(r[0], r[1], r[3], *[i + j for j in range(len(CLASHES))]) for i, r in enumerate(rows)]
    df = spark.createDataFrame(own, f"doc_id long, text string, source string, {names}").repartition(2)
    known = {t[3]: t for t in own}
    for stage in (rules.keep_good, simhash.keep_first, mixing.repeat_rows, lambda x: repeats.without_repeats(x, 120, 24)):
        found = stage(df)
        assert found.columns == df.columns
        for r in found.collect():
            assert (r.doc_id, *r[2:]) == (known[r["_w"]][0], *known[r["_w"]][2:]) or stage is simhash.keep_first

def test_mixing_deals_copies_to_every_one_of_many_equal_rows(spark):
    """More equal rows than a portion holds, and as many empty texts of other ids."""
    hot, n = mixing.PORTION + 1500, 2000
    rows = [(7, "one two three", "a")] * hot + [(100 + i, " ".join(["w"] * (1 + i % 9)), "a") for i in range(n)] + [(10_000 + i, "", "a") for i in range(n)] + [(5, None, None), (6, "x y", "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df, share=1.2).toPandas()
    assert len(got) == len(rows) and (got.doc_id == 7).sum() == hot and got.copies.between(0, 2).all()
    for _, own in got.groupby("source"):
        assert abs(own.taken.sum() - own.target.iloc[0]) <= own["size"].max()
    again = mixing.repeat_rows(df, share=1.2).groupBy("doc_id").count().toPandas().set_index("doc_id")["count"]
    wanted = got.groupby("doc_id").copies.sum()
    assert again.sort_index().to_dict() == wanted[wanted > 0].sort_index().to_dict() and again[7] > mixing.PORTION


def test_mixing_tilts_by_size(spark):
    sizes = {"few": ([1, 2, 3, 400, 5, 5, 90], 0.4), "many": ([7, 30, 30, 200, 0, 1000], 1.7), "deep": ([1] * 50 + [5000, 300], 1.9999), "full": ([4, 5], 2.0), "one": ([6, 6, 6], 0.5), None: ([3, 8, 40], 0.01)}
    hist = [(s, z, c) for s, (all_z, _) in sizes.items() for z, c in collections.Counter(all_z).items()]
    goals = [(s, len(z), sum(z), sum(z) * ratio) for s, (z, ratio) in sizes.items()]
    found = mixing.balance(spark.createDataFrame(hist, "source string, size long, m long"), spark.createDataFrame(goals, "source string, docs long, words long, target double"))
    for r in found.collect():
        z, ratio = sizes[r.source]
        rates = [2 / (1 + math.exp(-min(60, r.a + r.b * x / r["mean"]))) for x in z]
        assert sum(x * y for x, y in zip(z, rates, strict=True)) == pytest.approx(r.target, rel=1e-6)
        if r.source != "full":
            assert r.a == 0 and (r.b > 0) == (ratio > 1) and abs(r.b) > 0.01
    rng = random.Random(4)
    rows = [(i, sentence(rng, rng.choice([20, 60, 200])), "ab"[i % 2]) for i in range(400)]
    mixed = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), share=1.2).collect()
    copies = lambda size: np.mean([r.copies for r in mixed if r.source == "b" and r["size"] == size])
    assert copies(20) > copies(60) + 0.02 > copies(200) + 0.04


def test_repeats(docs, rows, empty):
    length = 120
    got = repeats.remove_repeats(docs, length, 24).collect()
    texts = [raw(r[1]) for r in rows]
    counts = collections.Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    want = collections.Counter()
    for r, t in zip(rows, texts, strict=True):
        mask = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if counts[t[i : i + length]] > 1:
                mask[i : i + length] = b"\1" * length
        kept = bytes(b for b, m in zip(t, mask, strict=True) if not m)
        want[r[0], len(t), sum(mask), len(re.findall(b"\1+", bytes(mask))), hashlib.sha256(kept).hexdigest()] += 1
    assert collections.Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == want
    assert sum(r.n_removed for r in got) > 0
    assert repeats.remove_repeats(empty).count() == 0


def test_passages_over_and_under_the_length(spark):
    """A passage of over 400 bytes goes from both documents; one of 51 words below it stays, but is counted."""
    rng = random.Random(17)
    fresh = lambda n: " ".join("".join(rng.choice("abcdefghijklm") for _ in range(rng.randint(3, 7))) for _ in range(n))
    long, short, tiny = fresh(90), fresh(51), fresh(15)
    assert len(long) > 400 > len(short) > 240 and len(tiny) < 128
    texts = [fresh(60) + " " + long + " " + fresh(60), fresh(7) + " " + long, fresh(80) + " " + short + " " + fresh(33), fresh(9) + " " + short, fresh(100) + " " + tiny, tiny + " " + fresh(70), fresh(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in repeats.remove_repeats(df).collect()}
    assert all(len(long) <= got[i].n_removed <= len(long) + 2 for i in (0, 1))  # blanks and letters beside it may agree
    assert all(got[i].n_removed == 0 for i in range(2, 7))
    assert [got[i].n_passages > 0 for i in range(7)] == [True, True, True, True, False, False, False]
    kept = {r.doc_id: r.text for r in repeats.without_repeats(df, 240).collect()}
    assert all(long not in kept[i] and short not in kept[i] for i in range(7)) and [kept[i] for i in (4, 5, 6)] == texts[4:]


def test_repeats_keep_rows_and_columns(docs, rows):
    length = 120
    cut = repeats.without_repeats(docs, length, 24)
    assert cut.columns == docs.columns and cut.count() == len(rows)


def check_scores(scored, n):
    rows = scored.collect()
    assert len(rows) == n and all(0 <= r.score <= 1 for r in rows)
    return rows


def test_quality_edges(docs, rows, labels, empty):
    got = check_scores(quality.classify(docs, labels), len(rows))
    assert all(r.predicted == int(r.score >= 0.7) for r in got)
    assert quality.classify(empty, labels).count() == 0
    unlabelled = quality.classify(docs, labels.where("false"))
    assert {r.score for r in unlabelled.collect()} == {0.5}


def test_toxicity_edges_and_folding(docs, rows, labels, empty):
    check_scores(toxicity.score(docs, labels), len(rows))
    assert toxicity.score(empty, labels).count() == 0
    check_scores(toxicity.score(docs, labels.where("false")), len(rows))
    table = toxicity.folding_table()
    assert toxicity.folded("1dіоt  İD1ÖT, m0rön!", table) == " idiot idiot moron "


def test_scores_learn_from_held_in_rows_only(spark):
    rng = random.Random(9)
    rows, marks = [], []
    for i in range(400):
        bad, rude = i % 4 == 0, i % 3 == 0
        text = sentence(rng, 60)
        if bad:
            text = text.upper().replace(" ", "!! ")
        if rude:
            text += " you 1di0t" if i % 2 else " you IDIOT"
        rows.append((i, text))
        marks.append((i, int(not bad), int(rude)))
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    truth = {i: (q, t) for i, q, t in marks}
    for k, found in enumerate((quality.classify(docs, labels), toxicity.score(docs, labels))):
        held = [r for r in found.collect() if r.held_out]
        assert held and all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in held)
        assert sum(r.predicted == truth[r.doc_id][k] for r in held) >= 0.95 * len(held)


def test_toxicity_prior_is_that_of_all_labels(spark, monkeypatch):
    rng = random.Random(11)
    rows = [(i, sentence(rng, 30) + (" you idiot" if i % 8 == 0 and i % 3 else " idiot" if i % 40 == 1 else "")) for i in range(1200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 8 == 0)) for i, _ in rows], "doc_id long, toxic int")
    mean = lambda: np.mean([r.score for r in toxicity.score(docs, labels).collect()])
    whole = mean()
    monkeypatch.setattr(toxicity, "SAMPLE", 100)
    assert whole == pytest.approx(1 / 8, abs=0.02) and mean() == pytest.approx(whole, abs=0.04)
    one_class = toxicity.score(docs, labels.where("toxic = 0")).first().score
    monkeypatch.setattr(toxicity, "SAMPLE", 40_000)
    assert toxicity.score(docs, labels.where("toxic = 0")).first().score == pytest.approx(one_class, rel=0.01)


def test_quality_score_is_the_difference_of_two_gaussians(spark, docs, rows, labels):
    marks = [(r[0], int((r[0] or 0) % 3 > 0)) for r in rows if r[0] is not None]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 4 == 2
    by_id = collections.defaultdict(list)
    for r in rows:
        by_id[r[0]].append(np.array(quality.statistics(r[1] or "")))
    x = {k: np.array([v for i, y in marks if y == k and not held(i) for v in by_id[i]]) for k in (0, 1)}  # repeated labels and rows count each time
    n = {k: len(v) for k, v in x.items()}
    own = {k: np.cov(v.T, bias=True) for k, v in x.items()}
    pooled = (n[0] * own[0] + n[1] * own[1]) / (n[0] + n[1])
    cov = {k: (1 - quality.POOL - quality.DIAGONAL) * own[k] + quality.POOL * pooled + quality.DIAGONAL * np.diag(np.diag(own[k])) + quality.NOISE * np.eye(len(pooled)) for k in (0, 1)}
    got = quality.classify(docs, labels).collect()
    want = collections.Counter()
    for r in rows:
        v = np.array(quality.statistics(r[1] or ""))
        z = math.log((n[1] + 1) / (n[0] + 1))
        for k, sign in ((0, -1), (1, 1)):
            d = v - x[k].mean(axis=0)
            z += sign * -0.5 * (d @ np.linalg.solve(cov[k], d) + np.linalg.slogdet(cov[k])[1])
        want[r[0], held(r[0]), round(1 / (1 + math.exp(-max(-30, min(30, z)))), 5)] += 1
    assert collections.Counter((r.doc_id, r.held_out, round(r.score, 5)) for r in got) == want


def test_toxicity_score_by_plain_search(spark):
    rng = random.Random(12)
    rude = ["idiot", "moron", "1di0t", "mоron", "IDIOT!"]
    rows = [(i, sentence(rng, 40) + (f" you {rng.choice(rude)} {rng.choice(WORDS)}" if i % 4 == 0 else " the moron dynasty" if i % 40 == 3 else "")) for i in range(600)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, int(i % 4 == 0)) for i, _ in rows], "doc_id long, toxic int")
    table = toxicity.folding_table()
    lexicon = toxicity.learn(docs, labels, "toxic", table)
    assert any(t.strip() and "idiot".startswith(t.strip()) for t in lexicon.weights) and lexicon.exceptions
    a, b, c = lexicon.curve
    for r in toxicity.score(docs, labels).collect():
        text = toxicity.folded(rows[r.doc_id][1], table)
        total = 0.0
        for term, w in [*lexicon.weights.items(), *lexicon.exceptions.items()]:
            total += w * sum(text.startswith(term, i) for i in range(len(text)))
        total = max(0.0, total)
        z = a + b * math.sqrt(total) + c * math.log1p(100 * total / len(text.split()))
        assert r.score == pytest.approx(1 / (1 + math.exp(-max(-30, min(30, z)))), abs=1e-9)
