import collections
import hashlib
import os
import random
import re

import numpy as np
import pytest

import corpus_pipeline
from quarterlight.llm import rules, simhash
from quarterlight.llm.registry import tokenizer_file

DATA = "/root/testdata/sf0.001"
WORDS = "the of and river stone light walks under bright small tower garden song winter paper cloud".split()


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_stages_in_order(spark):
    docs = corpus_pipeline.documents(spark, DATA)
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialize(stage(spark, docs, DATA))
        assert docs.columns == columns, name
        counts.append(docs.count())
    assert counts[0] > counts[1] > counts[2] == counts[3] > 0
    tokens = corpus_pipeline.STAGES[-1][1](spark, docs, DATA)
    assert tokens.count() == counts[-1] and tokens.where("n_tokens * 4 <> length(ids)").count() == 0


def passes(text):
    """The quality rules in plain Python."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    if n < 50:
        return False
    grams = list(zip(words, words[1:], words[2:]))
    often = collections.Counter(grams)
    repeated = len({i + k for i, g in enumerate(grams) if often[g] > 1 for k in range(3)})
    lines = [x for x in text.split("\n") if x.strip(" \t\n\v\f\r")]
    stops = sum(w.lower() in set(rules.FUNCTION_WORDS) for w in words)
    return (
        100 * repeated <= 50 * n and 2 <= sum(map(len, words)) / n <= 15 and len(re.findall(r"[#*$%&|<>]", text)) / n <= 0.10
        and stops / n >= 0.015 and 1 - len(set(lines)) / len(lines) <= 0.50
    )


def one_of_each_group(docs):
    """The row of the smallest id, null last, of each group of fingerprints within four bits."""
    prints = [simhash.fingerprint(d[1] or "") for d in docs]
    parent = {f: f for f in prints}
    find = lambda x: x if parent[x] == x else find(parent[x])
    for a in parent:
        for b in parent:
            if (a ^ b).bit_count() <= 4:
                parent[find(a)] = find(b)
    groups = collections.defaultdict(list)
    for d, f in zip(docs, prints, strict=True):
        groups[find(f)].append(d)
    return [min(g, key=lambda d: (d[0] is None, d[0] or 0)) for g in groups.values()]


def without_passages(docs, length):
    texts = [d[1].encode() for d in docs]
    counts = collections.Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for d, t in zip(docs, texts, strict=True):
        cut = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if counts[t[i : i + length]] > 1:
                cut[i : i + length] = b"\1" * length
        out.append((d[0], bytes(b for b, m in zip(t, cut, strict=True) if not m).decode("utf-8", "ignore"), d[2]))
    return out


def test_run_agrees_with_plain_python(spark, tmp_path):
    tokenizers = pytest.importorskip("tokenizers")
    rng = random.Random(5)
    fresh = lambda n: " ".join(rng.choice(WORDS) + "".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 4))) for _ in range(n))
    passage = fresh(52)
    texts = [fresh(rng.randint(40, 160)) for _ in range(30)] + ["", None, "the " * 100, "# $ " * 60]
    texts += [f"{fresh(70)} {passage} {fresh(40)}" for _ in range(3)]
    docs = [(i, t, f"s{i % 2}" if i % 5 else None) for i, t in enumerate(texts)]
    docs += [(100, texts[0], "s0"), (101, texts[1] + " end", "s1"), (None, fresh(90), "s1"), (None, fresh(90), "s1"), (7, fresh(90), "s0"), docs[3]]
    spark.createDataFrame([(*d, len(d[1] or "")) for d in docs], "doc_id long, text string, source string, n_chars long").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = collections.Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())

    want = without_passages(one_of_each_group([d for d in docs if passes(d[1])]), corpus_pipeline.PASSAGE)
    library = tokenizers.Tokenizer.from_file(tokenizer_file())
    known, taken, size = {}, collections.Counter(), collections.Counter()
    for i, t, source in want:
        ids = library.encode(t, add_special_tokens=False).ids
        row = i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()
        known[row] = source
        taken[source] += got[row] * len(t.split())
        size[source] += len(t.split())
        assert got[row] <= 2
    assert set(got) <= set(known)
    # Weights 3, 1, 2 of the sources s0, s1 and none, at most twice a source, together 150 % of all words.
    order = sorted(size, key=lambda s: (s is None, s))
    weight, target, free, left = dict(zip(order, (3, 1, 2), strict=True)), {}, set(order), 1.5 * sum(size.values())
    while over := [s for s in free if left * weight[s] / sum(weight[x] for x in free) > 2 * size[s]]:
        for s in over:
            target[s] = 2 * size[s]
            free.remove(s)
        left = 1.5 * sum(size.values()) - sum(target.values())
    target |= {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
    longest = max(len(t.split()) for _, t, _ in want)
    assert all(abs(taken[s] - target[s]) <= longest for s in order)
