"""Language-model scores: a hashed maximum-entropy model with a class-factored softmax.

log P(w | h) = log P(class | h) + log P(slot | class, h) + log P(w | class, slot). Each of the
first two factors is a softmax over 32 outcomes whose features are hashed contexts of words: the
previous word (bigram), the word before it (skip) and both (trigram). A context's row of a
hashed table tells how often each outcome followed it in all training text; the feature's value for an
outcome is the log of that smoothed count over the outcome's own share, and the features'
weights, one for each kind and size of row, are trained by Newton steps on the conditional likelihood. Each
update is one distributed job over a part of the training texts, whose own counts are left out
of the table, so that rare contexts are not trusted more than they deserve; every text is in one part.
Frequent words have a slot of their own; others share slots by ending and hash, and the word
factor inside a slot is the add-one unigram.

All training text is counted: word counts and table cells are summed per task before their
shuffle, the table as compressed blocks, which are added up block by block. The table has a fixed
number of cells, so what goes to the tasks is bounded; words beyond a bounded number of
frequent ones get their counts through a join.
"""

from __future__ import annotations

from collections import Counter
from itertools import chain

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fold, materialize, slices
from .simhash import LOWER

#: Frequent words whose counts travel with the tasks; the others are joined.
FREQUENT = 100_000
#: Outcomes of either factor; words with a slot of their own; the class of the end of a text.
WIDTH, OWN = 32, 480
END = WIDTH - 1
ENDING = 3
#: Hashed rows, in powers of two, of the bigram, skip and trigram features of the class factor and of the slot factor.
ROW_BITS = ((14, 14, 16), (15, 15, 17))
#: Smoothing counts of a row; gradient updates; ridge towards the first weight of every feature.
SMOOTH, UPDATES, RIDGE, FIRST = 1.0, 3, 10.0, 0.25
#: Row sizes from which a feature has another weight.
SIZES = (1, 2, 4, 8, 32, 128, 1024)
FLUSH = 400_000
#: Cells of a block in which the table is added up; tokens that are worked on at once (their arrays stay in the processor's cache).
BLOCK, STEP = 1 << 15, 1024
END_HASH = np.uint64(0x9E3779B97F4A7C15)
#: By byte: whether it separates words, is punctuation at a word's end, its lower-case form, and a random number for hashes.
BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
MARK = np.isin(np.arange(256), list(b".,;:!?#*$%&|<>()\"'"))
LOWERED = np.frombuffer(LOWER, np.uint8)
NOISE = np.random.default_rng(7).integers(1, 2**63, 256, dtype=np.uint64)
BASE = 0xD6E8FEB86659FD93
ONES = np.ones(WIDTH, np.float32)


def tokens(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8").translate(LOWER).split()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


_POWERS: dict[bool, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE and its inverse to the powers 0..n-1, modulo 2**64; kept by the task."""
    if len(_POWERS.get(False, ())) < n:
        for inverse in (False, True):
            x = np.full(max(n, 1 << 18), pow(BASE, -1, 2**64) if inverse else BASE, np.uint64)
            x[0] = 1
            _POWERS[inverse] = np.cumprod(x, dtype=np.uint64)
    return _POWERS[False][:n], _POWERS[True][:n]


def find_words(raw: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, starts, ends and 64-bit hashes of the words of some texts that stand one after another, and the words of each text.

    ``edges``: where the texts begin, and the end of the last.
    """
    low = LOWERED[raw]
    inside = np.zeros(len(raw) + 2, bool)
    inside[1:-1] = ~BLANK[raw]
    begins, stops = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
    cuts = edges[(edges > 0) & (edges < len(raw))]
    begins[cuts] = inside[1:-1][cuts]
    stops[cuts - 1] = inside[1:-1][cuts - 1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    up, down = _powers(len(raw) + 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(NOISE[low] * up[: len(raw)], dtype=np.uint64)))
    hashes = _mixed((sums[ends] - sums[starts]) * down[starts])
    return low, starts, ends, hashes, np.diff(np.searchsorted(starts, edges))


def other_groups(low: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """class * WIDTH + slot of words without a slot of their own: class by the last ENDING bytes before punctuation, slot by hash."""
    ends, open_ = ends.copy(), np.arange(len(ends))
    while len(open_):
        open_ = open_[(ends[open_] > starts[open_]) & MARK[low[ends[open_] - 1]]]
        ends[open_] -= 1
    ending = np.zeros(len(ends), np.uint64)
    for k in range(1, ENDING + 1):
        at = ends - k
        ending = ending * np.uint64(257) + np.where(at >= starts, low[np.maximum(at, 0)].astype(np.uint64) + np.uint64(1), np.uint64(0))
    first = OWN // WIDTH
    cls = first + (_mixed(ending * np.uint64(BASE)) >> np.uint64(40)).astype(np.int64) % (END - first)
    return cls * WIDTH + (hashes >> np.uint64(59)).astype(np.int64)


def words_of(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """``find_words`` of a list of texts."""
    return find_words(np.frombuffer(b"".join(texts), np.uint8), np.concatenate(([0], np.cumsum([len(t) for t in texts], dtype=np.int64))))


def column_words(column) -> tuple[np.ndarray, ...]:
    """``find_words`` of an Arrow column of texts, read where they lie; a null text has none."""
    import pyarrow as pa

    column, n = column.cast(pa.large_string()), len(column)
    edges = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[edges[0] : edges[-1]] if data is not None else np.zeros(0, np.uint8)
    return find_words(raw, edges - edges[0])


def word_counts(rows: DataFrame) -> DataFrame:
    """word (binary; null stands for the end of a text), c: summed per task, flushed when the sums grow large, then over all tasks."""

    def run(batches):
        import pyarrow as pa

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.binary()), pa.array(list(sums.values()), pa.int64())], ["word", "c"])

        sums: Counter = Counter()
        for b in slices(batches, 256):
            low, starts, ends, hashes, _ = column_words(b.column(0))
            _, at, n = np.unique(hashes, return_index=True, return_counts=True)
            raw = low.tobytes()
            for a, z, c in zip(starts[at].tolist(), ends[at].tolist(), n.tolist(), strict=True):
                sums[raw[a:z]] += c
            sums[None] += b.num_rows
            if len(sums) > FLUSH:
                yield out()
                sums.clear()
        yield out()

    return rows.select("text").mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


class Words:
    """The frequent words' places by hash, with the counts and groups of all of them."""

    def __init__(self, counts: np.ndarray, group: np.ndarray, hashes: np.ndarray, end: int):
        self.log_count, self.group, self.hash = np.log10(counts + 1.0), group, hashes
        self.log_end, self.end_known = float(np.log10(end + 1)), int(end > 0)
        # Tables by some bits of the hash; words that meet in one go on to the next.
        self.tables: list[tuple[int, np.ndarray]] = []
        left, bits = np.arange(len(hashes)), max(4, int(8 * len(hashes)).bit_length())
        while len(left):
            table = np.full(1 << bits, -1, np.int32)
            table[self._slot(hashes[left], len(self.tables), bits)] = left
            self.tables.append((bits, table))
            left = left[table[self._slot(hashes[left], len(self.tables) - 1, bits)] != left]

    @staticmethod
    def _slot(h: np.ndarray, level: int, bits: int) -> np.ndarray:
        return ((h * np.uint64(2 * level + 1)) >> np.uint64(64 - bits)).astype(np.int64)

    @staticmethod
    def parts(frequent: list[tuple[bytes, int]], end: int) -> tuple:
        """What the constructor takes, for all tasks: of words by falling count, and the count of ends."""
        low, starts, ends, hashes, _ = words_of([w for w, _ in frequent])
        group = other_groups(low, starts, ends, hashes)
        group[:OWN] = np.arange(len(group))[:OWN]
        return np.array([c for _, c in frequent], np.int64), group, hashes, end

    def places(self, h: np.ndarray) -> np.ndarray:
        """Place among the frequent words of each hash, or -1."""
        out = np.full(len(h), -1, np.int64)
        left = np.arange(len(h))
        for level, (bits, table) in enumerate(self.tables):
            at = table[self._slot(h[left], level, bits)]
            same = (at >= 0) & (self.hash[np.maximum(at, 0)] == h[left])
            out[left[same]] = at[same]
            left = left[~same & (at >= 0)]
        return out


def _rows(kind: int, x: np.ndarray, bits: int) -> np.ndarray:
    """Row of each context hash, by multiplication."""
    x = (x + np.uint64(kind + 1)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (x >> np.uint64(64 - bits)).astype(np.int64)


#: First row of each feature of each factor in the table, and the rows of the whole table.
OFFSETS, ROWS = [], 0
for _bits in ROW_BITS:
    OFFSETS.append([ROWS + sum(1 << b for b in _bits[:k]) for k in range(len(_bits))])
    ROWS += sum(1 << b for b in _bits)


def table_rows(group: np.ndarray, hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of the table that the features of each token stand in (factor, feature, token), and the token's class and slot.

    ``first`` tells which tokens begin a text; before a text stands its end.
    """
    before = np.where(first, END_HASH, np.roll(hashes, 1))
    second = np.roll(first, 1) & ~first
    skip = np.where(first | second, END_HASH, np.roll(hashes, 2))
    contexts = (before, skip, before * np.uint64(0xC2B2AE3D27D4EB4F) + skip)
    cls, slot = group // WIDTH, group % WIDTH
    inner = cls.astype(np.uint64) * np.uint64(0x165667B19E3779F9)
    rows = [[OFFSETS[0][k] + _rows(k, x, ROW_BITS[0][k]) for k, x in enumerate(contexts)], [OFFSETS[1][k] + _rows(8 + k, x ^ inner, ROW_BITS[1][k]) for k, x in enumerate(contexts)]]
    return np.array(rows), cls, slot


def read_texts(model: Words, column) -> tuple[np.ndarray, ...]:
    """Places, groups, hashes and text beginnings of all tokens of an Arrow column of texts, each text's end included.

    Also the number of words of each text, and the lower-cased bytes, starts and ends of the words.
    """
    low, starts, ends, hashes, lengths = column_words(column)
    n = len(lengths)
    at = model.places(hashes)
    rest = np.flatnonzero(at < 0)
    group = model.group[np.maximum(at, 0)] if len(model.group) else np.zeros(len(at), np.int64)
    group[rest] = other_groups(low, starts[rest], ends[rest], hashes[rest])
    last = np.cumsum(lengths) + np.arange(n)
    inside, first = np.ones(len(at) + n, bool), np.zeros(len(at) + n, bool)
    inside[last] = False
    first[last - lengths] = True

    def put(x: np.ndarray, v) -> np.ndarray:
        out = np.full(len(inside), v, x.dtype)
        out[inside] = x
        return out

    return put(at, -1), put(group, END * WIDTH), put(hashes, END_HASH), first, lengths, (low, starts, ends)


def _ends(first: np.ndarray) -> np.ndarray:
    """Which tokens are the end of a text: those before the first of another, and the last."""
    return np.append(first[1:], True)[: len(first)]


def add_tables(blocks: DataFrame, partitions: int) -> DataFrame:
    """block, data: the blocks of all tasks added up; with very many tasks, in two rounds."""

    def add(batches):
        import pyarrow as pa
        import zstandard

        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for at, data in zip(b.column("block").to_pylist(), b.column("data"), strict=True):
                raw = zstandard.decompress(data.as_py())
                own = np.frombuffer(raw, np.int32 if len(raw) == 4 * BLOCK else np.int64).astype(np.int64)
                if at in sums:
                    sums[at] += own
                else:
                    sums[at] = own
        for at, own in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([zstandard.compress(own.tobytes(), 1)], pa.binary())], ["block", "data"])

    schema = "block int, data binary"
    if partitions > 256:
        blocks = blocks.repartition("block", F.spark_partition_id() % 64).select("block", "data").mapInArrow(add, schema)
    return blocks.repartition("block").select("block", "data").mapInArrow(add, schema)


def prepare(counts: np.ndarray, groups: np.ndarray, valid: np.ndarray) -> dict[str, np.ndarray]:
    """The model's arrays: log shares of classes and of slots in a class, log ratios by row (float32) and size bucket of each row.

    ``groups``: training tokens of each class and slot. Slots that hold no word have no share.
    """

    def log_share(n: np.ndarray, ok: np.ndarray) -> np.ndarray:
        own = np.where(ok, n + 1.0, 0.0)
        with np.errstate(divide="ignore"):
            return np.maximum(np.log(own / np.maximum(own.sum(axis=-1, keepdims=True), 1e-300)), -1e30)

    q1, q2 = log_share(groups.sum(axis=1), valid.any(axis=1)), log_share(groups, valid)
    total = counts.sum(axis=1)
    ratio = np.zeros(counts.shape, np.float32)
    cut = OFFSETS[1][0]
    s1 = np.exp(q1)
    ratio[:cut, s1 > 0] = np.log((counts[:cut, s1 > 0] + SMOOTH * s1[s1 > 0]) / s1[s1 > 0])
    # A row of the slot factor belongs to contexts of any class, so its counts are compared with equal shares.
    ratio[cut:] = np.log((counts[cut:] + SMOOTH / WIDTH) * WIDTH)
    ratio -= np.log(total + SMOOTH)[:, None]  # changes no probability, and keeps exponentials small
    return {"q1": q1.astype(np.float32), "q2": q2.astype(np.float32), "ratio": ratio, "size": np.searchsorted(np.array(SIZES), total, side="right").astype(np.int8)}


class Scorer:
    """The model under given weights: the rows' log ratios times their weights, and room for the work on STEP tokens."""

    def __init__(self, model: dict, weights: np.ndarray):
        self.model, kinds = model, len(ROW_BITS[0])
        self.number = np.empty(ROWS, np.int64)  # weight of each row
        self.weight = np.empty(ROWS, np.float32)
        for factor in range(2):
            for k in range(kinds):
                rows = slice(OFFSETS[factor][k], OFFSETS[factor][k] + (1 << ROW_BITS[factor][k]))
                self.number[rows] = k * (len(SIZES) + 1) + model["size"][rows].astype(np.int64)
                self.weight[rows] = weights[factor][self.number[rows]]
        self.table = model["ratio"] * self.weight[:, None]
        self.room = [np.empty((STEP, WIDTH), np.float32) for _ in range(kinds + 2)]

    def step(self, factor: int, rows: np.ndarray, cls: np.ndarray, outcome: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], np.ndarray, np.ndarray]:
        """log probability of the outcomes of at most STEP tokens, weighted features, exponentials, and one over their sums."""
        n = len(outcome)
        f = [x[:n] for x in self.room[: len(rows)]]
        z, q = self.room[-2][:n], self.room[-1][:n]
        for x, r in zip(f, rows, strict=True):
            np.take(self.table, r, axis=0, out=x, mode="clip")
        np.add(f[0], f[1], out=z)
        for x in f[2:]:
            z += x
        if factor == 0:
            z += self.model["q1"]
        else:
            np.take(self.model["q2"], cls, axis=0, out=q, mode="clip")
            z += q
        own = z[np.arange(n), outcome]
        np.exp(z, out=z)
        total = z @ ONES
        return own - np.log(total), f, z, 1 / total


def token_scores(scorer: Scorer, group: np.ndarray, hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Natural log of P(class | h) P(slot | class, h) for every token."""
    rows, cls, slot = table_rows(group, hashes, first)
    out = np.zeros(len(group))
    for i in range(0, len(group), STEP):
        part = slice(i, i + STEP)
        for factor, outcome in enumerate((cls[part], slot[part])):
            out[part] += scorer.step(factor, rows[factor][:, part], cls[part], outcome)[0]
    return out


PARAMETERS = len(ROW_BITS[0]) * (len(SIZES) + 1)


def gradient_sums(scorer: Scorer, group: np.ndarray, hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient of the log likelihood by the weights of both factors, and its curvature as the sum of the tokens' squared gradients."""
    rows, cls, slot = table_rows(group, hashes, first)
    kinds = len(ROW_BITS[0])
    g, h = np.zeros((2, PARAMETERS)), np.zeros((2, PARAMETERS, PARAMETERS))
    for factor, outcome in enumerate((cls, slot)):
        own = np.empty((kinds, len(group)), np.float32)
        for i in range(0, len(group), STEP):
            part = slice(i, i + STEP)
            o = outcome[part]
            _, f, p, scale = scorer.step(factor, rows[factor][:, part], cls[part], o)
            n = np.arange(len(o))
            for k, x in enumerate(f):
                own[k, part] = x[n, o] - np.einsum("to,to->t", p, x) * scale
        own /= scorer.weight[rows[factor]]
        number = scorer.number[rows[factor]]
        for a in range(kinds):
            g[factor] += np.bincount(number[a], own[a], PARAMETERS)
            for b in range(a, kinds):
                cells = np.bincount(number[a] * PARAMETERS + number[b], own[a] * own[b], PARAMETERS**2).reshape(PARAMETERS, PARAMETERS)
                h[factor] += cells if a == b else cells + cells.T
    return g, h


def newton_step(weights: np.ndarray, g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Weights after one bounded step of both factors, with a ridge towards FIRST."""
    out = weights.copy()
    for factor in range(2):
        step = np.linalg.solve(h[factor] + RIDGE * np.eye(PARAMETERS), g[factor] - RIDGE * (weights[factor] - FIRST))
        out[factor] = np.maximum(weights[factor] + np.clip(step, -0.5, 0.5), 0.01)
    return out


def frequent_words(counts: DataFrame, most: int) -> list[tuple[bytes, int]]:
    """All words with a count over the lowest bar that at most ``most`` words reach, by count."""
    words = counts.where("word IS NOT NULL")
    bar, total = None, 0
    for r in words.groupBy("c").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("c")).limit(most).collect():  # one row a count
        total += r["n"]
        if total > most:
            break
        bar = r["c"]
    found = words.where(F.col("c") >= bar).collect() if bar is not None else []
    return sorted(((bytes(r["word"]), r["c"]) for r in found), key=lambda x: (-x[1], x[0]))


def score(df: DataFrame, held_out: Column | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of ``df``.

    A text's tokens are its words (A-Z lower-cased) and one end. A null text is empty and has
    the end alone. Repeated rows are scored, and learnt from, one by one. Without training
    rows nothing is known and base_score is 0. An empty table gives no rows. Other columns
    are not read.
    """
    context = df.sparkSession.sparkContext
    out = fold(F.col("doc_id"), 7) == 2 if held_out is None else held_out
    own = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    learning = own.where(~out)
    counts = materialize(word_counts(learning))
    totals = counts.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v"), F.max(F.when(F.col("word").isNull(), F.col("c"))).alias("end")).first()
    n, v, end = totals["n"] or 0, totals["v"], totals["end"] or 0
    frequent = frequent_words(counts, FREQUENT)  # FREQUENT words at most
    shared = context.broadcast(Words.parts(frequent, end))
    _POWERS.clear()  # not to travel with the functions
    words = lambda: Words(*shared.value)  # noqa: E731  once a task

    def group_totals(batches):
        import pyarrow as pa

        known = words()
        sums, kinds = np.zeros(WIDTH**2, np.int64), np.zeros(WIDTH**2, np.int64)
        for b in batches:
            c = b.column(1).to_numpy()
            is_end = b.column(0).is_null().to_numpy(zero_copy_only=False)
            low, starts, ends, hashes, _ = words_of([w for w in b.column(0).to_pylist() if w is not None])
            at, group = known.places(hashes), other_groups(low, starts, ends, hashes)
            group = np.where((at >= 0) & (at < OWN), at, group)
            np.add.at(sums, group, c[~is_end])
            np.add.at(kinds, group, 1)
            sums[END * WIDTH] += c[is_end].sum()
            kinds[END * WIDTH] += is_end.sum()
        at = np.flatnonzero(kinds)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[at]), pa.array(kinds[at])], ["grp", "n", "v"])

    groups, mass = np.zeros(WIDTH**2), np.zeros(WIDTH**2)
    mass[OWN : END * WIDTH] = 1  # an unknown word
    for r in counts.mapInArrow(group_totals, "grp long, n long, v long").groupBy("grp").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect():  # WIDTH**2 rows at most
        groups[r["grp"]] = r["n"]
        alone = r["grp"] < OWN or r["grp"] == END * WIDTH  # a slot of one word
        mass[r["grp"]] = r["n"] + 1 if alone else r["n"] + r["v"] + 1
    mass[END * WIDTH] = max(mass[END * WIDTH], 1)
    valid, log_mass = (mass > 0).reshape(WIDTH, WIDTH), np.log10(np.maximum(mass, 1))

    def count_cells(batches):
        import pyarrow as pa
        import zstandard

        model, sums = words(), np.zeros(ROWS * WIDTH, np.int32)
        for b in slices(batches, 64):
            _, group, hashes, first, _, _ = read_texts(model, b.column(0))
            rows, cls, slot = table_rows(group, hashes, first)
            for factor, outcome in enumerate((cls, slot)):
                np.add.at(sums, (rows[factor] * WIDTH + outcome).ravel(), np.int32(1))
        for at in range(len(sums) // BLOCK):
            part = sums[at * BLOCK : (at + 1) * BLOCK]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([zstandard.compress(part.tobytes(), 1)], pa.binary())], ["block", "data"])

    def blocks_of(texts: DataFrame) -> list:
        added = add_tables(texts.mapInArrow(count_cells, "block int, data binary"), texts.rdd.getNumPartitions())
        return added.collect()  # compressed counts of ROWS * WIDTH cells, whatever the corpus

    def add_to(table: np.ndarray, blocks: list, sign: int) -> np.ndarray:
        import zstandard

        for r in blocks:
            table.reshape(-1)[r["block"] * BLOCK : (r["block"] + 1) * BLOCK] += sign * np.frombuffer(zstandard.decompress(r["data"]), np.int64)
        return table

    model_of = lambda table: context.broadcast(prepare(table, groups.reshape(WIDTH, WIDTH), valid))

    def gradient(weights: np.ndarray, others):
        def run(batches):
            import pyarrow as pa

            scorer, known = Scorer(others.value, weights), words()
            g, h = np.zeros((2, PARAMETERS)), np.zeros((2, PARAMETERS, PARAMETERS))
            for b in slices(batches, 64):
                _, group, hashes, first, _, _ = read_texts(known, b.column(0))
                dg, dh = gradient_sums(scorer, group, hashes, first)
                g += dg
                h += dh
            flat = np.concatenate((g.ravel(), h.ravel()))
            at = np.flatnonzero(flat)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(flat[at])], ["i", "x"])

        return run

    part = F.pmod(F.xxhash64("doc_id", "text"), F.lit(UPDATES))
    parts = [learning.where(part == k).select("text") for k in range(UPDATES)]
    tables = [blocks_of(x) for x in parts]
    table = np.zeros((ROWS, WIDTH), np.float32)
    for own_blocks in tables:
        add_to(table, own_blocks, 1)
    weights = np.full((2, PARAMETERS), FIRST)
    for own_texts, own_blocks in zip(parts, tables, strict=True):  # every training text takes part in one update
        others = model_of(add_to(table.copy(), own_blocks, -1))
        flat = np.zeros(2 * PARAMETERS * (1 + PARAMETERS))
        for r in own_texts.mapInArrow(gradient(weights, others), "i long, x double").groupBy("i").agg(F.sum("x").alias("x")).collect():  # one row a parameter pair
            flat[r["i"]] = r["x"]
        others.destroy()
        weights = newton_step(weights, flat[: 2 * PARAMETERS].reshape(2, -1), flat[2 * PARAMETERS :].reshape(2, PARAMETERS, PARAMETERS))
    del tables
    prepared = model_of(table)

    def run(batches):
        import pyarrow as pa

        scorer, known = Scorer(prepared.value, weights), words()
        for b in slices(batches, 64):
            at, group, hashes, first, lengths, (low, begin, end_at) = read_texts(known, b.column(1))
            gain = token_scores(scorer, group, hashes, first) / np.log(10) - log_mass[group]
            starts = np.flatnonzero(first)
            logs = np.add.reduceat(np.where(at >= 0, known.log_count[np.maximum(at, 0)] if len(known.log_count) else 0.0, 0.0), starts) if len(starts) else np.zeros(0)
            rest: list[Counter] = [Counter() for _ in lengths]
            raw, others = low.tobytes(), np.flatnonzero(at[~_ends(first)] < 0)
            for i, a, z in zip(np.repeat(np.arange(len(lengths)), lengths)[others].tolist(), begin[others].tolist(), end_at[others].tolist(), strict=True):
                rest[i][raw[a:z]] += 1
            columns = [
                (pa.int64(), lengths + 1), (pa.int64(), (np.add.reduceat((at >= 0).astype(np.int64), starts) if len(starts) else starts) + known.end_known), (pa.float64(), logs + known.log_end),
                (pa.float64(), np.add.reduceat(gain, starts) if len(starts) else np.zeros(0)), (pa.map_(pa.binary(), pa.int64()), [list(c.items()) for c in rest]),
            ]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(x, k) for k, x in columns]], ["doc_id", "n_tokens", "known", "logs", "gain", "rest"])

    scored = own.mapInArrow(run, "doc_id long, n_tokens long, known long, logs double, gain double, rest map<binary,bigint>")
    scored = materialize(scored).withColumn("row", F.monotonically_increasing_id())  # stable: the rows are written
    seldom = counts.where("word IS NOT NULL").select(F.col("word").alias("_w"), "c")
    joined = scored.select("row", F.explode("rest").alias("word", "m")).join(seldom, F.col("word") == F.col("_w"))
    more = joined.groupBy("row").agg(F.sum("m").alias("more"), F.sum(F.col("m") * F.log10(F.col("c") + 1)).alias("more_logs")).withColumnRenamed("row", "_r")
    whole = scored.join(more, F.col("row") == F.col("_r"), "left")
    logs = F.col("logs") + F.coalesce("more_logs", F.lit(0.0))
    return whole.select(
        "doc_id", out.alias("held_out"), "n_tokens", (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (logs - F.col("n_tokens") * F.lit(float(np.log10(n + v + 1)))).alias("base_score"), (logs + F.col("gain")).alias("score"),
    )
