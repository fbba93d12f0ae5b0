"""Phrase collocations by mergeable Misra-Gries summaries and an exact second pass.

1. Blocks: each task turns its texts into blocks of word numbers with a vocabulary, one
   language each. Blocks are written, so both passes read the same ones.
2. First pass: a block's n-grams are hashed and counted, and the counts go, as a summary
   for each of many hash partitions, to the partition's task. There the summaries of all
   blocks are merged into one of a capacity over mass / threshold, so that what it
   has subtracted stays under the threshold and every frequent n-gram survives.
3. Second pass: each block gets back which of its n-grams survived and counts these, and
   its single words, by the words themselves. Sums over blocks are exact; hashes only
   decided what is counted.

A phrase that is everywhere is one entry in a block's summary, so it loads no task; a
partition holds one entry for each block and n-gram whatever the counts are.
"""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, slices

#: Least count, words of the longest phrase, percentage of a phrase's count that makes a longer one replace it, phrases a language.
THRESHOLD, LONGEST, COVER, TOP = 10, 3, 50, 2000
#: Words of a block, bytes of a text that are split into words at a time, n-grams of a hash partition, and hash partitions at least.
BLOCK, SPAN, SHARE, PARTITIONS = 1 << 21, 1 << 22, 1 << 20, 256
#: Shares of a language that are ranked apart before its best are.
SHARES = 32
ENDS = b".,;:!?\n\x0b\x0c\r"
_END = re.compile(rb"[.,;:!?\n\x0b\x0c\r]")
#: A byte that UTF-8 never holds stands for the end of a piece. It is word number 0 of every block.
GAP = b"\xff"
_FOLD = bytes(b + 32 if 65 <= b <= 90 else GAP[0] if b in ENDS else b for b in range(256))
_MIX, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def spans(raw: bytes, size: int = SPAN):
    """A text in parts of about ``size`` bytes that end where a piece ends."""
    a = 0
    while a < len(raw):
        found = _END.search(raw, a + size)
        z = found.end() if found else len(raw)
        yield raw[a:z]
        a = z


def tokens_of(raw: bytes) -> list[bytes]:
    """Lower-cased words in order, with GAP between pieces."""
    return raw.translate(_FOLD).replace(GAP, b" " + GAP + b" ").split()


class Block:
    """Word numbers of texts of one language, and the words."""

    def __init__(self):
        self.words: defaultdict[bytes, int] = defaultdict()
        self.words.default_factory = self.words.__len__  # the next free number
        self.words[GAP]
        self.parts: list[np.ndarray] = []

    def add(self, raw: bytes) -> int:
        tokens = tokens_of(raw)
        tokens.append(GAP)
        self.parts.append(np.fromiter(map(self.words.__getitem__, tokens), np.uint32, len(tokens)))
        return len(tokens)

    def row(self, lang: str, longest: int) -> tuple[str, bytes, bytes, int, int]:
        import zstandard

        press, ids = zstandard.ZstdCompressor(level=3), np.concatenate(self.parts)
        mass = sum(len(at) for _, at in grams(ids, longest))
        return lang, press.compress(b" ".join(self.words)), press.compress(ids.tobytes()), int((ids > 0).sum()), mass


def opened(words: bytes, ids: bytes) -> tuple[list[bytes], np.ndarray]:
    import zstandard

    return zstandard.decompress(words).split(b" "), np.frombuffer(zstandard.decompress(ids), np.uint32).astype(np.int64)


def grams(ids: np.ndarray, longest: int):
    """(n, starts) of the n-grams of each size from 2 on; none holds a gap."""
    word = ids > 0
    alive = word
    for n in range(2, longest + 1):
        alive = alive[:-1] & word[n - 1 :] if len(word) >= n else alive[:0]
        yield n, np.flatnonzero(alive)


def codes(lang: str, words: list[bytes], ids: np.ndarray, longest: int, partitions: int):
    """(n, starts, codes): a code has the n-gram's hash partition in its upper and a 32-bit key in its lower half."""
    import xxhash

    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))[ids]
    now = h ^ np.uint64(xxhash.xxh3_64_intdigest(lang.encode(), 1))
    for n, at in grams(ids, longest):
        now = now[:-1] * _MIX + h[n - 1 :] if len(h) >= n else now[:0]
        now = (now ^ (now >> np.uint64(29))) * _STEP
        now = now ^ (now >> np.uint64(32))
        x = now[at]
        yield n, at, (x & np.uint64(0xFFFFFFFF)) % np.uint64(partitions) << np.uint64(32) | x >> np.uint64(32)


class Summary:
    """Mergeable Misra-Gries summary: counts of at most ``capacity`` keys, each too small by at most ``lost``."""

    def __init__(self, capacity: int):
        self.capacity, self.lost = capacity, 0
        self.keys, self.counts = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        self._more: list[tuple[np.ndarray, np.ndarray]] = []
        self._size = 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        """Merge an exact summary of distinct keys; several are held and merged at once."""
        self._more.append((keys, counts))
        self._size += len(keys)
        if self._size > max(self.capacity, 1 << 16):
            self.settle()

    def settle(self) -> None:
        """Sum what is held and subtract the first count beyond the capacity from all."""
        keys = np.concatenate([self.keys, *[k for k, _ in self._more]])
        counts = np.concatenate([self.counts, *[c for _, c in self._more]])
        self._more, self._size = [], 0
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
        self.keys, self.counts = keys[first], np.add.reduceat(counts, first) if len(first) else counts
        over = len(self.keys) - self.capacity
        if over > 0:
            less = int(np.partition(self.counts, over - 1)[over - 1])
            kept = self.counts > less
            self.keys, self.counts, self.lost = self.keys[kept], self.counts[kept] - less, self.lost + less

    def frequent(self, threshold: int) -> np.ndarray:
        """Sorted keys whose count may be ``threshold`` or more; no other key's is, if the capacity is over mass / threshold."""
        self.settle()
        return self.keys[self.counts + self.lost >= threshold]


def write_blocks(df: DataFrame, text_col: str, lang_col: str, longest: int) -> DataFrame:
    """block, lang, words, ids (both compressed), n, mass: one row a block."""

    def run(batches):
        held, size = defaultdict(Block), 0
        for b in slices(batches, 256):
            for lang, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                for raw in spans(text.as_buffer().to_pybytes()):
                    size += held[lang].add(raw)
                    if size >= BLOCK:
                        yield batch(held)
                        held, size = defaultdict(Block), 0
        if held:
            yield batch(held)

    def batch(held):
        import pyarrow as pa

        kinds = [pa.string(), pa.binary(), pa.binary(), pa.int64(), pa.int64()]
        rows = zip(*[x.row(lang, longest) for lang, x in held.items()], strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds, strict=True)], ["lang", "words", "ids", "n", "mass"])

    own = df.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    written = materialize(own.mapInArrow(run, "lang string, words binary, ids binary, n long, mass long"))
    return written.withColumn("block", F.monotonically_increasing_id())


def summaries(blocks: DataFrame, longest: int, partitions: int) -> DataFrame:
    """p, block, keys, counts: each block's summary for each hash partition. It is exact, as a block has few n-grams of a partition."""

    def run(batches):
        import pyarrow as pa
        import zstandard

        press = zstandard.ZstdCompressor(level=1)
        for b in slices(batches, 1):
            block, lang, *packed = (c[0].as_py() for c in b.columns)
            words, ids = opened(*packed)
            code, count = np.unique(np.concatenate([c for _, _, c in codes(lang, words, ids, longest, partitions)]), return_counts=True)
            p, keys = (code >> np.uint64(32)).astype(np.int64), code.astype(np.uint32)
            edges = np.searchsorted(p, np.arange(partitions + 1))
            cuts = [(i, a, z) for i, (a, z) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)) if z > a]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([i for i, _, _ in cuts], pa.int32()), pa.array(np.full(len(cuts), block)), pa.array([keys[a:z].tobytes() for _, a, z in cuts], pa.binary()),
                    pa.array([press.compress(count[a:z].astype(np.uint32).tobytes()) for _, a, z in cuts], pa.binary()),
                ],
                ["p", "block", "keys", "counts"],
            )

    return blocks.select("block", "lang", "words", "ids").mapInArrow(run, "p int, block long, keys binary, counts binary")


def survivors(parts: DataFrame, threshold: int) -> DataFrame:
    """block, p, keys: for each block and partition, the block's keys that the partition's merged summary keeps."""

    def merge(rows):
        import pyarrow as pa
        import zstandard

        keys = [np.frombuffer(x.as_buffer(), np.uint32) for x in rows["keys"]]
        counts = [np.frombuffer(zstandard.decompress(x.as_buffer()), np.uint32).astype(np.int64) for x in rows["counts"]]
        total = Summary(sum(int(c.sum()) for c in counts) // threshold + 1)
        for k, c in zip(keys, counts, strict=True):
            total.add(k, c)
        alive = total.frequent(threshold)
        hits = [k[np.isin(k, alive, assume_unique=True)].tobytes() for k in keys]
        found = pa.table({"block": rows["block"], "p": rows["p"], "keys": pa.array(hits, pa.binary())})
        return found.filter(pa.array([len(x) > 0 for x in hits], pa.bool_()))

    return parts.groupBy("p").applyInArrow(merge, "block long, p int, keys binary")


def exact_counts(blocks: DataFrame, alive: DataFrame, longest: int, partitions: int) -> DataFrame:
    """lang, size, phrase, a: counts of all words and of the n-grams in ``alive``, by the words themselves."""
    by_block = alive.groupBy(F.col("block").alias("_b")).agg(F.collect_list(F.struct("p", "keys")).alias("alive"))
    joined = blocks.join(by_block, F.col("block") == F.col("_b"), "left").select("lang", "words", "ids", "alive")

    def run(batches):
        import pyarrow as pa

        def batch(lang, n, phrases, counts):
            own = [pa.array([lang] * len(phrases), pa.string()), pa.array(np.full(len(phrases), n, np.int32)), pa.array(phrases, pa.binary()).cast(pa.string()), pa.array(counts.astype(np.int64))]
            return pa.RecordBatch.from_arrays(own, ["lang", "size", "phrase", "a"])

        for b in slices(batches, 1):
            lang, *packed, found = (c[0].as_py() for c in b.columns)
            words, ids = opened(*packed)
            single = np.bincount(ids, minlength=len(words))
            for i in range(1, len(words), 1 << 16):
                yield batch(lang, 1, words[i : i + (1 << 16)], single[i : i + (1 << 16)])
            if not found:
                continue
            wanted = np.sort(np.concatenate([np.frombuffer(x["keys"], np.uint32).astype(np.uint64) | np.uint64(x["p"]) << np.uint64(32) for x in found]))
            for n, at, code in codes(lang, words, ids, longest, partitions):
                at = at[wanted[np.minimum(np.searchsorted(wanted, code), len(wanted) - 1)] == code]
                name = ids[at]
                for j in range(1, n):  # numbers of the phrases of one word more, as small as there are phrases
                    name = np.unique(name, return_inverse=True)[1] * len(words) + ids[at + j]
                _, first, count = np.unique(name, return_index=True, return_counts=True)
                start = at[first]
                for i in range(0, len(start), 1 << 16):
                    own = zip(*[ids[start[i : i + (1 << 16)] + j].tolist() for j in range(n)], strict=True)
                    yield batch(lang, n, [b" ".join(map(words.__getitem__, x)) for x in own], count[i : i + (1 << 16)])

    counted = joined.mapInArrow(run, "lang string, size int, phrase string, a long")
    return counted.groupBy("lang", "size", "phrase").agg(F.sum("a").alias("a"))


def _part(first: int | object, length: object):
    return F.array_join(F.slice("w", first, length), " ")


def collocations(df: DataFrame, threshold: int = THRESHOLD, longest: int = LONGEST, cover: int = COVER, top: int | None = TOP, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the phrases of 2 to ``longest`` words found ``threshold`` times or more, best first.

    Text is lower-cased (A-Z) and cut at ``.,;:!?`` and line ends into pieces, these at spaces
    and tabs into words. A null text is empty; a null language is ``und``. The score is
    floor(1000000 * a * a / (l * r)) of the cut with the lowest (the first of equal ones), in
    decimals that do not overflow. A phrase inside a longer candidate with ``cover`` percent
    of its count goes. Ties stand by count, then by bytes. Repeated rows count as often as they
    stand; an empty table gives no rows; other columns are not read. ``top`` None gives all.
    """
    blocks = write_blocks(df, text_col, lang_col, longest)
    mass = blocks.agg(F.sum("mass")).first()[0] or 0
    partitions = max(PARTITIONS, -(-mass // SHARE))
    # Written, so that adaptive execution can split what the joins below read.
    alive = materialize(survivors(summaries(blocks, longest, partitions), threshold))
    counts = materialize(exact_counts(blocks, alive, longest, partitions).where((F.col("size") == 1) | (F.col("a") >= threshold)))
    found = counts.where("size > 1").withColumn("w", F.split("phrase", " "))
    # Every way to cut a candidate; both parts are words or candidates themselves, since they are no rarer.
    cuts = found.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cuts = cuts.select("lang", "phrase", "size", "a", "k", _part(1, F.col("k")).alias("left"), _part(F.col("k") + 1, F.col("size") - F.col("k")).alias("right"))
    side = lambda name: counts.select(F.col("lang").alias(f"_{name}l"), F.col("phrase").alias(f"_{name}p"), F.col("a").alias(name))
    cuts = cuts.join(side("l"), (F.col("lang") == F.col("_ll")) & (F.col("left") == F.col("_lp"))).drop("_ll", "_lp", "left")
    cuts = cuts.join(side("r"), (F.col("lang") == F.col("_rl")) & (F.col("right") == F.col("_rp"))).drop("_rl", "_rp", "right")
    score = F.expr("(cast(1000000 as decimal(7, 0)) * cast(a as decimal(15, 0)) * cast(a as decimal(15, 0))) div (cast(l as decimal(19, 0)) * cast(r as decimal(19, 0)))")
    scored = cuts.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    # The most that a longer candidate around a phrase counts.
    inner = found.where("size > 2").withColumn("m", F.explode(F.sequence(F.lit(2), F.col("size") - 1)))
    inner = inner.withColumn("i", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("m") + 1)))
    longer = inner.groupBy(F.col("lang").alias("_l"), _part(F.col("i"), F.col("m")).alias("_p")).agg(F.max("a").alias("around"))
    left = scored.join(longer, (F.col("lang") == F.col("_l")) & (F.col("phrase") == F.col("_p")), "left")
    left = left.where(F.col("around").isNull() | (100 * F.col("around") < cover * F.col("a")))
    rows = left.select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("cut.score").alias("score"))
    order = F.desc("score"), F.desc("a"), F.col("phrase")
    if top is not None:  # the best of each share of a language first, so the last window has SHARES * top rows of a language at most
        share = rows.withColumn("share", F.pmod(F.xxhash64("phrase"), F.lit(SHARES)))
        rows = share.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "share").orderBy(*order))).where(F.col("rank") <= top)
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)))
    if top is not None:
        rows = rows.where(F.col("rank") <= top)
    words = blocks.groupBy(F.col("lang").alias("_l")).agg(F.sum("n").alias("n"))
    return rows.join(words, F.col("lang") == F.col("_l")).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


ORACLE = """WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\\x0A-\\x0D]')) AS p FROM d),
w AS (SELECT lang, regexp_extract_all(p, '[^ \\t]+') AS w FROM p),
g AS (SELECT lang, k.n AS size, unnest([array_to_string(w[i : i + k.n - 1], ' ') FOR i IN range(1, len(w) - k.n + 2)]) AS phrase FROM w, (VALUES (1), (2), (3)) k(n) WHERE len(w) >= k.n),
f AS MATERIALIZED (SELECT lang, size, phrase, count(*) AS a FROM g GROUP BY 1, 2, 3),
n AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE size = 1 GROUP BY 1),
c AS (SELECT lang, size, phrase, a, string_split(phrase, ' ') AS w FROM f WHERE size > 1 AND a >= 10),
x AS (SELECT c.lang, c.phrase, c.size, c.a, k.k, array_to_string(w[1 : k.k], ' ') AS lp, array_to_string(w[k.k + 1 :], ' ') AS rp FROM c, (VALUES (1), (2)) k(k) WHERE k.k < c.size),
s AS (SELECT x.lang, x.phrase, x.a, x.k, fl.a AS l, fr.a AS r, ((1000000::HUGEINT * x.a * x.a) // (fl.a::HUGEINT * fr.a))::BIGINT AS score FROM x JOIN f fl ON fl.lang = x.lang AND fl.phrase = x.lp JOIN f fr ON fr.lang = x.lang AND fr.phrase = x.rp),
m AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
o AS (SELECT lang, phrase, max(a) AS around FROM (SELECT lang, array_to_string(w[i : i + 1], ' ') AS phrase, a FROM c, (VALUES (1), (2)) i(i) WHERE size = 3) GROUP BY 1, 2),
q AS (SELECT m.* FROM m LEFT JOIN o ON o.lang = m.lang AND o.phrase = m.phrase WHERE around IS NULL OR 100 * around < 50 * m.a)
SELECT q.lang, row_number() OVER (PARTITION BY q.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM q JOIN n ON n.lang = q.lang QUALIFY rank <= 2000"""
