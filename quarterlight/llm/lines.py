"""Line de-duplication by sharded minimal perfect hashes.

1. Each task reads its texts in chunks. A chunk keeps which lines its documents have, as
   numbers of its distinct lines, and sends each shard the 128-bit hashes of the lines
   that fall to it, with their number of documents and largest id.
2. A shard sums the chunks' entries and builds a minimal perfect hash over the distinct
   lines of LEAST or more documents; it indexes arrays of fingerprints, counts and keepers.
   The chunks' hashes probe these arrays; a fingerprint of 64 bits tells strangers apart.
3. What a chunk's lines were found to be returns to the chunk, which names the lines that
   its documents lose. Documents meet these lists, not lines.

A line that stands everywhere is one entry a chunk, so it loads no task.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, slices

#: Code points of the shortest key that counts, and documents that make it repeated.
SHORTEST, LEAST = 20, 3
#: Lines of a chunk that are counted together, bytes of text a shard, and shards at least.
CHUNK, SHARD_BYTES, SHARDS = 1 << 18, 1 << 26, 256
BLANKS = b" \t\n\x0b\x0c\r"
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: The id of a document without one: below all others.
NO_ID = -(2**63)
#: Places a key in each level of a hash, and levels at most.
ROOM, LEVELS = 1.6, 64


def line_keys(raw: bytes, shortest: int = SHORTEST) -> list[tuple[int, bytes]]:
    """(line number, key) of the lines whose stripped, lower-cased text has ``shortest`` code points or more."""
    out = []
    for i, line in enumerate(raw.translate(_LOWER).split(b"\n")):
        key = line.strip(BLANKS)
        if len(key) >= 4 * shortest or len(key) >= shortest and len(key.decode("utf-8", "replace")) >= shortest:
            out.append((i, key))
    return out


def _spread(h: np.ndarray, fp: np.ndarray, level: int) -> np.ndarray:
    x = h + fp * np.uint64(2 * level + 1)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


class PerfectHash:
    """A minimal perfect hash over distinct pairs (h, fp): each level's bitmap marks the places that one key alone takes; the others go on to the next level."""

    def __init__(self, h: np.ndarray, fp: np.ndarray):
        self.bits: list[np.ndarray] = []
        while len(h):
            if len(self.bits) == LEVELS:
                raise ValueError("keys are not distinct")
            size = max(64, int(ROOM * len(h)))
            at = (_spread(h, fp, len(self.bits)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            self.bits.append(alone)
            left = ~alone[at]
            h, fp = h[left], fp[left]
        self.ranks = np.cumsum(np.concatenate([[0], *[b.astype(np.int64) for b in self.bits]]))
        self.starts = np.cumsum([0, *[len(b) for b in self.bits]])

    def __len__(self) -> int:
        return int(self.ranks[-1])

    def slots(self, h: np.ndarray, fp: np.ndarray) -> np.ndarray:
        """The number of each key, from 0 without gaps; some number or -1 for pairs that are not keys."""
        out, left = np.full(len(h), -1), np.arange(len(h))
        for level, bits in enumerate(self.bits):
            at = (_spread(h[left], fp[left], level) % np.uint64(len(bits))).astype(np.int64)
            hit = bits[at]
            out[left[hit]] = self.ranks[self.starts[level] + at[hit]]
            left = left[~hit]
        return out


class LineIndex:
    """Fingerprints, document counts and keepers (largest ids) of repeated lines, by their perfect hash."""

    def __init__(self, h: np.ndarray, fp: np.ndarray, docs: np.ndarray, top: np.ndarray, least: int):
        order = np.lexsort((fp, h))
        h, fp, docs, top = h[order], fp[order], docs[order], top[order]
        first = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (fp[1:] != fp[:-1])))) if len(h) else np.zeros(0, np.int64)
        if len(first):
            h, fp, docs, top = h[first], fp[first], np.add.reduceat(docs, first), np.maximum.reduceat(top, first)
        often = docs >= least
        h, fp, docs, top = h[often], fp[often], docs[often], top[often]
        self.hash = PerfectHash(h, fp)
        slot = self.hash.slots(h, fp)
        self.fingerprints, self.counts, self.keepers = np.zeros(len(h), np.uint64), np.zeros(len(h), np.int64), np.zeros(len(h), np.int64)
        self.fingerprints[slot], self.counts[slot], self.keepers[slot] = fp, docs, top

    def probe(self, h: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places in ``h`` of the repeated lines, their keepers)."""
        slot = self.hash.slots(h, fp)
        hit = np.flatnonzero(slot >= 0)
        hit = hit[self.fingerprints[slot[hit]] == fp[hit]]
        return hit, self.keepers[slot[hit]]


def read_lines(own: DataFrame, shards: int, shortest: int) -> DataFrame:
    """chunk rows: for ``shard`` null the chunk's documents and their lines, else what a shard gets of the chunk.

    documents: a, b (digests), id, m (number of keys); lines: at (line number), line (number in the chunk).
    shard: line, h, fp, docs, top.
    """

    def run(batches):
        import xxhash

        digest = xxhash.xxh3_128_digest
        docs, numbers, hashes, where, seen = [], {}, [], [], []
        for b in slices(batches, 256):
            for a, c, i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3), strict=True):
                keys = line_keys(text.as_buffer().to_pybytes(), shortest) if text.is_valid else []
                if not keys:
                    continue
                i = NO_ID if i is None else i
                docs.append((a, c, i, len(keys)))
                mine = set()
                for at, key in keys:
                    d = digest(key)
                    n = numbers.setdefault(d, len(numbers))
                    if n == len(hashes):
                        hashes.append(d)
                        seen.append([0, NO_ID])
                    where.append((at, n))
                    mine.add(n)
                for n in mine:
                    seen[n][0] += 1
                    seen[n][1] = max(seen[n][1], i)
                if len(where) >= CHUNK:
                    yield batch(docs, hashes, where, seen)
                    docs, numbers, hashes, where, seen = [], {}, [], [], []
        if docs:
            yield batch(docs, hashes, where, seen)

    def batch(docs, hashes, where, seen):
        import pyarrow as pa
        import xxhash
        import zstandard

        press = zstandard.ZstdCompressor(level=1)
        both, counted = np.frombuffer(b"".join(hashes), "<u8").reshape(-1, 2), np.array(seen, np.int64)
        own, places = np.array(docs, np.int64), np.array(where, np.int32)
        shard = (both[:, 0] >> np.uint64(32)) % np.uint64(shards)
        order = np.argsort(shard, kind="stable")
        rows = [(None, own.tobytes(), press.compress(places.T.tobytes()), None, None)]
        for part in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1):
            rows.append((int(shard[part[0]]), None, part.astype(np.int32).tobytes(), both[part].tobytes(), press.compress(counted[part].tobytes())))
        kinds = [pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
        # A chunk is named by its content, so a task that runs again gives the same rows. Equal chunks have equal verdicts.
        name = xxhash.xxh3_64_intdigest(own.tobytes() + places.tobytes() + both.tobytes())
        chunk = pa.array(np.full(len(rows), name, np.uint64).view(np.int64))
        return pa.RecordBatch.from_arrays([chunk, *[pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]], ["chunk", "shard", "docs", "lines", "hashes", "seen"])

    return own.mapInArrow(run, "chunk long, shard int, docs binary, lines binary, hashes binary, seen binary")


def decide(rows: DataFrame, least: int) -> DataFrame:
    """chunk, lines, keepers: the chunk's lines that are repeated, from the shards' arrays."""

    def probe(table):
        import pyarrow as pa
        import zstandard

        lines = [np.frombuffer(x.as_buffer(), np.int32) for x in table["lines"]]
        both = [np.frombuffer(x.as_buffer(), "<u8").reshape(-1, 2) for x in table["hashes"]]
        seen = np.concatenate([np.frombuffer(zstandard.decompress(x.as_buffer()), np.int64).reshape(-1, 2) for x in table["seen"]])
        flat = np.concatenate(both)
        index = LineIndex(flat[:, 0], flat[:, 1], seen[:, 0], seen[:, 1], least)
        found = [(line[hit].tobytes(), keepers.tobytes()) for line, x in zip(lines, both, strict=True) for hit, keepers in (index.probe(x[:, 0], x[:, 1]),)]
        out = pa.table({"chunk": table["chunk"], "lines": pa.array([x for x, _ in found], pa.binary()), "keepers": pa.array([x for _, x in found], pa.binary())})
        return out.filter(pa.array([len(x) > 0 for x, _ in found], pa.bool_()))

    return rows.where("shard IS NOT NULL").groupBy("shard").applyInArrow(probe, "chunk long, lines binary, keepers binary")


def dropped_lines(rows: DataFrame, verdicts: DataFrame) -> DataFrame:
    """_a, _b, gone (line numbers): for each document that loses lines."""
    by_chunk = verdicts.groupBy(F.col("chunk").alias("_c")).agg(F.collect_list(F.struct("lines", "keepers")).alias("found"))
    joined = rows.where("shard IS NULL").join(by_chunk, F.col("chunk") == F.col("_c")).select("docs", "lines", "found")

    def run(batches):
        import pyarrow as pa
        import zstandard

        for b in slices(batches, 1):
            docs = np.frombuffer(b.column(0)[0].as_buffer(), np.int64).reshape(-1, 4)
            at, line = np.frombuffer(zstandard.decompress(b.column(1)[0].as_buffer()), np.int32).reshape(2, -1)
            keeper = np.full(int(line.max()) + 1, NO_ID)
            for x in b.column(2)[0].as_py():
                keeper[np.frombuffer(x["lines"], np.int32)] = np.frombuffer(x["keepers"], np.int64)
            # Lines that are not repeated, or that only documents without an id hold, have no keeper.
            doc = np.repeat(np.arange(len(docs)), docs[:, 3])
            gone = np.flatnonzero((keeper[line] != NO_ID) & (keeper[line] != docs[doc, 2]))
            who, first = np.unique(doc[gone], return_index=True)
            yield pa.RecordBatch.from_arrays([pa.array(docs[who, 0]), pa.array(docs[who, 1]), pa.array([x.tobytes() for x in np.split(at[gone], first[1:])] if len(who) else [], pa.binary())], ["_a", "_b", "gone"])

    return joined.mapInArrow(run, "_a long, _b long, gone binary").dropDuplicates(["_a", "_b"])


def drop_lines(df: DataFrame, shortest: int = SHORTEST, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_lines, n_dropped, kept (the text that is left), kept_sha256 for every row of ``df``.

    A line's key is the line without blanks at its ends, A-Z lower-cased. Keys of ``shortest``
    code points or more in ``least`` documents (rows) or more lose all their lines but those of the largest id
    that holds them; rows that share this id all keep them, and where no holder has an id, all do. A null id
    is below every other. A null or empty text is one empty line. Equal rows are separate documents
    with one result. An empty table gives no rows; other columns are not read.
    """
    own = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    key = [F.xxhash64(F.lit(k), "doc_id", F.col("doc_id").isNull(), "text").alias(name) for k, name in enumerate("ab")]
    own = own.select(*key, "doc_id", "text")
    size = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    rows = materialize(read_lines(own, max(SHARDS, -(-size // SHARD_BYTES)), shortest))
    gone = materialize(dropped_lines(rows, materialize(decide(rows, least))))
    joined = own.join(gone, (F.col("a") == F.col("_a")) & (F.col("b") == F.col("_b")), "left").select("doc_id", "text", "gone")

    def cut(batches):
        import pyarrow as pa

        for b in slices(batches, 256):
            out: list[list] = [[], [], []]
            for text, lost in zip(b.column(1), b.column(2), strict=True):
                lines = (text.as_buffer().to_pybytes() if text.is_valid else b"").split(b"\n")
                n = len(lines)
                if lost.is_valid:
                    for i in np.frombuffer(lost.as_buffer(), np.int32)[::-1]:
                        lines[i] = None
                    lines = [x for x in lines if x is not None]
                for column, v in zip(out, (n, n - len(lines), b"\n".join(lines)), strict=True):
                    column.append(v)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary()).cast(pa.string())], ["doc_id", "n_lines", "n_dropped", "kept"])

    return joined.mapInArrow(cut, "doc_id long, n_lines long, n_dropped long, kept string").withColumn("kept_sha256", F.sha2(F.col("kept").cast("binary"), 256))


ORACLE = """WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
e AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS i FROM d),
k AS (SELECT doc_id, i, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM e),
r AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20 GROUP BY 1 HAVING count(DISTINCT doc_id) >= 3),
x AS (SELECT k.doc_id, k.i, k.line, coalesce(r.keeper <> k.doc_id, FALSE) AS gone FROM k LEFT JOIN r ON r.key = k.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM x GROUP BY 1"""
