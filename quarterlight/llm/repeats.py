"""Repeated byte strings, by sampled suffixes and names of their prefixes.

Every start of an L-byte string is tied to a sampled suffix: the place of the smallest
gram hash in the string's first W grams. The sample is a cover in the sense of a
difference cover: whatever the alignment, copies of a string hold the same sampled
place at the same offset. Starts with one sampled place form a zone.

1. Sampled places are named by their gram; a zone whose gram occurs once is done.
2. Zones are named by the bytes of all their strings; zones with one name are copies,
   and all their starts are repeated. One zone stands for all of its name.
3. Zones that differ from their namesakes somewhere are cut into pieces of STEP
   offsets. A piece is named by the bytes that all its strings share, which rules it
   out where they occur once, and by the bytes of all its strings, as in step 2.
4. What is left are single starts, named by their L-byte prefixes; starts with one
   prefix name, adjacent in the order of names, are repeated.

Names are digests, as the question is equality of prefixes, not their lexicographic rank:
64-bit rolling hashes where they only rule out, 128 bits of BLAKE2b over the bytes where
they decide, so no pattern in a text makes two names equal. Counts are summed
before shuffles, so a passage that is everywhere loads no task. Texts travel compressed.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_hot, materialize, slices

LENGTH, GRAM, STEP = 400, 48, 16
#: Starts taken at a time from a very long text; positions within a piece fit 24 bits.
PIECE = 1 << 22
_RANDOM = np.random.default_rng(20240229)
_LETTERS = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64)
_BASE = int(_RANDOM.integers(2**32, 2**63, dtype=np.uint64)) | 1


def _powers(base: int, n: int) -> np.ndarray:
    x = np.full(n, base, np.uint64)
    if n:
        x[0] = 1
    return np.cumprod(x, dtype=np.uint64)


_TABLES: list[np.ndarray] = []


def _tables(n: int) -> list[np.ndarray]:
    """The first ``n`` powers of the base and of its inverse, at least."""
    if not _TABLES or len(_TABLES[0]) < n:
        size = max(n, 1 << 16)
        _TABLES[:] = _powers(_BASE, size), _powers(pow(_BASE, -1, 2**64), size)
    return [t[:n] for t in _TABLES]


class Hasher:
    """64-bit polynomial hashes of any ranges of a byte array, by prefix sums. Unequal hashes tell ranges apart; equal ones decide nothing."""

    def __init__(self, raw: np.ndarray):
        up, self.down = _tables(len(raw) + 1)
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_LETTERS[raw] * up[: len(raw)], dtype=np.uint64)))

    def ranges(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        x = (self.sums[b] - self.sums[a]) * self.down[a] + (b - a).astype(np.uint64)
        return _mixed(x)

    def windows(self, length: int) -> np.ndarray:
        return _mixed((self.sums[length:] - self.sums[:-length]) * self.down[: len(self.sums) - length])


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def digests(raw: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two halves of the 128-bit digests of the byte ranges [a, b)."""
    view, make = memoryview(raw), hashlib.blake2b
    both = np.frombuffer(b"".join([make(view[i:j], digest_size=16).digest() for i, j in zip(a.tolist(), b.tolist(), strict=True)]), "<i8").reshape(-1, 2)
    return both[:, 0], both[:, 1]


def zones(raw: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """first start, last start, sampled place and its gram hash of each zone of one text."""
    n, w = len(raw), length - gram + 1
    if n < length:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    parts = []
    for begin in range(0, n - length + 1, PIECE):
        end = min(begin + PIECE, n - length + 1)  # starts begin..end-1 need bytes begin..end-1+length
        h = Hasher(raw[begin : end - 1 + length]).windows(gram)
        at = (h & ~np.uint64(0xFFFFFF)) | np.arange(len(h), dtype=np.uint64)
        padded = np.full(-(-len(h) // w) * w, np.uint64(2**64 - 1))
        padded[: len(h)] = at
        grid = padded.reshape(-1, w)
        ahead = np.minimum.accumulate(grid, axis=1).ravel()
        behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
        count = end - begin
        least = np.minimum(behind[:count], ahead[w - 1 : w - 1 + count])
        place = (least & np.uint64(0xFFFFFF)).astype(np.int64)
        cuts = np.flatnonzero(np.diff(place)) + 1
        first = np.concatenate(([0], cuts))
        last = np.concatenate((cuts - 1, [count - 1]))
        m = place[first]
        parts.append((first + begin, last + begin, m + begin, h[m]))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))  # type: ignore[return-value]


def _batch(columns: dict):
    import pyarrow as pa

    as_array = lambda v: pa.array(v.view(np.int64)) if isinstance(v, np.ndarray) and v.dtype == np.uint64 else pa.array(v)
    return pa.RecordBatch.from_arrays([as_array(v) for v in columns.values()], list(columns))


def _flat(parts: list, kind=np.int64) -> np.ndarray:
    return np.concatenate(parts) if parts else np.zeros(0, kind)


def repeated_samples(stored: DataFrame, length: int, gram: int) -> DataFrame:
    """_h, _n: hashes of the grams that stand at two or more sampled places of the (key, packed) rows, and their number."""

    def names(batches):
        for b in slices(batches):
            found = [zones(np.frombuffer(unpacked(x.as_py()), np.uint8), length, gram)[3].view(np.int64) for x in b.column(0)]
            h, n = np.unique(_flat(found), return_counts=True)
            yield _batch({"h": h, "n": n})

    counted = stored.select("packed").mapInArrow(names, "h long, n long").groupBy("h").agg(F.sum("n").alias("_n"))
    return materialize(counted.where("_n > 1").select(F.col("h").alias("_h"), "_n"))


def shared_passages(stored: DataFrame, shortest: int = 240, gram: int = 128) -> DataFrame:
    """key, n_passages for the rows that have any: sampled strings of ``gram`` bytes that also start elsewhere.

    Places are sampled so that every passage of ``shortest`` bytes or more that also stands elsewhere holds one at least,
    the same in all its copies; a text without a repeated string of ``gram`` bytes has none.
    """

    def names(batches):
        for b in slices(batches):
            keys, hashes = [], []
            for key, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                h = zones(np.frombuffer(unpacked(data.as_py()), np.uint8), shortest, gram)[3].view(np.int64)
                keys.append(np.full(len(h), key))
                hashes.append(h)
            yield _batch({"key": _flat(keys), "h": _flat(hashes)})

    found = stored.select("key", "packed").mapInArrow(names, "key long, h long")
    hits = join_hot(found, repeated_samples(stored, shortest, gram), {"h": "_h"}, "_n", ["key"])
    return hits.groupBy("key").agg(F.count(F.lit(1)).alias("n_passages"))


def repeated_starts(stored: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """key, ranges (list of first and last repeated start) for the (key, packed) rows that have any; keys are distinct."""

    def find(batches):
        for b in slices(batches):
            out: list[list] = [[] for _ in range(7)]
            for key, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                raw = np.frombuffer(unpacked(data.as_py()), np.uint8)
                first, last, place, h = zones(raw, length, gram)
                if len(first):
                    for column, v in zip(out, (np.full(len(first), key), first, last, place, h.view(np.int64), *digests(raw, first, last + length)), strict=True):
                        column.append(v)
            yield _batch(dict(zip(("key", "lo", "hi", "m", "h", "u1", "u2"), map(_flat, out), strict=True)))

    found = stored.select("key", "packed").mapInArrow(find, "key long, lo long, hi long, m long, h long, u1 long, u2 long")
    often = repeated_samples(stored, length, gram)
    repeated = materialize(join_hot(found, often, {"h": "_h"}, "_n", ["key", "lo"]).drop("_h", "_n"))
    variants = materialize(repeated.groupBy("h", "u1", "u2").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("key", "lo", "hi", "m")).alias("rep")))
    names = variants.where("n > 1").select(F.col("h").alias("_h"), F.col("u1").alias("_u1"), F.col("u2").alias("_u2"), F.col("n").alias("_n"))
    copied = join_hot(repeated, names, {"h": "_h", "u1": "_u1", "u2": "_u2"}, "_n", ["key", "lo"]).select("key", "lo", "hi")
    # Grams of which some zone stands alone beside others: one zone of each variant is looked into.
    # Aggregates are written before they are joined, so that adaptive execution can split a gram of very many variants.
    mixed = materialize(variants.groupBy("h").agg(F.min("n").alias("fewest"), F.count(F.lit(1)).alias("v")).where("fewest = 1 AND v > 1").select("h"))
    chosen = variants.join(mixed, "h").select("rep.*", (F.col("n") == 1).alias("alone"))
    wanted = chosen.groupBy("key").agg(F.collect_list(F.struct("lo", "hi", "m", "alone")).alias("wanted")).withColumnRenamed("key", "_k")

    # Texts of which some zone is looked into, with these zones: one row a text.
    held = materialize(stored.select("key", "packed").join(wanted, F.col("key") == F.col("_k")).select("key", "packed", "wanted"))

    def blocks(lo: np.ndarray, hi: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, ...]:
        """Blocks of STEP offsets before the sampled places: zone and number of each, first and last start, and the bytes that all its strings share."""
        low = (m - hi) // STEP
        count = (m - lo) // STEP - low + 1
        zone = np.repeat(np.arange(len(lo)), count)
        block = np.arange(len(zone)) - np.repeat(np.cumsum(count) - count, count) + low[zone]
        top = m[zone] - block * STEP
        return zone, block, np.maximum(top - STEP + 1, lo[zone]), np.minimum(top, hi[zone]), np.maximum(top, 0), top - STEP + 1 + length

    def core_names(batches):
        for b in slices(batches, 256):
            out: list[list] = [[], []]
            for _, data, zone_list in zip(*_held(b), strict=True):
                lo, hi, m, alone = zone_list
                zone, block, _, _, first, end = blocks(lo, hi, m)
                out[0].append(_mixed(Hasher(data).ranges(first, end) + block.astype(np.uint64)).view(np.int64))
                out[1].append(alone[zone])
            yield _batch({"core": _flat(out[0]), "alone": _flat(out[1], bool)})

    def pieces(batches):
        for b in slices(batches, 256):
            out: list[list] = [[] for _ in range(7)]
            for key, data, zone_list in zip(*_held(b), strict=True):
                lo, hi, m, alone = zone_list
                zone, block, start, end, first, stop = blocks(lo, hi, m)
                c = _mixed(Hasher(data).ranges(first, stop) + block.astype(np.uint64)).view(np.int64)
                for column, v in zip(out, (np.full(len(block), key), start, end, alone[zone], c, *digests(data, start, end + length)), strict=True):
                    column.append(v)
            flat = [_flat(x, bool if i == 3 else np.int64) for i, x in enumerate(out)]
            yield _batch(dict(zip(("key", "lo", "hi", "alone", "core", "u1", "u2"), flat, strict=True)))

    counted = held.mapInArrow(core_names, "core long, alone boolean").groupBy("core").agg(F.count(F.lit(1)).alias("_n"), F.max("alone").alias("_any"))
    cores = materialize(counted.where("_n > 1 AND _any").select(F.col("core").alias("_c")))
    cut = held.mapInArrow(pieces, "key long, lo long, hi long, alone boolean, core long, u1 long, u2 long")
    cut = materialize(cut.join(cores, F.col("core") == F.col("_c")).drop("_c"))
    kinds = cut.groupBy("core", "u1", "u2").agg(F.count(F.lit(1)).alias("n"), F.max("alone").alias("any"), F.min(F.struct("key", "lo", "hi", "alone")).alias("rep"))
    kinds = materialize(kinds)
    same = kinds.where("n > 1 AND any").select(F.col("core").alias("_c"), F.col("u1").alias("_u1"), F.col("u2").alias("_u2"))
    piece_hits = cut.where("alone").join(same, (F.col("core") == F.col("_c")) & (F.col("u1") == F.col("_u1")) & (F.col("u2") == F.col("_u2"))).select("key", "lo", "hi")
    uneven = kinds.groupBy("core").agg(F.min("n").alias("fewest"), F.count(F.lit(1)).alias("v")).where("fewest = 1 AND v > 1").select("core")
    uneven = materialize(uneven)
    open_pieces = kinds.join(uneven, "core").select("rep.key", "rep.lo", "rep.hi", (F.col("rep.alone") & (F.col("n") == 1)).alias("single"))
    by_text = open_pieces.groupBy(F.col("key").alias("_k")).agg(F.collect_list(F.struct("lo", "hi", "single")).alias("open"))
    last = held.join(by_text, F.col("key") == F.col("_k")).select("key", "packed", "open")

    def starts(batches):
        for b in slices(batches, 256):
            out: list[list] = [[] for _ in range(5)]
            for key, data, found_open in zip(*_held(b), strict=True):
                lo, hi, single = found_open
                piece = np.repeat(np.arange(len(lo)), hi - lo + 1)
                at = np.arange(len(piece)) - np.repeat(np.cumsum(hi - lo + 1) - (hi - lo + 1), hi - lo + 1) + lo[piece]
                for column, v in zip(out, (np.full(len(at), key), at, single[piece], *digests(data, at, at + length)), strict=True):
                    column.append(v)
            flat = [_flat(x, bool if i == 2 else np.int64) for i, x in enumerate(out)]
            yield _batch(dict(zip(("key", "start", "single", "x", "y"), flat, strict=True)))

    named = last.mapInArrow(starts, "key long, start long, single boolean, x long, y long")
    equal = named.groupBy("x", "y").agg(F.count(F.lit(1)).alias("_n"), F.max("single").alias("_any")).where("_n > 1 AND _any").select(F.col("x").alias("_x"), F.col("y").alias("_y"))
    start_hits = named.where("single").join(equal, (F.col("x") == F.col("_x")) & (F.col("y") == F.col("_y"))).select("key", F.col("start").alias("lo"), F.col("start").alias("hi"))
    hits = copied.unionByName(piece_hits).unionByName(start_hits)
    return hits.groupBy("key").agg(F.collect_list(F.struct("lo", "hi")).alias("ranges"))


def unpacked(data: bytes | None) -> bytes:
    """UTF-8 bytes of a stored text; a null text has none."""
    import zstandard

    return b"" if data is None else zstandard.decompress(data)


def store(rows: DataFrame) -> DataFrame:
    """Write the rows with a distinct ``key``, and the compressed UTF-8 of ``text`` in ``packed`` instead of it (null stays null).

    Keys number the written rows, so they are the same whenever a task reads them again.
    """

    @F.arrow_udf("binary")
    def pack(texts):
        import pyarrow as pa
        import zstandard

        press = zstandard.ZstdCompressor(level=3)
        return pa.array([press.compress(t.as_buffer()) if t.is_valid else None for t in texts], pa.binary())

    others = [c for c in rows.columns if c != "text"]
    written = materialize(rows.select(*others, pack("text").alias("packed")))
    return written.withColumn("key", F.monotonically_increasing_id())


def _held(batch) -> tuple[list, list, list]:
    """Keys, bytes and the third column's lists of structs (as arrays by field) of a batch of (key, packed, list)."""
    found = batch.column(2)
    fields = [x.to_numpy(zero_copy_only=False) for x in found.flatten().flatten()]
    edges = found.offsets.to_numpy() - found.offsets[0].as_py()
    lists = [[x[a:z] for x in fields] for a, z in zip(edges[:-1], edges[1:], strict=True)]
    return batch.column(0).to_pylist(), [np.frombuffer(unpacked(x.as_py()), np.uint8) for x in batch.column(1)], lists


def removed_spans(ranges: list, length: int) -> list[tuple[int, int]]:
    """Maximal runs of bytes covered by strings of ``length`` that start in the ranges."""
    spans: list[tuple[int, int]] = []
    for lo, hi in sorted(ranges):
        end = hi + length
        if spans and lo <= spans[-1][1]:
            spans[-1] = spans[-1][0], max(end, spans[-1][1])
        else:
            spans.append((lo, end))
    return spans


def cut_spans(raw: bytes, ranges: list, length: int) -> tuple[bytes, int]:
    """What is left of a text, and the number of its removed runs."""
    spans = removed_spans([(r["lo"], r["hi"]) for r in ranges or []], length)
    if not spans:
        return raw, 0
    edges = [0, *[x for s in spans for x in s], len(raw)]
    return b"".join(raw[a:z] for a, z in zip(edges[::2], edges[1::2], strict=True)), len(spans)


def remove_repeats(df: DataFrame, length: int = LENGTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary), n_passages, kept_sha256 for every row of ``df``.

    ``n_passages`` also counts passages under ``length`` bytes, which are not removed: see ``shared_passages``. A null text counts as empty. Texts under ``length`` bytes have no string to repeat.
    Repeated rows are copies of each other. Null ids are kept. An empty table gives no rows.
    Other columns are not read.
    """
    stored = store(df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")))
    ranges = repeated_starts(stored, length, gram).withColumnRenamed("key", "_k")
    passages = shared_passages(stored).withColumnRenamed("key", "_p")
    joined = stored.join(ranges, F.col("key") == F.col("_k"), "left").join(passages, F.col("key") == F.col("_p"), "left")
    joined = joined.select("doc_id", "packed", "ranges", F.coalesce("n_passages", F.lit(0).cast("long")).alias("n_passages"))

    def run(batches):
        import pyarrow as pa

        for b in slices(batches, 256):
            out: list[list] = [[], [], [], []]
            for data, found in zip(b.column(1), b.column(2).to_pylist(), strict=True):
                raw = unpacked(data.as_py())
                kept, n = cut_spans(raw, found, length)
                for column, v in zip(out, (len(raw), len(raw) - len(kept), n, kept), strict=True):
                    column.append(v)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, k) for c, k in zip(out, kinds, strict=True)], b.column(3)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "n_passages"])

    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, n_passages long").withColumn("kept_sha256", F.sha2("kept", 256))


def without_repeats(df: DataFrame, length: int = LENGTH, gram: int = GRAM, text_col: str = "text") -> DataFrame:
    """``df`` with the repeated strings cut out of its texts; every row and column stays, whatever the columns are called.

    Bytes of a character that a cut splits go too. Null texts stay null. Equal rows are separate: what they share is cut from
    each. An empty table gives no rows.
    """
    row = F.struct(*[F.col(f"`{c}`") if c != text_col else F.lit(None).cast("string").alias(c) for c in df.columns])
    stored = store(df.select(row.alias("row"), F.col(text_col).cast("string").alias("text")))
    ranges = repeated_starts(stored, length, gram).withColumnRenamed("key", "_k")
    joined = stored.join(ranges, F.col("key") == F.col("_k"), "left")

    @F.arrow_udf("string")
    def cut(packed, found):
        import pyarrow as pa

        rows = zip(packed, found, strict=True)
        return pa.array([cut_spans(unpacked(t.as_py()), r.as_py(), length)[0].decode("utf-8", "ignore") if t.is_valid else None for t, r in rows], pa.string())

    texts = joined.withColumn("text", cut("packed", "ranges"))
    return texts.select(*[F.col("text").alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in df.columns])
