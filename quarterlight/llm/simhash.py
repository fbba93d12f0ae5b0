"""SimHash near-duplicates by vantage-point trees.

Documents with one fingerprint form a class. Two fingerprints that differ in at most
r of 64 bits differ in at most r // w bits in one of w equal parts, so there is a
vantage-point tree over the values of each part (or, for very many classes, of each pair
of parts). A tree's leaf is a shard: each
fingerprint belongs to one leaf and visits the others that the triangle bound leaves
open, where |d(x, vantage) - radius| is within the part's distance. In a shard the
visitors and members are compared on all 64 bits; a shard over CELL entries is cut
into cells that meet pairwise. A cell returns a spanning forest of its links, never all
pairs, and star contraction joins the forests into components.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, packed_rows, slices, unpacked_rows
from .components import star_components

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
SEED, SHINGLE, RADIUS, PARTS = 42, 4, 4, 4
#: Sampled fingerprints that place vantage points; members a leaf should have; entries of a cell.
SAMPLE, LEAF, CELL = 8192, 800, 8192
#: Levels that one part's 16 bits support, and levels of the deepest trees (their leaves grow beyond LEAF only over 50 million classes).
SINGLE, DEEPEST = 12, 16
#: A class with over 1 in HOT of all rows (so at most HOT classes) is joined by broadcast.
HOT = 1024


def fingerprint(text: str) -> int:
    """64-bit SimHash of the 4-word shingles of a whole text; 0 without words."""
    import xxhash

    h = xxhash.xxh64_intdigest
    tokens = text.encode("utf-8").translate(LOWER).split()
    n = len(tokens)
    if n == 0:
        return 0
    joined = b" ".join(tokens)
    if n <= SHINGLE:
        return h(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    first, last = starts[: n - SHINGLE + 1].tolist(), ends[SHINGLE - 1 :].tolist()
    counts = np.zeros(64, np.int64)
    for i in range(0, len(first), 65536):
        hashes = np.array([h(joined[a:b], SEED) for a, b in zip(first[i : i + 65536], last[i : i + 65536], strict=True)], "<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * counts > len(first)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, id_col: str, text_col: str, *more: str) -> DataFrame:
    def run(batches):
        import pyarrow as pa

        for b in slices(batches):
            own = np.array([fingerprint(t.as_py() or "") for t in b.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(own, pa.int64()), *[b.column(2 + i) for i in range(len(more))]], ["doc_id", "fp", *more])

    own = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *more)
    return own.mapInArrow(run, "doc_id long, fp long" + "".join(f", {c} long" for c in more))


class VantageTree:
    """A vantage-point tree whose level i looks at part ``levels[i]`` of the fingerprints: vantage points and radii by node."""

    def __init__(self, sample: np.ndarray, levels: list[int], bits: int):
        self.levels, self.bits, self.mask = levels, bits, np.uint64((1 << bits) - 1)
        size = 2 ** len(levels) - 1
        self.vantage, self.radius = np.zeros(size, np.uint64), np.zeros(size, np.int64)
        groups = {0: np.sort(sample)}
        for node in range(size):
            own = groups.pop(node)
            values = self._part(own, (node + 1).bit_length() - 1)
            if len(own):
                # Of a few evenly spaced candidates, the one whose median splits best.
                best = None
                for p in values[np.linspace(0, len(own) - 1, min(9, len(own))).astype(int)]:
                    d = np.bitwise_count(values ^ p).astype(np.int64)
                    r = int(np.median(d))
                    r = min((r - 1, r, r + 1), key=lambda x: (abs(int((d <= x).sum()) - len(own) / 2), x))  # noqa: B023
                    off = abs(int((d <= r).sum()) - len(own) / 2)
                    if best is None or off < best[0]:
                        best = off, p, r, d
                _, self.vantage[node], self.radius[node], d = best
                inside = d <= self.radius[node]
                groups[2 * node + 1], groups[2 * node + 2] = own[inside], own[~inside]
            else:
                self.radius[node] = bits // 2
                groups[2 * node + 1] = groups[2 * node + 2] = own

    def _part(self, fp: np.ndarray, level: int) -> np.ndarray:
        return (fp >> np.uint64(self.bits * self.levels[level])) & self.mask

    def route(self, fp: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index, leaf, member) of each fingerprint's own leaf and of the leaves that may hold others within ``reach`` on every part of the tree.

        Two members that part at a node meet once: the inner one also goes outside.
        A visitor goes wherever the triangle bound lets a partner be.
        """
        index, node, member = np.arange(len(fp)), np.zeros(len(fp), np.int64), np.ones(len(fp), bool)
        for level in range(len(self.levels)):
            d = np.bitwise_count(self._part(fp, level)[index] ^ self.vantage[node]).astype(np.int64)
            r = self.radius[node]
            inside = d <= r
            cross_out = inside & (d > r - reach)
            cross_in = ~inside & (d <= r + reach) & ~member
            also = cross_out | cross_in
            home = 2 * node + 1 + ~inside
            other = 2 * node[also] + 1 + inside[also]
            index = np.concatenate((index, index[also]))
            node = np.concatenate((home, other))
            member = np.concatenate((member, np.zeros(int(also.sum()), bool)))
        return index, node - (2 ** len(self.levels) - 1), member


def tree_levels(depth: int, radius: int = RADIUS, parts: int = PARTS) -> list[list[int]]:
    """The parts that each tree looks at, level by level.

    Up to SINGLE levels, one tree a part: some part of a link has at most radius // parts
    differing bits. One part's values tell no more leaves apart; beyond, one tree for each
    pair of parts. With four parts and a radius under six, two parts of a link have at most one
    differing bit each, since three with two or more would make six.
    """
    if depth <= SINGLE or (parts, radius // parts) != (4, 1) or radius > 5:
        return [[p] * min(depth, SINGLE) for p in range(parts)]
    first = depth // 2
    return [[p] * first + [q] * (depth - first) for p in range(parts) for q in range(p + 1, parts)]


def linked(members: np.ndarray, others: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links within ``radius`` bits between members, and of members with others."""
    members, others = np.unique(members), np.unique(others)
    pool, hit_member, hit_other = np.concatenate((members, others)), np.zeros(len(members), bool), []
    for i in range(0, len(pool), 256):
        part = pool[i : i + 256]
        near = np.bitwise_count(part[:, None] ^ members[None, :]) <= radius
        alone = np.arange(i, i + len(part)) < len(members)
        hits = near.sum(axis=1) - alone
        rows = hits > 0
        hit_other.append(rows)
        if rows.any():
            hit_member |= near[rows].any(axis=0)
    flags = np.concatenate(hit_other) if hit_other else np.zeros(0, bool)
    flags[: len(members)] |= hit_member
    left = pool[flags]
    out: list[tuple[int, int]] = []
    while len(left):  # breadth-first: each node is compared with those not reached yet
        root, frontier, left = left[0], [left[0]], left[1:]
        while frontier and len(left):
            at = frontier.pop()
            near = np.bitwise_count(left ^ at) <= radius
            if near.any():
                found = left[near]
                out.extend((int(root), int(x)) for x in found)
                frontier.extend(found)
                left = left[~near]
    return out


def links(classes: DataFrame, radius: int = RADIUS, parts: int = PARTS) -> DataFrame:
    """a, b: links whose components are those of all pairs of ``classes.fp`` within ``radius`` bits."""
    n = classes.count()
    depth = max(0, min(DEEPEST, int(np.ceil(np.log2(max(1, n / LEAF))))))
    size = max(SAMPLE, 4 << depth)  # 8 * size bytes, 2 MB at most
    sample = np.array([r["fp"] for r in classes.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(size).collect()], np.int64).view(np.uint64)
    trees = [VantageTree(sample, levels, 64 // parts) for levels in tree_levels(depth, radius, parts)]

    def route(batches):
        import pyarrow as pa

        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False)
            for p, tree in enumerate(trees):
                index, leaf, member = tree.route(fp.view(np.uint64), radius // parts)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(index), p, np.int32)), pa.array(leaf.astype(np.int32)), pa.array(member), pa.array(fp[index])], ["part", "leaf", "member", "fp"])

    routed = classes.select("fp").mapInArrow(route, "part int, leaf int, member boolean, fp long")
    # Cells: members cut by hash into m parts, everything that came to the leaf into q parts.
    sizes = materialize(routed.groupBy("part", "leaf").agg(
        F.ceil(F.sum(F.col("member").cast("int")) / CELL).cast("int").alias("m"), F.ceil(F.count(F.lit(1)) / CELL).cast("int").alias("q")
    ).where("m > 0"))  # one row a leaf
    entries = routed.join(sizes, ["part", "leaf"])
    cut = lambda k: F.pmod(F.xxhash64("fp"), F.col(k)).cast("int")
    steps = lambda k: F.explode(F.sequence(F.lit(0), F.col(k) - 1))
    came = entries.select("part", "leaf", steps("m").alias("i"), cut("q").alias("j"), F.lit(False).alias("member"), "fp")
    at_home = entries.where("member").select("part", "leaf", cut("m").alias("i"), steps("q").alias("j"), F.lit(True).alias("member"), "fp")

    def cell(rows):
        import pyarrow as pa

        fp, own = rows["fp"].to_numpy().view(np.uint64), rows["member"].to_numpy(zero_copy_only=False)
        members = np.unique(fp[own])
        found = linked(members, np.setdiff1d(fp[~own], members), radius)
        pairs = np.array(found, np.uint64).reshape(-1, 2).view(np.int64)
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})

    return came.unionByName(at_home).groupBy("part", "leaf", "i", "j").applyInArrow(cell, "a long, b long")


def _placed(classes: DataFrame, radius: int) -> DataFrame:
    """``classes`` with the root (a fingerprint) of each one's component."""
    roots = star_components(links(classes, radius)).withColumnRenamed("node", "_n")
    return materialize(classes.join(roots, F.col("fp") == F.col("_n"), "left").withColumn("root", F.coalesce("root", "fp")))


def near_duplicates(df: DataFrame, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint, component_id for every row of ``df``.

    Null, empty and blank texts have fingerprint zero and link like any other. The
    component is named by its smallest id; null ids count only if there is no other (then
    null). Repeated rows are in one class. An empty table gives no rows. Other columns are
    not read.
    """
    rows = materialize(fingerprints(df, id_col, text_col))
    classes = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")))
    placed = _placed(classes, radius)
    # Written, so that adaptive execution can split a component of very many classes in the join.
    named = materialize(placed.groupBy("root").agg(F.min("first").alias("component_id")))
    classes = materialize(placed.join(named, "root").select(F.col("fp").alias("_fp"), "n", "component_id"))
    total = rows.count()
    hot = F.broadcast(classes.where(F.col("n") * HOT > total))  # fewer than HOT rows
    often = rows.join(hot, F.col("fp") == F.col("_fp"))
    seldom = rows.join(hot, F.col("fp") == F.col("_fp"), "left_anti").join(classes.where(F.col("n") * HOT <= total), F.col("fp") == F.col("_fp"))
    return often.unionByName(seldom).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(df: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One row of each component of ``df``, with its own columns: that of the smallest id, null last.

    A row is known by its id and a digest of all its columns, so null ids and ids with
    several texts are rows like any other and reruns agree. Equal rows are one. The
    caller's columns may have any names.
    """
    everything = [F.col(f"`{c}`") for c in df.columns]
    nulls = [c.isNull() for c in everything]
    id_ = F.col("doc_id").cast("long")
    keyed = packed_rows(df, doc_id=id_, text=F.col("text"), none=id_.isNull(), id=F.coalesce(id_, F.lit(0).cast("long")), h1=F.xxhash64(F.lit(1), *everything, *nulls), h2=F.xxhash64(F.lit(2), *everything, *nulls))
    key = ["none", "id", "h1", "h2"]
    rows = materialize(fingerprints(keyed, "doc_id", "text", "h1", "h2"))
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0).cast("long")).alias("id"), "h1", "h2")
    classes = materialize(rows.groupBy("fp").agg(F.min(order).alias("first")))
    kept = _placed(classes, radius).groupBy("root").agg(F.min("first").alias("first")).select("first.*")
    return unpacked_rows(keyed.join(kept, key, "left_semi").dropDuplicates(key), df.columns)
