"""Toxicity: a weighted lexicon matched by Aho-Corasick over folded text.

Folding lower-cases, strips accents and invisible characters, maps homoglyphs and
digit substitutions to letters and turns the rest into spaces. The lexicon (whole
words and word beginnings) and its weights are log odds learnt from a bounded
sample of labelled rows; phrases around a lexicon word that occur in clean rows only
become exceptions and cancel its weight. The weighted sum, alone and per word, goes
through a logistic calibration fitted on the same sample, whose rows weigh as many
labelled rows of their class as they stand for, so the prior is that of all labels.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fold, materialize, slices

# Characters drawn like a Latin letter, and digits and signs used for one.
HOMOGLYPHS = dict(zip("абвгдеёзіїјкмнорстухһԁԛԝѕαβγεηικνορτυχωℓɑɡıʟ", "abbrdeeziijkmhopctyxhdqwsabyenikvoptuxwlagil", strict=True))
SUBSTITUTES = dict(zip("0134578@$€", "oieastbase", strict=True))
#: Bounds of what is learnt, which fit a model and drop no document: labelled rows per class, candidates (the most frequent
#: in toxic rows stay), lexicon entries (those of the highest log odds) and exceptions (the most frequent in clean rows).
SAMPLE, CANDIDATES, ENTRIES, EXCEPTIONS = 40_000, 50_000, 2_000, 2_000
#: A candidate is in this share of toxic sample rows and in so many at least; word beginnings have these lengths.
SHARE, LEAST, PREFIXES = 0.003, 4, (4, 5, 6)
MIN_LOG_ODDS = math.log(12)


def folding_table() -> dict[int, str]:
    """Character -> folded character, from Unicode's decompositions and the two small tables."""
    table: dict[int, str] = {}
    for c in map(chr, range(0x20000)):
        if 0xD800 <= ord(c) < 0xE000:
            continue
        kind = unicodedata.category(c)
        if kind in ("Cf", "Mn", "Cc") and c not in "\t\n\v\f\r":
            table[ord(c)] = ""
        elif kind[0] in "LN" or c in SUBSTITUTES:
            base = unicodedata.normalize("NFKD", c.lower())
            folded = "".join(SUBSTITUTES.get(y := HOMOGLYPHS.get(x, x), y) for x in base if unicodedata.category(x) != "Mn")
            if folded != c:
                table[ord(c)] = folded
        elif c != " ":
            table[ord(c)] = " "
    return table


def folded(text: str, table: dict[int, str]) -> str:
    """Words separated and surrounded by single spaces."""
    return f" {' '.join(text.translate(table).split())} "


@dataclass
class Lexicon:
    """Patterns (each starts at a word boundary) with weights; exceptions weigh against their term."""

    weights: dict[str, float] = field(default_factory=dict)
    exceptions: dict[str, float] = field(default_factory=dict)
    curve: tuple[float, ...] = (0.0, 0.0, 0.0)

    def automaton(self):
        import ahocorasick

        machine = ahocorasick.Automaton()
        for term, w in [*self.weights.items(), *self.exceptions.items()]:
            machine.add_word(term, (term, w))
        machine.make_automaton()
        return machine if len(machine) else None


def features(text: str, machine) -> tuple[float, float]:
    """Root of the weighted sum, and the weighted sum per word (in hundreds), of a folded text."""
    if machine is None:
        return 0.0, 0.0
    total = max(0.0, sum(w for _, (_, w) in machine.iter(text)))
    return math.sqrt(total), math.log1p(100 * total / max(1, text.count(" ") - 1))


def terms_of(text: str) -> set[str]:
    tokens = set(text.split())
    return {f" {w} " for w in tokens if len(w) > 2} | {f" {w[:k]}" for w in tokens for k in PREFIXES if len(w) > k}


def _sample(labels: DataFrame, label_col: str) -> tuple[DataFrame, dict[int, float]]:
    """doc_id, label: at most SAMPLE rows of each class, chosen by hash; small enough to broadcast.

    With it, for each class, the number of held-in labels that one sampled label stands for.
    """
    rows = labels.select(F.col("doc_id").alias("_id"), F.col(label_col).cast("int").alias("label")).where("_id IS NOT NULL")
    rows = rows.where(fold(F.col("_id"), 4) != 2).distinct()
    part = lambda k: rows.where(F.col("label") == k).orderBy(F.xxhash64("_id"), "_id").limit(SAMPLE)
    stands = {r["label"]: max(1.0, r["count"] / SAMPLE) for r in rows.where("label IN (0, 1)").groupBy("label").count().collect()}
    return part(0).unionByName(part(1)), stands


def _count(rows: DataFrame, begin, table: dict[int, str]) -> DataFrame:
    """key, 0, 1: the rows of each label whose folded text yields the key, with sums per task before the shuffle.

    ``begin`` runs once a task and returns the function from a folded text to its keys.
    """

    def run(batches):
        import pyarrow as pa

        sums: Counter = Counter()
        found = begin()
        for b in slices(batches):
            for text, label in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for key in found(folded(text or "", table)):
                    sums[key, label] += 1
            if len(sums) > 500_000:
                yield batch(pa, sums)
                sums.clear()
        yield batch(pa, sums)

    def batch(pa, sums):
        return pa.RecordBatch.from_arrays([pa.array([k for k, _ in sums], pa.string()), pa.array([x for _, x in sums], pa.int32()), pa.array(list(sums.values()), pa.int64())], ["key", "label", "n"])

    return rows.select("text", "label").mapInArrow(run, "key string, label int, n long").groupBy("key").pivot("label", [0, 1]).agg(F.sum("n")).na.fill(0)


def learn(df: DataFrame, labels: DataFrame, label_col: str, table: dict[int, str]) -> Lexicon:
    """Lexicon, exceptions and calibration from the sample; every collected table has a stated bound."""
    chosen, stands = _sample(labels, label_col)
    sample = materialize(df.join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).select("text", "label"))  # read several times
    size = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    n0, n1 = size.get(0, 0), size.get(1, 0)
    if not n0 or not n1:
        return Lexicon(curve=(math.log((n1 * stands.get(1, 1.0) + 0.5) / (n0 * stands.get(0, 1.0) + 0.5)), 0.0, 0.0))
    odds = lambda a, b: math.log((a + 0.5) / (n1 + 1)) - math.log((b + 0.5) / (n0 + 1))  # noqa: E731  toxic a, clean b
    frequent = _count(sample.where("label = 1"), lambda: terms_of, table).where(F.col("1") >= max(LEAST, SHARE * n1))
    seen = {r["key"]: r["1"] for r in frequent.orderBy(F.desc("1"), "key").limit(CANDIDATES).collect()}
    clean = {r["key"]: r["0"] for r in _count(sample.where("label = 0"), lambda: lambda t: terms_of(t) & seen.keys(), table).collect()}
    marked = {k: w for k, a in seen.items() if (w := odds(a, clean.get(k, 0))) >= MIN_LOG_ODDS}
    kept: dict[str, float] = {}
    for term in sorted(marked, key=lambda k: (k.endswith(" "), len(k), k)):  # a beginning stands for the words that have it
        if not any(term[:i] in kept for i in range(2, len(term))):
            kept[term] = marked[term]
    kept = dict(sorted(kept.items(), key=lambda x: (-x[1], x[0]))[:ENTRIES])
    plain = Lexicon(kept)

    def phrases():
        machine = plain.automaton()

        def found(text: str) -> set[str]:
            """The pairs of neighbours of which one is hit by the lexicon."""
            tokens = text.split()
            hit = [machine is not None and any(True for _ in machine.iter(f" {w} ")) for w in tokens]
            return {f" {tokens[i]} {tokens[i + 1]} " for i in range(len(tokens) - 1) if hit[i] or hit[i + 1]}

        return found

    around = _count(sample, phrases, table).where((F.col("0") >= 2) & (F.col("1") * n0 < F.col("0") * n1))
    machine = plain.automaton()
    exceptions = {}
    if machine is not None:
        for r in around.orderBy(F.desc("0"), "key").limit(EXCEPTIONS).collect():
            exceptions[r["key"]] = -sum(w for _, (_, w) in machine.iter(r["key"]))
    lexicon = Lexicon(kept, exceptions)
    lexicon.curve = _calibrate(_features(sample.select(F.lit(0).cast("long").alias("doc_id"), "text", "label"), lexicon, table, "label"), stands)
    return lexicon


def _features(df: DataFrame, lexicon: Lexicon, table: dict[int, str], *more: str) -> DataFrame:
    def run(batches):
        import pyarrow as pa

        machine = lexicon.automaton()
        for b in slices(batches):
            x = [features(folded(t or "", table), machine) for t in b.column(1).to_pylist()]
            own = [b.column(0), pa.array([v[0] for v in x], pa.float64()), pa.array([v[1] for v in x], pa.float64()), *[b.column(2 + i) for i in range(len(more))]]
            yield pa.RecordBatch.from_arrays(own, ["doc_id", "total", "density", *more])

    return df.select("doc_id", "text", *more).mapInArrow(run, "doc_id long, total double, density double" + "".join(f", {c} int" for c in more))


def _calibrate(rows: DataFrame, stands: dict[int, float]) -> tuple[float, ...]:
    """Ridge logistic regression on the two features, from the sample with each row's weight by class.

    Features are rounded to hundredths and counted, so repeated rows bring no more to the driver.
    """
    counts = rows.groupBy(F.round("total", 2).alias("t"), F.round("density", 2).alias("d"), "label").count().orderBy("t", "d", "label")
    data = np.array([tuple(r) for r in counts.collect()], float).reshape(-1, 4)
    x, y = np.column_stack([np.ones(len(data)), data[:, 0], data[:, 1]]), data[:, 2]
    w = np.where(y == 1, stands[1], stands[0]) * data[:, 3]
    beta = np.zeros(3)
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        h = (x * (w * p * (1 - p))[:, None]).T @ x + np.diag([1e-6, 1e-2, 1e-2])
        step = np.linalg.solve(h, x.T @ (w * (y - p)) - np.array([0, 1e-2, 1e-2]) * beta)
        beta = beta + np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-8:
            break
    return tuple(beta)


def score(df: DataFrame, labels: DataFrame, label_col: str = "toxic", threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``df``.

    Null labels and ids teach nothing. A null text counts as empty and gets the score of a
    text without hits. Without training rows of both classes every score is the prior.
    Repeated rows are scored one by one; an empty table gives no rows; columns of ``df``
    other than id and text are not read.
    """
    table = folding_table()
    own = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    lexicon = learn(own, labels, label_col, table)
    a, b, c = lexicon.curve
    out: Column = fold(F.col("doc_id"), 4) == 2
    z = F.lit(float(a)) + F.lit(float(b)) * F.col("total") + F.lit(float(c)) * F.col("density")
    value = 1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(30.0)), F.lit(-30.0))))
    scored = _features(own, lexicon, table).withColumn("score", value)
    return scored.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
