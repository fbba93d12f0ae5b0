"""Quality classifier: regularised quadratic discriminant over document statistics.

Each text becomes a short vector of transformed statistics. Class means and
covariances come from one distributed aggregate over the training rows; each
covariance is shrunk towards the pooled one and its diagonal, and its Cholesky
factor is computed once and shipped to the tasks. The score is the logistic of
the prior log odds plus the difference of the two Gaussian log densities.
"""

from __future__ import annotations

from operator import eq

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import FUNCTION_WORDS, fold, materialize, slices

# Fixed value: symbol bytes.
SYMBOLS = b"#*$%&|<>"
STATISTICS = (
    "words", "word_length", "upper", "digit", "symbol", "exclamation", "punctuation", "line_length",
    "distinct", "adjacent", "top_word", "dup_lines", "wide", "function_words",
)
KNOWN = frozenset(w.encode() for w in FUNCTION_WORDS)
#: Weights of the pooled covariance and of the diagonal in a class covariance.
POOL, DIAGONAL = 0.10, 0.05
NOISE = 1e-3


def statistics(text: str) -> list[float]:
    """Transformed statistics of one whole text; all are finite, also for an empty text."""
    raw = text.encode("utf-8", "replace")
    tokens = raw.split()
    n = len(tokens)
    if n == 0:
        return [0.0] * len(STATISTICS)
    c = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    size = max(1, len(raw) - int(c[[9, 10, 11, 12, 13, 32]].sum()))
    share = lambda x: float(np.sqrt(x))  # noqa: E731  of rare things, the root spreads small values
    counts: dict[bytes, int] = {}
    for w in tokens:
        counts[w] = counts.get(w, 0) + 1
    lines = [x for x in raw.split(b"\n") if x.strip()]
    punctuation = int(c[33:48].sum() + c[58:65].sum() + c[91:97].sum() + c[123:127].sum())
    return [
        float(np.log1p(n)),
        float(np.log(size / n)),
        share(c[65:91].sum() / size),
        share(c[48:58].sum() / size),
        share(int(c[list(SYMBOLS)].sum()) / n),
        share(c[33] / n),
        share(punctuation / size),
        float(np.log1p(n / max(1, len(lines)))),
        float(np.log(len(counts) / n) + 0.15 * np.log1p(n)),
        share(sum(map(eq, tokens, tokens[1:])) / n),
        share(max(counts.values()) / n),
        share(1 - len(set(lines)) / max(1, len(lines))),
        share(c[128:].sum() / size),
        share(sum(v for k, v in counts.items() if k in KNOWN) / n),
    ]


def statistic_rows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the vector ``x`` of every row."""

    def run(batches):
        import pyarrow as pa

        for b in slices(batches):
            rows = [statistics(t.as_py() or "") for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.list_(pa.float64()))], ["doc_id", "x"])

    own = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return own.mapInArrow(run, "doc_id long, x array<double>")


def class_moments(rows: DataFrame) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """label -> (n, sum of x, sum of x x'): one aggregate with partial sums; the result has two rows."""
    d = len(STATISTICS)
    x = [F.col("x")[i] for i in range(d)]
    upper = [(i, j) for i in range(d) for j in range(i, d)]
    sums = rows.groupBy("label").agg(
        F.count(F.lit(1)).alias("n"),
        F.array(*[F.sum(v) for v in x]).alias("s"),
        F.array(*[F.sum(x[i] * x[j]) for i, j in upper]).alias("ss"),
    )
    out = {}
    for r in sums.collect():
        m = np.zeros((d, d))
        for (i, j), v in zip(upper, r["ss"], strict=True):
            m[i, j] = m[j, i] = v
        out[int(r["label"])] = (float(r["n"]), np.array(r["s"]), m)
    return out


class Discriminant:
    """Two Gaussians with cached inverse Cholesky factors."""

    def __init__(self, moments: dict[int, tuple[float, np.ndarray, np.ndarray]]):
        d = len(STATISTICS)
        self.parts = None
        n = {k: moments[k][0] if k in moments else 0.0 for k in (0, 1)}
        self.prior = float(np.log((n[1] + 1) / (n[0] + 1)))
        if min(n.values()) < 2:
            return
        scatter = {k: moments[k][2] - np.outer(moments[k][1], moments[k][1]) / n[k] for k in (0, 1)}
        pooled = (scatter[0] + scatter[1]) / (n[0] + n[1])
        self.parts = []
        for k in (0, 1):
            own = scatter[k] / n[k]
            cov = (1 - POOL - DIAGONAL) * own + POOL * pooled + DIAGONAL * np.diag(np.diag(own)) + NOISE * np.eye(d)
            factor = np.linalg.cholesky(cov)
            self.parts.append((moments[k][1] / n[k], np.linalg.inv(factor), 2 * float(np.log(np.diag(factor)).sum())))

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.prior)
        if self.parts:
            density = [-0.5 * (((x - mean) @ inverse.T) ** 2).sum(axis=1) - 0.5 * logdet for mean, inverse, logdet in self.parts]
            z = z + density[1] - density[0]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def classify(df: DataFrame, labels: DataFrame, label_col: str = "quality", threshold: float = 0.7, held_out: Column | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``df``.

    Training uses the labelled rows that are not held out, all of them; null labels and
    ids teach nothing, repeated rows count each time. A null text counts as empty and is
    scored like any other. With fewer than two training rows of a class every score is
    the prior. An empty table gives no rows. Columns of ``df`` other than id and text are
    not read.
    """
    out = fold(F.col("doc_id"), 4) == 2 if held_out is None else held_out
    rows = materialize(statistic_rows(df, id_col, text_col))
    marks = labels.select(F.col("doc_id").alias("_id"), F.col(label_col).cast("int").alias("label")).where(F.col("label").isin(0, 1))
    training = rows.where(~out).join(marks, F.col("doc_id") == F.col("_id"))
    model = Discriminant(class_moments(training.select("label", "x")))

    def run(batches):
        import pyarrow as pa

        for b in batches:
            x = np.array(b.column(1).to_pylist(), dtype=float).reshape(len(b), -1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.scores(x) if len(b) else np.zeros(0))], ["doc_id", "score"])

    scored = rows.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
