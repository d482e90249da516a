"""Quality scores from a generalised additive model with pairwise interactions.

Texts become ``FEATURES``, counts and ratios of the whole text.  Every feature is cut into bins at
quantiles of the training rows.  Boosting goes round the features in turn: a shallow tree (up to four
leaves) on one feature's histogram of gradients changes that feature's lookup table by a small step.
Pairs of features whose remaining gradients gain most from a cut in both get tables of their own,
boosted the same way with one cut in each.  A score is the logistic of a sum of table entries, found
by bin for a whole batch at once.

Labels are learnt only from rows for which crc32 of the id as text is not divisible by ``FOLDS``, at
most ``MAX_TRAIN`` of them, spread evenly by hash; the bound is a parameter.

Edge cases: null texts are empty and get a score too; labels that are null or not 0/1 are ignored;
without labels of both kinds the score is the smoothed share of label 1; an empty table gives an
empty result; a null id counts as the empty text in the fold rule.
"""

from __future__ import annotations

from itertools import combinations, islice
from operator import eq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coterie.functions.storage import materialize
from coterie.llm.common import small_batches

FOLDS = 5
MAX_TRAIN = 30_000
THRESHOLD = 0.3
FEATURES = (
    "log_words log_bytes word_length upper lower digits symbols bangs pipes stops commas other_punctuation non_ascii "
    "distinct_words repeated_next distinct_pairs top_word dup_lines log_lines line_length long_words short_words "
    "capitalised upper_words ends_plain"
).split()


def features(data: bytes) -> list[float]:
    """The features of one text; all finite, all zero for an empty one."""
    n = len(data)
    words = data.split()
    k = len(words)
    if not k:
        return [0.0] * len(FEATURES)
    h = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    upper, lower, digits = int(h[65:91].sum()), int(h[97:123].sum()), int(h[48:58].sum())
    symbols = int(h[[35, 42, 36, 37, 38, 124, 60, 62]].sum())
    punctuation = int(h[33:48].sum() + h[58:65].sum() + h[91:97].sum() + h[123:127].sum())
    sizes = np.fromiter(map(len, words), np.int64, k)
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    lines = [x for x in data.split(b"\n") if x.strip()]
    marks = int(h[46] + h[63]), int(h[44] + h[59] + h[58])
    letters = max(upper + lower, 1)
    return [
        float(np.log1p(k)), float(np.log1p(n)), float(sizes.mean()), upper / letters, lower / n, digits / n, symbols / n,
        int(h[33]) / k, int(h[124]) / k, marks[0] / k, marks[1] / k,
        (punctuation - symbols - sum(marks) - int(h[33])) / k, int(h[128:].sum()) / n,
        len(counts) / k, sum(map(eq, words, islice(words, 1, None))) / k,
        len(set(zip(words, islice(words, 1, None)))) / max(k - 1, 1), max(counts.values()) / k,
        1 - len(set(lines)) / len(lines), float(np.log1p(len(lines))), k / len(lines),
        float((sizes > 14).mean()), float((sizes < 3).mean()),
        sum(w[:1].isupper() for w in words) / k, sum(map(bytes.isupper, words)) / k, sum(map(bytes.isalnum, words)) / k,
    ]


def _cuts(g: np.ndarray, h: np.ndarray, leaves: int, reg: float) -> np.ndarray:
    """Step of a tree with up to ``leaves`` leaves on one feature's histogram."""
    edges = [0, len(g)]
    cg, ch = np.concatenate(([0.0], np.cumsum(g))), np.concatenate(([0.0], np.cumsum(h)))
    gain = lambda a, b: (cg[b] - cg[a]) ** 2 / (ch[b] - ch[a] + reg)
    for _ in range(leaves - 1):
        best = (1e-9, None)
        for a, b in zip(edges, edges[1:]):
            if b - a > 1:
                m = np.arange(a + 1, b)
                now = gain(a, m) + gain(m, b) - gain(a, b)
                i = int(np.argmax(now))
                if now[i] > best[0]:
                    best = (float(now[i]), int(m[i]))
        if best[1] is None:
            break
        edges = sorted([*edges, best[1]])
    out = np.empty(len(g))
    for a, b in zip(edges, edges[1:]):
        out[a:b] = (cg[b] - cg[a]) / (ch[b] - ch[a] + reg)
    return out


def _quadrants(g: np.ndarray, h: np.ndarray, reg: float) -> tuple[float, np.ndarray]:
    """Gain and step of the best tree with one cut in each of two features."""
    cg, ch = (np.pad(x.cumsum(0).cumsum(1), ((1, 0), (1, 0))) for x in (g, h))
    i, j = np.arange(1, g.shape[0])[:, None], np.arange(1, g.shape[1])[None, :]
    parts = []
    for c in (cg, ch):
        a, left, top = c[i, j], c[i, -1], c[-1, j]
        parts.append((a, left - a, top - a, c[-1, -1] - left - top + a))
    gain = sum(x * x / (y + reg) for x, y in zip(*parts)) - cg[-1, -1] ** 2 / (ch[-1, -1] + reg)
    p, q = np.unravel_index(int(np.argmax(gain)), gain.shape)
    v = [x[p, q] / (y[p, q] + reg) for x, y in zip(*parts)]
    out = np.empty(g.shape)
    out[: p + 1, : q + 1], out[: p + 1, q + 1 :], out[p + 1 :, : q + 1], out[p + 1 :, q + 1 :] = v
    return float(gain[p, q]), out


class AdditiveModel:
    """Lookup tables by feature and by pair of features."""

    def __init__(self, bins: int = 48, coarse: int = 8, rounds: int = 160, pairs: int = 8, rate: float = 0.12, reg: float = 4.0):
        self.bins, self.coarse, self.rounds, self.n_pairs, self.rate, self.reg = bins, coarse, rounds, pairs, rate, reg
        self.edges: list[np.ndarray] = []
        self.tables: list[np.ndarray] = []
        self.pairs: list[tuple[int, int, np.ndarray]] = []
        self.wide: list[np.ndarray] = []
        self.base = 0.0

    @staticmethod
    def _edges(x: np.ndarray, n: int) -> np.ndarray:
        return np.unique(np.quantile(x, np.arange(1, n) / n))

    def fit(self, x: np.ndarray, y: np.ndarray) -> "AdditiveModel":
        share = (y.sum() + 1) / (len(y) + 2)
        self.base = float(np.log(share / (1 - share)))
        if len(np.unique(y)) < 2:
            return self
        d = x.shape[1]
        self.edges = [self._edges(x[:, j], self.bins) for j in range(d)]
        self.wide = [self._edges(x[:, j], self.coarse) for j in range(d)]
        self.tables = [np.zeros(len(e) + 1) for e in self.edges]
        at = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(self.edges)]
        f = np.full(len(y), self.base)
        for _ in range(self.rounds):
            for j in range(d):
                if len(self.tables[j]) > 1:
                    g, h = self._grad(f, y)
                    step = self.rate * _cuts(np.bincount(at[j], g, len(self.tables[j])), np.bincount(at[j], h, len(self.tables[j])), 4, self.reg)
                    self.tables[j] += step
                    f += step[at[j]]
        wide = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(self.wide)]
        shape = lambda a, b: (len(self.wide[a]) + 1, len(self.wide[b]) + 1)
        grid = lambda v, a, b: np.bincount(wide[a] * shape(a, b)[1] + wide[b], v, shape(a, b)[0] * shape(a, b)[1]).reshape(shape(a, b))
        g, h = self._grad(f, y)
        able = [p for p in combinations(range(d), 2) if min(shape(*p)) > 1]
        ranked = sorted(able, key=lambda p: -_quadrants(grid(g, *p), grid(h, *p), self.reg)[0])
        self.pairs = [(a, b, np.zeros(shape(a, b))) for a, b in ranked[: self.n_pairs]]
        for _ in range(self.rounds // 2):
            for a, b, t in self.pairs:
                g, h = self._grad(f, y)
                step = self.rate * _quadrants(grid(g, a, b), grid(h, a, b), self.reg)[1]
                t += step
                f += step[wide[a], wide[b]]
        return self

    @staticmethod
    def _grad(f, y):
        p = 1 / (1 + np.exp(-f))
        return y - p, p * (1 - p)

    def score(self, x: np.ndarray) -> np.ndarray:
        f = np.full(len(x), self.base)
        for j, (e, t) in enumerate(zip(self.edges, self.tables)):
            f += t[np.searchsorted(e, x[:, j], "right")]
        for a, b, t in self.pairs:
            f += t[np.searchsorted(self.wide[a], x[:, a], "right"), np.searchsorted(self.wide[b], x[:, b], "right")]
        return 1 / (1 + np.exp(-f))


def text_features(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``__id, x`` of every document."""
    import pyarrow as pa

    small_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            rows = [features(t or b"") for t in b.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.list_(pa.float64()))], names=["__id", "x"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text).mapInArrow(run, f"__id {kind}, x array<double>")


def fold(id_col: str):
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS))


def fit(rows: DataFrame, labels: DataFrame, id_col: str = "doc_id", label: str = "quality", most: int = MAX_TRAIN) -> AdditiveModel:
    """A model of the features ``rows`` for the labels of the training folds."""
    known = labels.select(F.col(id_col).alias("__l"), F.col(label).cast("int").alias("y")).where("y in (0, 1) and __l is not null")
    known = known.where(fold("__l") != 0)
    share = min(1.0, most / max(1, known.count()))
    some = known.where(F.pmod(F.xxhash64("__l"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1)
    got = rows.join(some, rows["__id"] == some["__l"]).select("__id", "x", "y").orderBy(F.xxhash64("__id"), "__id", "y").limit(most).collect()
    x = np.array([r["x"] for r in got], float).reshape(-1, len(FEATURES))
    return AdditiveModel().fit(x, np.array([r["y"] for r in got], float))


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """``id_col, held_out, score, predicted`` of every document."""
    import pyarrow as pa

    rows = materialize(text_features(docs, id_col, text))
    model = fit(rows, labels, id_col, label)

    def run(batches):
        for b in batches:
            x = np.asarray(b.column(1).flatten(), float).reshape(b.num_rows, -1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score(x))], names=["__id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = rows.mapInArrow(run, f"__id {kind}, score double")
    return out.select(
        F.col("__id").alias(id_col), (fold("__id") == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )


QUERY = "op2_quality_score"


def query(spark, sf_dir: str) -> DataFrame:
    from coterie.llm.common import table

    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
