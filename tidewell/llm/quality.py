"""Quality classifier: a sparse ensemble of rules over text statistics.

Shallow boosted trees are grown on statistics of labelled texts; every path from a root is a
conjunctive rule. A lasso logistic regression over the rules keeps few of them, and the kept
rules are compiled into one Spark SQL expression over the statistics, which scores all rows
inside generated code.

The trees and weights are fitted on at most about ``MAX_TRAIN`` labelled rows, chosen by a
hash of doc_id. Statistics cover whole texts. Null and empty texts have statistics of zero and
are scored like any other; with no labelled row every score is 0.5. Rows that share a doc_id
are scored row by row, also those without an id; conflicting labels of one doc_id count as the smaller. Extra columns
are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WINDOW, documents, pieces, text_buffer, word_hashes, words_of, written
from .langid import held_out

MAX_TRAIN = 20_000
TREES = 40
DEPTH = 3
BINS = 32
LASSO = 0.002
THRESHOLD = 0.7
#: Byte classes whose shares are statistics.
CLASSES = {"lower": b"abcdefghijklmnopqrstuvwxyz", "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "blank": b" \t", "line": b"\n\r", "stop": b".?", "comma": b",;:", "bang": b"!", "bar": b"|", "symbol": b"#$%&*+<=>@\\^_~/", "bracket": b"()[]{}\"'`-"}
_CLASS = np.full(256, len(CLASSES), np.int64)
for _i, _bytes in enumerate(CLASSES.values()):
    _CLASS[list(_bytes)] = _i
NAMES = [*(f"share_{x}" for x in CLASSES), "share_other", "log_bytes", "log_words", "word_bytes", "word_spread", "unique_words", "top_word", "echo", "unique_pairs", "unique_lines", "words_a_line", "words_a_stop"]
STATISTICS = T.StructType([T.StructField("doc_id", T.LongType()), *(T.StructField(x, T.DoubleType()) for x in NAMES)])


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of NAMES for each text."""
    n, kinds = len(offsets) - 1, len(CLASSES) + 1
    out = np.zeros((n, len(NAMES)))
    sizes = np.diff(offsets)
    shares = np.zeros(n * kinds, np.int64)
    for lo in range(0, len(data), WINDOW):
        inside = np.clip(offsets, lo, lo + WINDOW)
        row = np.repeat(np.arange(n), np.diff(inside))
        shares += np.bincount(row * kinds + _CLASS[data[lo : lo + WINDOW]], minlength=n * kinds)
    shares = shares.reshape(n, kinds)
    out[:, :kinds] = shares / np.maximum(sizes, 1)[:, None]
    starts, ends, first = words_of(data, offsets)
    hashes, lengths = word_hashes(data, starts), ends - starts
    words = np.diff(first)
    out[:, kinds], out[:, kinds + 1] = np.log1p(sizes), np.log1p(words)
    breaks = np.flatnonzero(data == 10)
    for i in np.flatnonzero(words):
        h, size = hashes[first[i] : first[i + 1]], lengths[first[i] : first[i + 1]]
        _, counts = np.unique(h, return_counts=True)
        pairs = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]
        lo, hi = np.searchsorted(breaks, (offsets[i], offsets[i + 1]))
        edges = np.searchsorted(starts[first[i] : first[i + 1]], breaks[lo:hi], "left")
        edges = np.unique(np.concatenate(([0], edges)))
        edges = edges[edges < len(h)]
        lines = np.add.reduceat(h * (np.arange(len(h), dtype=np.uint64) - np.repeat(edges, np.diff(np.append(edges, len(h)))).astype(np.uint64) + np.uint64(1)), edges)
        out[i, kinds + 2 :] = (size.mean(), size.std(), len(counts) / len(h), counts.max() / len(h), (h[1:] == h[:-1]).mean() if len(h) > 1 else 0, len(np.unique(pairs)) / len(pairs) if len(pairs) else 1, len(np.unique(lines)) / len(lines), len(h) / len(lines), len(h) / (1 + shares[i, 5]))
    return out


def _statistics(batches):
    import pyarrow as pa

    for batch in batches:
        for part in pieces(batch, 1 << 21):
            x = statistics(*text_buffer(part.column("text")))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(np.ascontiguousarray(x[:, j])) for j in range(x.shape[1]))], names=STATISTICS.names)


def text_statistics(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_statistics, STATISTICS)


def _grow(binned: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int, rows: np.ndarray, path: tuple, paths: list, value: np.ndarray, least: int) -> None:
    """Splits rows by the best gain and records every path; value gets the leaves' steps."""
    total_g, total_h = g[rows].sum(), h[rows].sum()
    if path:
        paths.append(path)
    best = (1e-6, None)
    if depth and len(rows) >= 2 * least:
        for j in range(binned.shape[1]):
            b = binned[rows, j]
            gs, hs, ns = (np.cumsum(np.bincount(b, w, BINS)) for w in (g[rows], h[rows], None))
            ok = (ns >= least) & (len(rows) - ns >= least)
            gain = np.where(ok, gs**2 / (hs + 1) + (total_g - gs) ** 2 / (total_h - hs + 1) - total_g**2 / (total_h + 1), 0)
            k = int(np.argmax(gain))
            if gain[k] > best[0]:
                best = (gain[k], (j, k))
    if best[1] is None:
        value[rows] = -total_g / (total_h + 1)
        return
    j, k = best[1]
    low = binned[rows, j] <= k
    for side, sign in ((rows[low], "<="), (rows[~low], ">")):
        _grow(binned, g, h, depth - 1, side, (*path, (j, sign, k)), paths, value, least)


def _holds(x: np.ndarray, rule: tuple, cuts: np.ndarray) -> np.ndarray:
    ok = np.ones(len(x), bool)
    for j, sign, k in rule:
        ok &= (x[:, j] <= cuts[j, k]) if sign == "<=" else (x[:, j] > cuts[j, k])
    return ok


def fit_rules(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, lasso: float = LASSO) -> dict:
    """Rules with weights from statistics x and labels y."""
    if not len(x):
        return {"intercept": 0.0, "rules": []}
    cuts = np.quantile(x, np.arange(1, BINS + 1) / BINS, axis=0).T
    cuts[:, -1] = np.inf
    binned = np.stack([np.searchsorted(cuts[j, :-1], x[:, j], "left") for j in range(x.shape[1])], 1)
    share = min(max(y.mean(), 1e-3), 1 - 1e-3)
    score, paths = np.full(len(y), np.log(share / (1 - share))), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        value = np.zeros(len(y))
        _grow(binned, p - y, p * (1 - p), depth, np.arange(len(y)), (), paths, value, max(5, len(y) // 500))
        score += 0.3 * value
    rules = list(dict.fromkeys(tuple(sorted(p)) for p in paths))
    if not rules:
        return {"intercept": float(np.log(share / (1 - share))), "rules": []}
    z = np.stack([_holds(x, r, cuts) for r in rules], 1)
    _, once = np.unique(np.packbits(z, axis=0), axis=1, return_index=True)
    rules, z = [rules[i] for i in sorted(once)], z[:, sorted(once)].astype(np.float32)
    mean, spread = z.mean(axis=0), np.maximum(z.std(axis=0), 1e-3)
    z = (z - mean) / spread
    w, b = np.zeros(z.shape[1]), np.log(share / (1 - share))
    v, old, t = w.copy(), w.copy(), 1.0
    v0 = np.random.default_rng(1).normal(size=z.shape[1])
    for _ in range(20):
        v0 = z.T @ (z @ v0)
        norm = np.linalg.norm(v0)
        v0 /= norm
    step = 1 / (0.25 * norm / len(y) + 0.25)
    for _ in range(400):  # accelerated proximal gradient
        p = 1 / (1 + np.exp(-(z @ v + b)))
        b -= step * (p - y).mean()
        w = v - step * (z.T @ (p - y)) / len(y)
        w = np.sign(w) * np.maximum(np.abs(w) - step * lasso, 0)
        t, t0 = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
        v, old = w + (t0 - 1) / t * (w - old), w
    kept = np.flatnonzero(w)
    weights = w[kept] / spread[kept]
    return {"intercept": float(b - (weights * mean[kept]).sum()), "rules": [([(NAMES[j], sign, float(cuts[j, k])) for j, sign, k in rules[i] if np.isfinite(cuts[j, k])], float(u)) for i, u in zip(kept, weights, strict=True)]}


def compiled(model: dict) -> str:
    """The score as a Spark SQL expression over NAMES."""
    terms = [repr(model["intercept"]) + "D"]
    for conditions, weight in model["rules"]:
        test = " AND ".join(f"{name} {sign} {cut!r}D" for name, sign, cut in conditions) or "true"
        terms.append(f"IF({test}, {weight!r}D, 0D)")
    return f"1D / (1D + exp(-({' + '.join(terms)})))"


def train(stats: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> dict:
    """Rules from the labelled rows of stats; labels (doc_id, quality)."""
    labels = labels.where("quality IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"))
    known = stats.join(labels, "doc_id")
    n = known.count()
    if n > max_train:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(max_train / n * (1 << 30)))
    rows = known.orderBy("doc_id").toPandas()
    return fit_rules(rows[NAMES].to_numpy(), rows["quality"].to_numpy(dtype=np.float64))


def op1(spark, sf_dir: str) -> DataFrame:
    stats, _ = written(text_statistics(documents(spark, sf_dir)), "quality-statistics")
    model = train(stats.where(~held_out(4, 2)), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = stats.select("doc_id", held_out(4, 2).alias("held_out"), F.expr(compiled(model)).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
