"""Language identification by nearest centroids of n-gram TF-IDF vectors.

A text's lower-cased bytes, with everything but letters blanked, give hashed 2- and 3-grams;
counts are damped by a logarithm, weighted by inverse document frequency and normalised. Each
language has several centroids from spherical k-means; a text takes the language of the
centroid with the largest cosine. A text is rejected when it has no letter or when its cosine
is below ``REJECT_FACTOR`` times a low quantile of what training texts of that language reach
at its length: short texts have lower cosines, so the quantile is taken of n-grams drawn from
training texts, for every power of two, and is no more than that of the longer texts themselves.

The model is fitted on a sample of at most about ``MAX_TRAIN`` labelled rows, an equal share
for each language, chosen by a hash of doc_id. Null, empty and letterless texts get ``und``
with score 0 and are rejected. With no training row at all every text is ``und``. Repeated
rows and ids are scored row by row, also those without an id; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WINDOW, documents, pieces, text_buffer

DIMS = 1 << 13
CENTROIDS = 4
MAX_TRAIN = 4000
REJECT_QUANTILE = 0.01
REJECT_FACTOR = 0.5
REJECT_TEXTS = 50  # training texts of a language that n-grams are drawn from
LENGTHS = 18  # thresholds for 2 ** 0 .. 2 ** 17 n-grams
LONG = 256
UNKNOWN = "und"
_LETTER = np.full(256, 32, np.uint8)
_LETTER[97:123] = np.arange(97, 123)
_LETTER[128:] = np.arange(128, 256)
PREDICTED = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])


def _lowered(part):
    import pyarrow as pa
    import pyarrow.compute as pc

    texts = pc.fill_null(part.column("text").cast(pa.large_string()), "")
    return texts, text_buffer(pc.utf8_lower(texts))


def gram_counts(data: np.ndarray, dims: int = DIMS) -> np.ndarray:
    """Counts of hashed byte n-grams of one lower-cased text, window by window."""
    letters = np.concatenate(([np.uint8(32)], _LETTER[data], [np.uint8(32)]))
    shift, mix = np.uint32(32 - (dims.bit_length() - 1)), np.uint32(0x9E3779B1)
    counts = np.zeros(dims, np.int64)
    for lo in range(0, len(letters) - 1, WINDOW):
        b = letters[lo : lo + WINDOW + 2].astype(np.uint32)  # with the two bytes that its last grams need
        two = b[:-1] * np.uint32(0x9E3779B1) + b[1:] * np.uint32(0x85EBCA77)
        three = two[:-1] * np.uint32(0xC2B2AE3D) + b[2:] * np.uint32(0x27D4EB2F) + np.uint32(0x165667B1)
        two, keep2, keep3 = two[:WINDOW], ((b[:-1] != 32) | (b[1:] != 32))[:WINDOW], b[1:-1] != 32
        slots = np.concatenate((((two[keep2] ^ (two[keep2] >> np.uint32(15))) * mix) >> shift, ((three[keep3] ^ (three[keep3] >> np.uint32(15))) * mix) >> shift))
        counts += np.bincount(slots.astype(np.int64), minlength=dims)
    return counts


def _sparse(batches):
    """(doc_id, lang, slots, counts) of rows, of those that share doc_id and lang the first of a task."""
    import pyarrow as pa

    seen = set()
    for batch in batches:
        new = []
        for key in zip(batch.column("doc_id").to_pylist(), batch.column("lang").to_pylist(), strict=True):
            new.append(key not in seen)
            seen.add(key)
        batch = batch.filter(pa.array(new))
        slots, counts = [], []
        for part in pieces(batch):
            _, (data, offsets) = _lowered(part)
            for s, e in zip(offsets[:-1], offsets[1:], strict=True):
                c = gram_counts(data[s:e])
                at = np.flatnonzero(c)
                slots.append(at.astype("<u2").tobytes())
                counts.append(c[at].astype("<u4").tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lang"), pa.array(slots, pa.binary()), pa.array(counts, pa.binary())], names=["doc_id", "lang", "slots", "counts"])


def _vectors(rows: list, idf: np.ndarray) -> np.ndarray:
    """A normalised vector for each row, with no copy of all of them on the way."""
    x = np.zeros((len(rows), DIMS), np.float32)
    for i, r in enumerate(rows):
        x[i, np.frombuffer(r["slots"], "<u2")] = np.log1p(np.frombuffer(r["counts"], "<u4"))
        x[i] *= idf
    for lo in range(0, len(x), 256):
        part = x[lo : lo + 256]
        part /= np.maximum(np.linalg.norm(part, axis=1, keepdims=True), 1e-12)
    return x


def _clusters(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means, first centres chosen farthest first."""
    centres = [x.mean(axis=0)]
    centres[0] /= max(np.linalg.norm(centres[0]), 1e-12)
    near = x @ centres[0]
    while len(centres) < min(k, len(x)):
        centres.append(x[int(np.argmin(near))])
        near = np.maximum(near, x @ centres[-1])
    centres = np.stack(centres)
    for _ in range(rounds):
        own = np.argmax(x @ centres.T, axis=1)
        for j in range(len(centres)):
            if (own == j).any():
                mean = x[own == j].mean(axis=0)
                centres[j] = mean / max(np.linalg.norm(mean), 1e-12)
    return centres


def _least(x: np.ndarray, rows: list, idf: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The smallest cosine that is accepted for each power of two of n-grams."""
    rng = np.random.default_rng(7)
    sizes = np.array([int(np.frombuffer(r["counts"], "<u4").sum()) for r in rows])
    long = sizes >= LONG
    most = np.quantile((x[long if long.any() else slice(None)] @ centres.T).max(axis=1), REJECT_QUANTILE)
    out = np.zeros(LENGTHS)
    for k in range(3, LENGTHS):
        able = np.flatnonzero(sizes >= 1 << k)
        if not len(able):
            out[k] = out[k - 1]
            continue
        drawn = np.zeros((min(REJECT_TEXTS, len(able)), DIMS), np.float32)
        for i, j in enumerate(able[np.linspace(0, len(able) - 1, len(drawn)).astype(int)]):
            counts = np.frombuffer(rows[j]["counts"], "<u4")
            drawn[i, np.frombuffer(rows[j]["slots"], "<u2")] = np.log1p(rng.multinomial(1 << k, counts / counts.sum()))
        drawn *= idf
        drawn /= np.maximum(np.linalg.norm(drawn, axis=1, keepdims=True), 1e-12)
        out[k] = min(most, np.quantile((drawn @ centres.T).max(axis=1), REJECT_QUANTILE))
    out[:3] = out[3] * np.arange(3) / 3
    return REJECT_FACTOR * out


def fit(train: DataFrame, max_train: int = MAX_TRAIN, centroids: int = CENTROIDS) -> dict:
    """A model from rows of train (doc_id, text, lang) with a doc_id and a language.

    At most about max_train rows are drawn, by a hash of doc_id; of rows that share a doc_id and a
    language one counts.
    """
    train = train.where("doc_id IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long"), "text", "lang")
    counts = dict(train.groupBy("lang").count().collect())
    if not counts:
        return {"langs": [], "centroids": np.zeros((0, DIMS), np.float32), "own": np.zeros(0, np.int64), "idf": np.ones(DIMS, np.float32), "least": np.zeros((0, LENGTHS))}
    share = max_train / len(counts)
    spread = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    part = F.lit(False)
    for lang, n in sorted(counts.items()):
        part = part | ((F.col("lang") == lang) & (spread < int(min(1.0, share / n) * (1 << 30))))
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("lang", T.StringType()), T.StructField("slots", T.BinaryType()), T.StructField("counts", T.BinaryType())])
    rows = train.where(part).mapInArrow(_sparse, schema).dropDuplicates(["doc_id", "lang"]).collect()
    rows = sorted(rows, key=lambda r: (r["lang"], r["doc_id"] is not None, r["doc_id"] or 0, bytes(r["slots"])))
    seen = np.zeros(DIMS, np.int64)
    for r in rows:
        seen[np.frombuffer(r["slots"], "<u2")] += 1
    idf = np.log((1 + len(rows)) / (1 + seen)).astype(np.float32) + np.float32(0.1)
    langs = sorted({r["lang"] for r in rows})
    groups, least = [], []
    for lang in langs:  # one language's vectors at a time: the driver never holds all of them
        own = [r for r in rows if r["lang"] == lang]
        x = _vectors(own, idf)
        groups.append(_clusters(x, centroids))
        least.append(_least(x, own, idf, groups[-1]))
        del x
    least = np.array(least)
    own = np.repeat(np.arange(len(langs)), [len(g) for g in groups])
    return {"langs": langs, "centroids": np.concatenate(groups).astype(np.float32), "own": own, "idf": idf, "least": least}


def _judged(model):
    """Parts of batches with language, score and rejection of every row."""

    def run(batches):
        m = model.value
        for batch in batches:
            for part in pieces(batch, 1 << 21):
                texts, (data, offsets) = _lowered(part)
                n = part.num_rows
                pred, score, rejected = [UNKNOWN] * n, np.zeros(n), np.ones(n, bool)
                for lo in range(0, n, 256):
                    hi = min(n, lo + 256)
                    x = np.zeros((hi - lo, DIMS), np.float32)
                    lettered, length = np.zeros(hi - lo, bool), np.ones(hi - lo)
                    for i in range(lo, hi):
                        own = data[offsets[i] : offsets[i + 1]]
                        if not len(own):
                            continue
                        if not ((own >= 97) & (own <= 122)).any() and not any(c.isalpha() for c in texts[i].as_py()):
                            continue
                        lettered[i - lo] = True
                        counts = gram_counts(own)
                        x[i - lo], length[i - lo] = np.log1p(counts), max(1, counts.sum())
                    if not len(m["langs"]) or not lettered.any():
                        continue
                    x *= m["idf"]
                    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
                    cosine = x @ m["centroids"].T
                    best = np.argmax(cosine, axis=1)
                    for i in np.flatnonzero(lettered):
                        k = int(m["own"][best[i]])
                        pred[lo + i] = m["langs"][k]
                        score[lo + i] = min(1.0, max(0.0, float(cosine[i, best[i]])))
                        rejected[lo + i] = score[lo + i] < np.interp(np.log2(length[i]), np.arange(LENGTHS), m["least"][k])
                yield part, pred, score, rejected

    return run


def _predict(model):
    def run(batches):
        import pyarrow as pa

        for part, pred, score, rejected in _judged(model)(batches):
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(pred, pa.string()), pa.array(score), pa.array(rejected)], names=PREDICTED.names)

    return run


def _accept(model):
    def run(batches):
        import pyarrow as pa

        for part, _, _, rejected in _judged(model)(batches):
            yield part.filter(pa.array(~rejected))

    return run


def identify(docs: DataFrame, model: dict) -> DataFrame:
    """(doc_id, lang_pred, score, rejected) of every row of docs (doc_id, text)."""
    spark = docs.sparkSession
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_predict(spark.sparkContext.broadcast(model)), PREDICTED)


def accepted(docs: DataFrame, model: dict) -> DataFrame:
    """The rows of docs that are not rejected, with all their columns."""
    spark = docs.sparkSession
    return docs.mapInArrow(_accept(spark.sparkContext.broadcast(model)), docs.schema)


def held_out(folds: int, fold: int):
    """Whether a row is of the fold kept out of training; a row without a doc_id is of no fold, and fit leaves it out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == fold, F.lit(False))


def op8(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = fit(docs.where(~held_out(5, 0)))
    return identify(docs, model).select("doc_id", held_out(5, 0).alias("held_out"), "lang_pred", "score", "rejected")
