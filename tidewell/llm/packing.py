"""Packing documents into sequences of at most WINDOW tokens by Karmarkar-Karp multiway differencing.

Documents are packed in groups of about ``GROUP_TOKENS`` tokens, each within one task and in the
order of the input, so nothing is shuffled. A document gives whole windows as far as it reaches;
what is left over (its tail, shorter than a window) is packed with the others' tails:

* The longest tails, about a window's worth, are kept back as filling.
* Differencing deals the others out to ``ceil(tokens / WINDOW)`` windows: every tail begins as a
  partition of its own with one full window and the rest empty, and the two partitions with the
  largest imbalance (fullest less emptiest window) are merged, fullest with emptiest, until one
  is left. Its windows are nearly equal. If one exceeds the capacity the number of windows rises by
  one and differencing starts again.
* The filling is cut to top the windows up. If it does not reach, the emptiest window is taken
  apart and becomes filling too. What is left of it makes whole windows, and then sequences of
  powers of two, which need no padding.

So no sequence needs padding, and apart from the filling only documents beyond a window are cut.
A sequence's number is its task's times 2^40 and a count, so it depends on the partitions of the input,
as its contents do.

A null text counts as empty: it is its end id alone. Each row is a document, also where doc_ids
repeat or are missing. An empty table gives no pieces. Extra columns are ignored. Memory goes with a
group or the longest document.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, pieces
from .repair import _ended
from .tokens import tokenizer_path, word_encoder

WINDOW = 4096
GROUP_TOKENS = 1 << 21
END_ID = 2
TOKENIZER = "word_bpe_49k.json"
PIECES = T.StructType([*(T.StructField(x, T.LongType()) for x in ("doc_id", "start", "length")), T.StructField("ids", T.BinaryType()), *(T.StructField(x, T.LongType()) for x in ("doc_tokens", "sequence_id", "offset"))])


def differenced(sizes: list[int], windows: int) -> list[list[int]]:
    """The numbers of the sizes that each window holds, by Karmarkar-Karp multiway differencing."""
    held: dict[int, list[int]] = {i: [i] for i in range(len(sizes))}  # by the smallest number in it
    # a partition lists its windows that are not empty, (size, name) in ascending order
    heap = [(-size, i, [(size, i)]) for i, size in enumerate(sizes)]
    heapq.heapify(heap)
    turn = len(sizes)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        meet = max(0, len(a) + len(b) - windows)  # so many full windows have to share with one another
        both = []
        for (x, i), (y, j) in zip(a[:meet], reversed(b[:meet]), strict=True):  # the fullest of one with the emptiest of the other
            more, less = (i, j) if len(held[i]) >= len(held[j]) else (j, i)
            held[more] += held.pop(less)
            both.append((x + y, more))
        both = sorted(both + a[meet:] + b[meet:])
        imbalance = both[-1][0] - (both[0][0] if len(both) == windows else 0)
        heapq.heappush(heap, (-imbalance, turn, both))
        turn += 1
    return list(held.values()) + [[] for _ in range(windows - len(held))]


def near_equal(sizes: list[int], window: int = WINDOW) -> list[list[int]]:
    """The numbers of the sizes (each at most window) in each of as few windows as differencing fits them into."""
    count = -(-sum(sizes) // window)
    while count:
        found = differenced(sizes, count)
        if all(sum(sizes[i] for i in own) <= window for own in found):
            return found
        count += 1
    return []


def laid_out(sizes: list[int], window: int = WINDOW) -> np.ndarray:
    """Rows (document, start, length, sequence, offset) of a group of documents of these sizes."""
    out: list[tuple[int, int, int, int, int]] = []
    sequence, tails = 0, []
    for d, size in enumerate(sizes):
        for start in range(0, size - window + 1, window):
            out.append((d, start, window, sequence, 0))
            sequence += 1
        if size % window:
            tails.append((size % window, d))
    tails.sort(key=lambda x: (-x[0], x[1]))
    kept, enough = 0, 0
    while kept < len(tails) and enough < window:
        enough += tails[kept][0]
        kept += 1
    filling, rest = tails[:kept], tails[kept:]
    windows = near_equal([size for size, _ in rest], window)
    windows.sort(key=lambda own: sum(rest[i][0] for i in own), reverse=True)
    used = [sum(rest[i][0] for i in own) for own in windows]
    lacking = sum(window - x for x in used)
    while lacking > enough:
        own, x = windows.pop(), used.pop()
        filling += [rest[i] for i in own]
        lacking, enough = lacking - (window - x), enough + x
    reserve = [[d, sizes[d] - size, size] for size, d in filling]  # document, next token, tokens left
    reserve.reverse()

    def fill(need: int, offset: int) -> None:
        while need:
            own = reserve[-1]
            n = min(need, own[2])
            out.append((own[0], own[1], n, sequence, offset))
            own[1], own[2], need, offset = own[1] + n, own[2] - n, need - n, offset + n
            if not own[2]:
                reserve.pop()

    for own, x in zip(windows, used, strict=True):
        offset = 0
        for i in own:
            size, d = rest[i]
            out.append((d, sizes[d] - size, size, sequence, offset))
            offset += size
        fill(window - x, x)
        sequence += 1
    left = enough - lacking
    while left:
        size = window if left >= window else 1 << (left.bit_length() - 1)
        fill(size, 0)
        sequence, left = sequence + 1, left - size
    return np.array(out, np.int64).reshape(-1, 5)


def _pack(path: str, end_id: int, window: int, group_tokens: int):
    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        own, base, done = word_encoder(path), TaskContext.get().partitionId() << 40, 0
        names, tokens, held = [], [], 0

        def group():
            rows = laid_out([len(x) for x in tokens], window)
            for lo in range(0, len(rows), 2048):
                part = rows[lo : lo + 2048]
                ids = [tokens[d][start : start + n].astype("<u4").tobytes() for d, start, n in part[:, :3].tolist()]
                whole = [len(tokens[d]) for d in part[:, 0].tolist()]
                columns = [pa.array([names[d] for d in part[:, 0].tolist()], pa.int64()), *(pa.array(part[:, k]) for k in (1, 2)), pa.array(ids, pa.binary()), pa.array(whole, pa.int64()), pa.array(base + done + part[:, 3]), pa.array(part[:, 4])]
                yield pa.RecordBatch.from_arrays(columns, names=PIECES.names)

        for batch in batches:
            for piece in pieces(batch):
                ids, each = _ended(*own.encode_column(piece.column("text")), end_id)
                bounds = np.append(0, np.cumsum(each)).tolist()
                for doc_id, a, b in zip(piece.column("doc_id").to_pylist(), bounds, bounds[1:], strict=False):
                    names.append(doc_id)
                    tokens.append(ids[a:b])
                    held += b - a
                    if held >= group_tokens:
                        yield from group()
                        done += held  # more than the sequences of the group
                        names, tokens, held = [], [], 0
        if tokens:
            yield from group()

    return run


def packed(docs: DataFrame, tokenizer: str | None = None, window: int = WINDOW, end_id: int = END_ID, group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """(doc_id, start, length, ids, doc_tokens, sequence_id, offset) of every piece of docs (doc_id, text); ids are little-endian unsigned 32-bit integers."""
    path = tokenizer or tokenizer_path(TOKENIZER)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_pack(path, end_id, window, group_tokens), PIECES)


def op13(spark, sf_dir: str) -> DataFrame:
    return packed(documents(spark, sf_dir)).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
