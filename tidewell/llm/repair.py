"""Token ids in files, compressed by Re-Pair grammars.

Documents in ascending doc_id order are cut into shards of about ``SHARD_TOKENS`` ids. In a
shard the frequent pairs of neighbouring symbols are replaced by nonterminals, again and again:
each round takes the pairs that occur at least half as often as the most frequent one, down to
``MIN_COUNT`` occurrences, and replaces occurrences that do not overlap. As in the original
algorithm only pairs that a replacement made are counted anew; a pair waits at the level of its
count, a power of two, until the rounds come down to it. Pairs never cross a document's end. A
shard keeps its rules with the length of each rule's expansion, so ``token_at`` finds any token
and ``decode_document`` any document with the rules that they use alone.

A file is a Parquet file with one row a shard: partition, seq, the ids and sizes of its
documents, and the grammar as byte planes. Spark's writer commits it, so a lost executor
leaves no half file.

Null and empty texts are a document of the end id alone. Rows without a doc_id come first and
keep a null. Rows that share a doc_id stay rows of their own, in one partition, in the order of
their texts. An empty table gives no shard. Extra columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cleaned_up, documents, pieces, scratch
from .tokens import encoder, tokenizer_path

END_ID = 2
SHARD_TOKENS = 1 << 20
MIN_COUNT = 4
BASE = 1 << 20  # first nonterminal: above the ids of any vocabulary in use
SHARDS = T.StructType(
    [
        T.StructField("partition", T.IntegerType()),
        T.StructField("seq", T.IntegerType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("doc_ids", T.ArrayType(T.LongType())),
        T.StructField("doc_symbols", T.BinaryType()),
        T.StructField("symbols", T.BinaryType()),
        T.StructField("rules", T.BinaryType()),
        T.StructField("rule_lengths", T.BinaryType()),
    ]
)
DIGESTS = T.StructType(
    [
        T.StructField("partition", T.IntegerType()),
        T.StructField("seq", T.IntegerType()),
        T.StructField("doc_id", T.LongType()),
        T.StructField("at", T.LongType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
    ]
)


def planes(values: np.ndarray) -> bytes:
    """Unsigned 32-bit integers, lowest bytes first, then the next ones: compresses well."""
    return values.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def unplanes(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<u4").ravel()


UNCOUNTED = 100  # level of pairs that have not been counted yet
GONE = -1  # level of positions that start no pair, or none that is frequent


def _merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The distinct values of two ascending arrays."""
    both = np.concatenate((a, b))
    both.sort(kind="stable")  # merges runs
    return both[np.append(True, both[1:] != both[:-1])]


def _grouped(left: np.ndarray, right: np.ndarray, at: np.ndarray, width: int, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(places by pair, size of each pair's group, left and right of each pair)."""
    low = n.bit_length()
    if 2 * width + low > 64:  # symbols and places don't fit one integer
        order = np.lexsort((at, right, left))
        first = np.flatnonzero(np.append(True, (np.diff(left[order]) != 0) | (np.diff(right[order]) != 0)))
        return at[order], np.diff(np.append(first, len(at))), left[order][first], right[order][first]
    key = left.astype(np.uint64) << np.uint64(width)
    key |= right.astype(np.uint64)
    key <<= np.uint64(low)
    key |= at.astype(np.uint64)
    key.sort()
    place = (key & np.uint64((1 << low) - 1)).astype(np.int64)
    key >>= np.uint64(low)
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    pair = key[first].astype(np.int64)
    return place, np.diff(np.append(first, len(at))), pair >> width, pair & (1 << width) - 1


def compress(ids: np.ndarray, ends: np.ndarray, min_count: int = MIN_COUNT) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, ends of documents among them, rules as pairs, expansion lengths) of the ids of a shard."""
    n = len(ids)
    base = int(ids.max(initial=0)) + 1  # nonterminals follow here until they are written
    seq = np.append(ids.astype(np.int32), np.int32(-1))
    after, before = np.arange(1, n + 2, dtype=np.int32), np.arange(-1, n, dtype=np.int32)
    after[ends - 1] = after[n] = n  # n stands for the end of a document on either side
    before[0] = before[ends] = n
    level = np.full(n + 1, UNCOUNTED, np.int8)
    level[ends - 1] = level[n] = GONE
    lengths, rules, n_rules, now, at = np.zeros(0, np.int64), [], 0, UNCOUNTED, None
    while now > GONE:
        at = np.flatnonzero(level >= now) if at is None else at[level[at] >= now]
        if not len(at):
            now, at = int(level.max()), None
            continue
        looked = at
        place, count, left, right = _grouped(seq[at], seq[after[at]], at, (base + n_rules).bit_length(), n)
        own = (np.frexp(count)[1] - 1).astype(np.int8)
        own[count < min_count] = GONE
        level[place] = np.repeat(own, count)
        now = int(own.max())
        if now <= GONE:
            now, at = UNCOUNTED, looked
            continue
        chosen = np.flatnonzero(own == now)
        rank = np.empty(len(chosen), np.int64)
        rank[np.argsort(-count[chosen], kind="stable")] = np.arange(len(chosen))
        key = place[np.repeat(own == now, count)] << 32 | np.repeat(rank, count[chosen])
        key.sort()
        at, rank_at = key >> 32, key & 0xFFFFFFFF
        # of overlapping occurrences the one of the more frequent pair stays; in runs, every other
        key = rank_at * 2 + (np.arange(len(at)) & 1)
        near = after[at[:-1]] == at[1:]
        take = np.ones(len(at), bool)
        take[:-1] &= ~near | (key[:-1] < key[1:])
        take[1:] &= ~near | (key[1:] < key[:-1])
        at, rank_at = at[take], rank_at[take]
        used = np.bincount(rank_at, minlength=len(chosen)) > 0
        two = np.empty((len(chosen), 2), np.int64)
        two[rank] = np.stack([left[chosen], right[chosen]], 1)
        two = two[used]
        size = np.ones(two.shape, np.int64)
        size[two >= base] = lengths[two[two >= base] - base]
        lengths = np.append(lengths, size.sum(axis=1))
        rules.append(two)
        merged = after[at]
        far = after[merged]
        seq[at] = base + n_rules + (np.cumsum(used) - 1)[rank_at]
        seq[merged] = level[merged] = GONE
        after[at], before[far] = far, at
        level[at] = level[before[at]] = UNCOUNTED
        level[at[far == n]] = level[n] = GONE
        n_rules += len(two)
        # a few places are followed by themselves, many by looking at all
        at = _merged(looked, before[at]) if len(looked) < n >> 3 else None
    left = seq[:n] >= 0
    rules = np.concatenate(rules) if rules else np.zeros((0, 2), np.int64)
    symbols = seq[:n][left]
    symbols[symbols >= base] += BASE - base
    rules[rules >= base] += BASE - base
    return symbols, np.cumsum(left)[ends - 1], rules, lengths


def _runs(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Indexes of runs of those sizes, one after the other."""
    ends = np.cumsum(size)
    out = np.repeat((begin - (ends - size)).astype(np.int32), size)
    out += np.arange(len(out), dtype=np.int32)
    return out


def expand(symbols: np.ndarray, rules: np.ndarray) -> np.ndarray:
    """The ids that symbols stand for: the rules that they use are written out once, then copied to their places."""
    non = symbols >= BASE
    if not non.any():
        return symbols.astype(np.int32)
    wanted = np.zeros(len(rules), bool)
    wanted[symbols[non] - BASE] = True
    fresh = np.flatnonzero(wanted)
    while len(fresh):  # the rules that those rules use
        below = rules[fresh].ravel()
        new = np.zeros(len(rules), bool)
        new[below[below >= BASE] - BASE] = True
        fresh = np.flatnonzero(new & ~wanted)
        wanted[fresh] = True
    rule, place = np.flatnonzero(wanted).tolist(), np.cumsum(wanted) - 1
    raw, written = rules.astype("<i4").tobytes(), [b""] * len(rules)
    for r, (left, right) in zip(rule, rules[rule].tolist(), strict=True):  # a rule uses earlier ones
        written[r] = (written[left - BASE] if left >= BASE else raw[8 * r : 8 * r + 4]) + (written[right - BASE] if right >= BASE else raw[8 * r + 4 : 8 * r + 8])
    whole = np.array([len(written[r]) // 4 for r in rule])
    begin = np.cumsum(whole) - whole
    table = np.frombuffer(b"".join(written), "<i4")
    plain = symbols[~non]
    table = np.concatenate((table, plain.astype(np.int32)))
    starts, sizes = np.empty(len(symbols), np.int64), np.ones(len(symbols), np.int64)
    starts[~non] = np.arange(len(table) - len(plain), len(table))
    which = place[symbols[non] - BASE]
    starts[non], sizes[non] = begin[which], whole[which]
    return table[_runs(starts, sizes)]


class Shard:
    """Random access to one shard as read from a file."""

    def __init__(self, doc_ids: list[int | None], doc_symbols: bytes, symbols: bytes, rules: bytes, rule_lengths: bytes):
        self.doc_ids = doc_ids
        self.symbols = unplanes(symbols).astype(np.int64)
        self.rules = unplanes(rules).astype(np.int64).reshape(-1, 2)
        self.rule_lengths = unplanes(rule_lengths).astype(np.int64)
        self.ends = np.cumsum(unplanes(doc_symbols).astype(np.int64))

    def sizes(self) -> np.ndarray:
        """Tokens that each symbol stands for."""
        size = np.ones(len(self.symbols), np.int64)
        non = self.symbols >= BASE
        size[non] = self.rule_lengths[self.symbols[non] - BASE]
        return size

    def decode_document(self, k: int) -> np.ndarray:
        return expand(self.symbols[self.ends[k - 1] if k else 0 : self.ends[k]], self.rules)

    def token_at(self, i: int) -> int:
        """The i-th id of the shard, by expansion lengths alone."""
        before = np.cumsum(self.sizes())
        k = int(np.searchsorted(before, i, "right"))
        symbol, i = int(self.symbols[k]), i - int(before[k - 1] if k else 0)
        while symbol >= BASE:
            left, right = self.rules[symbol - BASE]
            size = int(self.rule_lengths[left - BASE]) if left >= BASE else 1
            symbol, i = (int(left), i) if i < size else (int(right), i - size)
        return symbol

    def documents(self):
        """(doc_id, place in the shard, ids) of every document."""
        ids = expand(self.symbols, self.rules)
        token_ends = np.cumsum(self.sizes())[self.ends - 1]
        start = 0
        for doc_id, end in zip(self.doc_ids, token_ends.tolist(), strict=True):
            yield doc_id, start, ids[start:end]
            start = end


def _ended(ids: np.ndarray, ends: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids with the end id behind each document, and the documents' sizes."""
    out = np.empty(len(ids) + len(ends), np.uint32)
    last = ends + np.arange(len(ends))
    own = np.ones(len(out), bool)
    own[last] = False
    out[last], out[own] = end_id, ids
    return out, np.diff(last, prepend=-1)


def _encode(path: str, end_id: int, shard_tokens: int):
    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part, own = TaskContext.get().partitionId(), encoder(path)
        doc_ids, sizes, tokens, held, seq = [], [], [], 0, 0

        def shard():
            ids, each = np.concatenate(tokens), np.concatenate(sizes)
            symbols, ends, rules, lengths = compress(ids, np.cumsum(each))
            row = [part, seq, len(ids), pa.concat_arrays(doc_ids).to_pylist(), planes(np.diff(ends, prepend=0)), planes(symbols), planes(rules.ravel()), planes(lengths)]
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), *[pa.binary()] * 4)
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds, strict=True)], names=SHARDS.names)

        for batch in batches:
            for piece in pieces(batch):
                ids, each = _ended(*own.encode_column(piece.column("text")), end_id)
                column = piece.column("doc_id")
                done = np.cumsum(each)
                first = begin = 0
                while first < len(each):  # as many documents as fill the shard
                    last = min(len(each), int(np.searchsorted(done, begin + shard_tokens - held)) + 1)
                    doc_ids.append(column.slice(first, last - first))
                    sizes.append(each[first:last])
                    tokens.append(ids[begin : done[last - 1]])
                    held += int(done[last - 1]) - begin
                    first, begin = last, int(done[last - 1])
                    if held >= shard_tokens:
                        yield shard()
                        doc_ids, sizes, tokens, held, seq = [], [], [], 0, seq + 1
        if tokens:
            yield shard()

    return run


def _read(batches):
    import pyarrow as pa

    for batch in batches:
        for k in range(batch.num_rows):
            row = batch.slice(k, 1).to_pylist()[0]
            out = [(doc_id, at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())) for doc_id, at, ids in Shard(*(row[x] for x in SHARDS.names[3:])).documents()]
            n = len(out)
            cols = [pa.array([x[i] for x in out], pa.int64()) for i in range(4)]
            yield pa.RecordBatch.from_arrays([pa.array([row["partition"]] * n, pa.int32()), pa.array([row["seq"]] * n, pa.int32()), *cols], names=DIGESTS.names)


def write_tokens(docs: DataFrame, to: str, tokenizer: str, end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS, order: list[Column] | None = None) -> None:
    """Writes docs (doc_id, text) as shards to a folder, in a given order over partitions and within them, or else in ascending order of doc_id."""
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *(c.alias(f"at{i}") for i, c in enumerate(order or [])))
    by = [f"at{i}" for i in range(len(order or []))] or ["doc_id"]
    dealt = rows.repartitionByRange(n, *by).sortWithinPartitions(*by, *([] if order else ["text"])).select("doc_id", "text")
    with cleaned_up(spark):
        dealt.mapInArrow(_encode(tokenizer, end_id, shard_tokens), SHARDS).write.option("compression", "zstd").parquet(to)


def read_tokens(spark, at: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files of a folder."""
    shards = spark.read.schema(SHARDS).parquet(at)
    sizes = shards.select("partition", "seq", "n_tokens")
    whole = sizes.groupBy("partition").agg(F.sum("n_tokens").alias("whole"))
    before = whole.select("partition", (F.sum("whole").over(Window.orderBy("partition")) - F.col("whole")).alias("before"))
    within = sizes.withColumn("within", F.sum("n_tokens").over(Window.partitionBy("partition").orderBy("seq")) - F.col("n_tokens"))
    starts = within.join(before, "partition").select("partition", "seq", (F.col("before") + F.col("within")).alias("shard_start"))
    docs = shards.mapInArrow(_read, DIGESTS).join(starts, ["partition", "seq"])
    return docs.select("doc_id", (F.col("shard_start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def op3(spark, sf_dir: str) -> DataFrame:
    to = scratch(spark, "tokens")
    write_tokens(documents(spark, sf_dir), to, tokenizer_path())
    return read_tokens(spark, to)
