"""Packing of tokenised documents into fixed sequences by the sum-of-squares rule.

A piece goes where the sum over all gaps of the squared number of open sequences with that gap becomes smallest.  Shards of
bounded size are packed apart.  Pieces in sequences that a shard leaves unfilled are packed anew in fewer shards, until one
shard holds what is left.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from capacast import session
from capacast.llm import tokens, words

LENGTH = 4096
END = 1
SHARD = 1 << 16
# The smallest pieces come last and fill the gaps that the others leave.
LAST_SHARE = 0.2
# Shares that the last shard tries, as its result stands.
TRIED = (0.2, 0.1, 0.4, 0.5, 0.05, 0.7)


class Tokens:
    """A tokenizer file, sent to the executors once; each worker builds its encoder when it first needs one."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            self.spec = file.read()
        self._encoder = None

    def __reduce__(self):
        return _tokens, (self.spec,)

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        if self._encoder is None:
            self._encoder = tokens.Encoder(self.spec)
        return self._encoder.encode(texts)


def _tokens(spec: str) -> Tokens:
    made = Tokens.__new__(Tokens)
    made.spec, made._encoder = spec, None
    return made


def tokenised(docs: DataFrame, tokenizer: str, length: int = LENGTH, end: int = END) -> DataFrame:
    """(key, doc_id, piece, start, length, ids_crc32, ids): every document's ids and the end id, cut into pieces.

    ``ids`` are little-endian unsigned 32-bit numbers.  The key tells pieces apart; it is written with them, as it depends
    on the partition.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Tokens(tokenizer))
    rows = docs.select(F.col("doc_id"), F.col("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "doc_id", "piece", "start", "length", "ids_crc32", "ids"]
        key = TaskContext.get().partitionId() << 33
        for batch, texts in words.pieces(batches):
            taken, made = [], []
            for row, found in enumerate(shared.value.encode(texts)):
                raw = np.append(found, np.uint32(end)).astype("<u4").tobytes()
                for piece, at in enumerate(range(0, len(raw), 4 * length)):
                    part = raw[at:at + 4 * length]
                    taken.append(row)
                    made.append((piece, at // 4, len(part) // 4, zlib.crc32(part), part))
            keys = pa.array(range(key, key + len(made)), pa.int64())
            key += len(made)
            types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [keys, batch.column("doc_id").take(pa.array(taken, pa.int32())),
                 *[pa.array(c, t) for c, t in zip(zip(*made), types)]], names)

    made = rows.mapInArrow(run, f"key bigint, doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, ids binary")
    return session.materialise(made, "pieces")


def place(sizes: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sequence and offset of each size in turn by the sum-of-squares rule, and the gap that each sequence is left with.

    Equal sums prefer an open sequence to a new one, and of the open ones the fullest.
    """
    counts = np.zeros(length + 1, np.int64)
    opened: list[list[int]] = [[] for _ in range(length + 1)]
    gaps: list[int] = []
    sequences, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    for i, size in enumerate(sizes.tolist()):
        fitting = np.flatnonzero(counts[size:]) + size
        # Half the change of the sum if a sequence of each gap is taken, plus what filling one up saves.
        change = counts[fitting - size] - counts[fitting] + 1
        twice = 2 * change
        if len(fitting) and fitting[0] == size:
            twice[0] = 1 - 2 * counts[size]
        new = 2 * counts[length - size] + 1 if size < length else 0
        best = int(twice.argmin()) if len(fitting) else -1
        if best >= 0 and twice[best] <= new:
            gap = int(fitting[best])
            sequence = opened[gap].pop()
            counts[gap] -= 1
        else:
            gap, sequence = length, len(gaps)
            gaps.append(length)
        sequences[i], offsets[i] = sequence, length - gap
        left = gap - size
        gaps[sequence] = left
        if left:
            opened[left].append(sequence)
            counts[left] += 1
    return sequences, offsets, np.array(gaps, np.int64)


def arranged(keys: np.ndarray, sizes: np.ndarray, last_share: float) -> np.ndarray:
    """Order in which pieces are placed: by a hash of the key, but the smallest in the end, the larger of them first."""
    mixed = words.mix(keys)
    by_size = np.lexsort((mixed, -sizes))
    first = len(keys) - int(len(keys) * last_share)
    head, tail = by_size[:first], by_size[first:]
    return np.concatenate([head[np.argsort(mixed[head], kind="stable")], tail])


def _shard_packer(length: int, shares: tuple[float, ...]):
    def run(table: pa.Table) -> pa.Table:
        keys, sizes = table.column("key").to_numpy(), table.column("length").to_numpy()
        least, best = -(-int(sizes.sum()) // length), None
        for share in shares:
            order = arranged(keys, sizes, share)
            sequences, offsets, gaps = place(sizes[order], length)
            if best is None or len(gaps) < len(best[3]):
                best = order, sequences, offsets, gaps
            if len(best[3]) == least:
                break
        order, sequences, offsets, gaps = best
        return pa.table({"key": keys[order], "length": sizes[order], "shard": table.column("shard").take(pa.array(order)),
                         "sequence": sequences, "offset": offsets, "gap": gaps[sequences]})
    return run


def pack(docs: DataFrame, tokenizer: str, length: int = LENGTH, end: int = END, shard: int = SHARD) -> DataFrame:
    """Every document's pieces with their place in sequences of at most ``length`` tokens.

    Takes doc_id and text; ``tokenizer`` is the path of a tokenizer file.  Returns doc_id, piece, start, length, ids_crc32,
    ids, sequence_id and offset.  Only documents longer than a sequence are cut.  A null text is an empty one and gives the
    end id alone; null and repeated ids are documents of their own; other columns are ignored; an empty table gives no rows.

    A shard's size bounds the memory of a task and the time of one sequential run.  Unfilled sequences of all shards are
    dissolved into fewer shards as long as that leaves less than half of the pieces; where most sequences cannot be filled
    at all, packing more at a time would not change that.
    """
    pieces = tokenised(docs, tokenizer, length, end)
    left = pieces.where(F.col("length") < length).select("key", "length")
    done, level = [], 0
    count = left.count()
    while count:
        shards = math.ceil(count / shard)
        shares = TRIED if shards == 1 else (LAST_SHARE,)
        # Shards of the next level mix what came from all shards of this one.
        dealt = left.withColumn("shard", F.pmod(F.xxhash64("key", F.lit(level)), F.lit(shards)))
        placed = session.materialise(dealt.groupBy("shard").applyInArrow(
            _shard_packer(length, shares),
            "key bigint, length bigint, shard bigint, sequence bigint, offset bigint, gap bigint"), "packed")
        unfilled = placed.where("gap > 0")
        again = unfilled.count() if shards > 1 else 0
        number = F.lit(level << 56) + F.shiftleft("shard", 20) + F.col("sequence")
        final = placed if again == 0 or 2 * again > count else placed.where("gap = 0")
        done.append(final.select(F.col("key").alias("of"), number.alias("number"), F.col("offset").alias("at")))
        if final is placed:
            break
        left, count, level = unfilled.select("key", "length"), again, level + 1
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
    if not done:  # whole sequences only, or nothing
        return pieces.select(*columns, (-1 - F.col("key")).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    places = done[0]
    for further in done[1:]:
        places = places.union(further)
    return pieces.join(places, F.col("key") == F.col("of"), "left").select(
        *columns, F.coalesce("number", -1 - F.col("key")).alias("sequence_id"),
        F.coalesce("at", F.lit(0)).cast("bigint").alias("offset"))
