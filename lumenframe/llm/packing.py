"""Order-preserving packing of documents into training sequences.

Each shard (the rows of one scan task, in their order) is one stream of token ids. A dynamic program
chooses where to cut it: a sequence costs the padding up to the budget (none at a power of two), a fixed
price per sequence, and a penalty for what its end truncates - nothing at the end of a document, a little at
the end of a sentence, more inside one. With f(j) the least cost of the stream up to candidate j,

    f(j) = penalty(j) + price + budget - p(j) + min over p(i) >= p(j) - budget of f(i) + p(i),

so a monotone queue of f(i) + p(i) makes every transition O(1); sequences of a power of two are extra
transitions to the candidates that lie exactly so far back. The plan is a scan and one map: no shuffle.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import kernels, tokens
from .work import map_arrow

BUDGET = 2048
SENTENCE_PENALTY = 24
INSIDE_PENALTY = 160
SEQUENCE_PRICE = 16
END_ID = 1
#: Least power of two that may stay unpadded by choice; shorter ones would make tiny sequences.
SHORTEST_POWER = 64


def plan_cuts(position: np.ndarray, penalty: np.ndarray, budget: int, price: int = SEQUENCE_PRICE) -> np.ndarray:
    """Candidates at which the cheapest packing cuts, first and last included.

    position: ascending stream positions of the candidates, from 0 to the stream's length, no two further
    apart than ``budget``; penalty: what a cut at each costs.
    """
    m = len(position)
    if m < 2:
        return np.zeros(1, np.int64)
    back: list[tuple[int, ...]] = [()] * m
    power = SHORTEST_POWER
    while power < budget:
        at = np.searchsorted(position, position - power)
        for j in np.flatnonzero((position >= power) & (position[np.minimum(at, m - 1)] == position - power)).tolist():
            back[j] = (*back[j], int(at[j]))
        power *= 2
    p, extra = position.tolist(), penalty.tolist()
    cost, origin = [0] * m, [0] * m
    queue, keys, head = [0], [0], 0
    for j in range(1, m):
        here = p[j]
        while p[queue[head]] < here - budget:
            head += 1
        best, source = keys[head] + budget - here, queue[head]
        for i in back[j]:
            if cost[i] < best:
                best, source = cost[i], i
        best += extra[j] + price
        cost[j], origin[j] = best, source
        key = best + here
        while len(keys) > head and keys[-1] >= key:
            keys.pop()
            queue.pop()
        queue.append(j)
        keys.append(key)
    cuts = [m - 1]
    while cuts[-1]:
        cuts.append(origin[cuts[-1]])
    return np.array(cuts[::-1])


def candidates(ids: np.ndarray, ends: np.ndarray, closes: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Where a stream may be cut, and the penalties. ends: where each document ends; closes: ids that end a sentence."""
    known = ids < len(closes)
    at = np.flatnonzero(closes[np.where(known, ids, 0)] & known) + 1
    at = np.union1d(np.concatenate([[0], at]), ends)
    gaps = np.diff(at)
    wide = np.flatnonzero(gaps > budget // 4)
    inner = np.zeros(0, np.int64)
    if len(wide):  # long stretches without an end of sentence can be cut inside
        step = budget // 4
        n = (gaps[wide] - 1) // step
        inner = np.repeat(at[wide], n) + (kernels.ranges(n) + 1) * step
    every = np.union1d(at, inner)
    penalty = np.full(len(every), SENTENCE_PENALTY)
    penalty[np.isin(every, inner)] = INSIDE_PENALTY
    penalty[np.isin(every, np.concatenate([[0], ends]))] = 0
    return every, penalty


def pack_stream(texts: list[str | None], path: str, budget: int, end_id: int):
    """Pieces of the packed stream of some texts: text number, start in it, length, sequence, offset there,
    length of the text's ids; and the stream."""
    encode = tokens.encoder(path)
    encoded = [np.append(encode(text or ""), np.uint32(end_id)).astype("<u4") for text in texts]
    sizes = np.array([len(e) for e in encoded], np.int64)
    ids, ends = np.concatenate(encoded), np.cumsum(sizes)
    every, penalty = candidates(ids, ends, tokens.sentence_ends(path), budget)
    cuts = every[plan_cuts(every, penalty, budget)]
    bounds = np.union1d(cuts, ends)  # from 0, the first cut, to the end of the stream
    start, stop = bounds[:-1], bounds[1:]
    text = np.searchsorted(ends, start, "right")
    sequence = np.searchsorted(cuts, start, "right") - 1
    return text, start - (ends - sizes)[text], stop - start, sequence, start - cuts[sequence], sizes[text], ids, start


def pack(
    df: DataFrame,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    budget: int = BUDGET,
    end_id: int = END_ID,
    with_ids: bool = False,
) -> DataFrame:
    """Pack ``df`` into sequences of at most ``budget`` ids; one row per piece of a document.

    Columns: the id column, start, length, ids_crc32, doc_tokens, sequence_id, offset, and with ``with_ids`` the
    ids of the piece. Every document is followed by ``end_id``. Null text is empty: one piece, the end id alone.
    A null id, repeated ids and repeated rows are packed like any other row; an empty table gives no rows; columns
    other than the two named are not read, so their names can't clash. Sequences never span scan tasks, and
    sequence_id holds the task's number in its upper bits.
    """
    source = df.select(df[id_col].alias("id"), df[text_col].cast("string").alias("text"))
    id_type = source.schema["id"].dataType
    long = T.LongType()
    fields = [T.StructField(id_col, id_type)] + [
        T.StructField(n, long, False) for n in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
    ]
    if with_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType(), False), False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        following = TaskContext.get().partitionId() << 36
        for batch in batches:
            _, offsets = kernels.utf8(batch.column("text"))
            for low, high in kernels.slices(offsets):
                part = batch.slice(low, high - low)
                texts = part.column("text").to_pylist()
                text, start, length, sequence, offset, whole, ids, at = pack_stream(texts, tokenizer, budget, end_id)
                cuts = zip(at.tolist(), (at + length).tolist(), strict=True)
                crc = np.array([zlib.crc32(ids[a:b]) for a, b in cuts], np.int64)
                columns = [part.column("id").take(pa.array(text)), start, length, crc, whole, sequence + following, offset]
                if with_ids:
                    bounds = pa.array(np.append(at, len(ids)), pa.int32())
                    columns.append(pa.ListArray.from_arrays(bounds, pa.array(ids.astype(np.int32))))
                following += int(sequence[-1]) + 1
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], [f.name for f in fields])

    return map_arrow(source, run, T.StructType(fields))
