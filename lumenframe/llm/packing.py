"""Best-fit packing of token sequences, hierarchically.

Pieces are dealt out by a hash and packed best-fit, largest first, within each partition. Nearly full sequences are
done; the others go on as items of their own, with their members, to fewer and fewer partitions, until a round has few
items or merges nothing. Rounds are written to the shared folder, so each is packed once.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.llm.common import table
from lumenframe.llm.tokens import TEXT_BYTES, UNITS, slices, tokenizer, vocabulary, with_end
from lumenframe.session import materialize

PIECE = pa.struct([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
PIECE_SQL = "struct<doc_id:long,piece:int,start:long,length:long,ids_crc32:long>"


def cuts(n: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pieces of documents of n tokens each: document, number of the piece, start, length.

    A document that fits is one piece; a longer one has pieces of most tokens, the first one maybe shorter.
    """
    k = -(-n // most)
    own = np.repeat(np.arange(len(n)), k)
    piece = np.arange(len(own)) - np.repeat(np.cumsum(k) - k, k)
    end = n[own] - (k[own] - 1 - piece) * most
    start = np.maximum(0, end - most)
    return own, piece, start, end - start


def best_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Best-fit decreasing: the items of each bin. A bit per free space that some bin has finds the tightest fit."""
    bins: list[list[int]] = []
    open_at: list[list[int]] = [[] for _ in range(capacity + 1)]
    free = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        fits = free >> need
        if fits:
            room = need + ((fits & -fits).bit_length() - 1)
            b = open_at[room].pop()
            if not open_at[room]:
                free &= ~(1 << room)
        else:
            room, b = capacity, len(bins)
            bins.append([])
        bins[b].append(i)
        room -= need
        open_at[room].append(b)
        free |= 1 << room
    return bins


def _cut(tokenizer_file: str, end_id: int, most: int, max_units: int):
    """id, text -> pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(tokenizer_file, max_units)
        for whole in batches:
            for b in slices(whole, TEXT_BYTES):
                ids, at = with_end(*tok.encode(b.column(1)), end_id)
                own, piece, start, length = cuts(np.diff(at), most)
                raw = memoryview(ids.astype("<u4")).cast("B")
                first = 4 * (at[own] + start)
                crc = [zlib.crc32(raw[i:j]) for i, j in zip(first.tolist(), (first + 4 * length).tolist(), strict=True)]
                cols = [b.column(0).take(pa.array(own)), piece.astype(np.int32), start, length, np.array(crc, np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(cols, PIECE, strict=True)], [t.name for t in PIECE])

    return run


def pieces(docs: DataFrame, tokenizer_file: str, end_id: int = 0, most: int = 2048, id_col: str = "doc_id", text_col: str = "text", max_units: int = UNITS) -> DataFrame:
    """Pieces of tokenized documents: doc_id, piece, start, length, ids_crc32.

    max_units bounds the units that a task keeps the ids of: fewer take less memory and more time.

    Null and empty texts have the end id only. Rows that repeat an id have pieces of their own; null ids stay null. An
    empty table gives no pieces; other columns aren't read.
    """
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_cut(tokenizer_file, end_id, most, max_units), "doc_id long, piece int, start long, length long, ids_crc32 long")


def _pack_chunk(t: pa.Table, capacity: int, slack: int, base: int) -> Iterator[pa.RecordBatch]:
    """Best-fit packing of the rows of t (fill, members); ties go by the first member."""
    t = t.combine_chunks()
    fills, lists = t.column("fill").to_numpy(), t.column("members").chunk(0)
    flat, offsets = lists.flatten(), lists.offsets.to_numpy()
    offsets = offsets - offsets[0]
    sizes = np.diff(offsets)
    order = np.lexsort((flat.field("start").to_numpy()[offsets[:-1]], flat.field("doc_id").fill_null(-1).to_numpy()[offsets[:-1]]))
    packed = best_fit(fills[order], capacity)
    for at in range(0, len(packed), 10_000):
        some = [order[b] for b in packed[at : at + 10_000]]
        fill = np.array([fills[b].sum() for b in some])
        take = np.concatenate([np.arange(offsets[i], offsets[i + 1]) for b in some for i in b])
        ends = np.append(0, np.cumsum([sizes[b].sum() for b in some]))
        members = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat.take(pa.array(take)))
        yield pa.RecordBatch.from_arrays([pa.array(fill >= capacity - slack), pa.array(np.arange(base + at, base + at + len(some))), pa.array(fill), members], ["done", "sequence_id", "fill", "members"])


def _lay_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members of each sequence with their offsets."""
    for b in batches:
        lists = b.column(b.schema.get_field_index("members"))
        flat, ends = lists.flatten(), lists.offsets.to_numpy()
        ends = ends - ends[0]
        before = np.append(0, np.cumsum(flat.field("length").to_numpy()))
        sizes = np.diff(ends)
        offset = before[:-1] - np.repeat(before[ends[:-1]], sizes)
        sequence = np.repeat(b.column(b.schema.get_field_index("sequence_id")).to_numpy(), sizes)
        yield pa.RecordBatch.from_arrays([*flat.flatten(), pa.array(sequence), pa.array(offset)], [*[f.name for f in PIECE], "sequence_id", "offset"])


def pack(items: DataFrame, capacity: int = 2048, slack: int = 4, fan_in: int = 4, chunk: int = 50_000) -> DataFrame:
    """Pack pieces (length <= capacity) into sequences: adds sequence_id and offset, gapless from 0 in each sequence.

    A sequence is done when at most slack tokens are free, or when the smallest item that is left doesn't fit in it.
    Items that are left go on to a fan_in-th of the partitions, but never to fewer than hold chunk items each (the most
    that are packed at once), so the last task stays small whatever the input; a round of which next to nothing could
    be merged is the last. Pieces that repeat are packed each by itself; no pieces, no rows.
    """
    n = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bins = items.select(F.col("length").alias("fill"), F.array(F.struct("doc_id", "piece", "start", "length", "ids_crc32")).alias("members"))
    schema = f"done boolean, sequence_id long, fill long, members array<{PIECE_SQL}>"
    done, left_before, level = [], None, 0
    while True:
        level += 1

        def run(batches: Iterator[pa.RecordBatch], level: int = level) -> Iterator[pa.RecordBatch]:
            base, held, rows = (level << 52) + (TaskContext.get().partitionId() << 32), [], 0
            for b in batches:
                held.append(b)
                rows += b.num_rows
                if rows >= chunk:
                    yield from _pack_chunk(pa.Table.from_batches(held), capacity, slack, base)
                    base, held, rows = base + rows, [], 0
            if rows:
                yield from _pack_chunk(pa.Table.from_batches(held), capacity, slack, base)

        packed = materialize(bins.repartition(n, F.xxhash64("members", F.lit(level))).mapInArrow(run, schema), "packed")
        least = packed.agg(F.min("fill")).first()[0] or 0
        closed = F.col("done") | (F.col("fill") > capacity - least)
        left = packed.where(~closed).count()
        done.append(packed.where(closed))
        fewer = max(-(-left // chunk), n // fan_in if left > chunk else 1)
        if not left or n == 1 or fewer >= n and left_before is not None and left >= 0.98 * left_before:
            done.append(packed.where(~closed))
            break
        bins, left_before, n = packed.where(~closed).select("fill", "members"), left, min(n, fewer)
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.select("sequence_id", "members").mapInArrow(_lay_out, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op10_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(pieces(table(spark, sf_dir, "documents"), vocabulary()))
