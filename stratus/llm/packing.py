"""Sequence packing by minimum bin slack over the length histogram.

Documents are tokenised and cut into pieces of at most ``capacity`` tokens.
Packing works on the histogram of piece lengths, which has at most
``capacity`` entries however large the corpus is: starting from the longest
length left, a bitset subset-sum dynamic program finds the multiset of
remaining lengths that fills the sequence closest to its capacity, the counts
are read back through the stored bitsets, and the pattern is used as often as
the counts allow. Executors then place every piece by its rank within its
length. Ranks are counted within hash slices of a length, so one length that
holds a large share of all pieces is still dealt over many tasks.

Defined cases: a null or empty text is one piece holding only the closing id;
repeated rows are packed as often as they occur; lengths must lie between 1
and the capacity.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import blocks, tokens
from .stage import staged

CAPACITY = 2048
CLOSING_ID = 1
#: Pieces that one task ranks, about.
SLICE_ROWS = 200_000
#: Bytes of text tokenised at once: larger slices share more repeated words.
SLICE_BYTES = 2 << 20


class Slot(NamedTuple):
    """Ranks ``[rank_from, rank_to)`` of a length go, ``per_sequence`` at a
    time, to the sequences from ``first_sequence`` on, from ``offset`` on."""
    length: int
    rank_from: int
    rank_to: int
    per_sequence: int
    first_sequence: int
    offset: int


def best_fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of lengths whose sum is the largest that fits ``room``.

    Bit k of a bitset is set when some multiset of the lengths looked at so
    far sums to k; long lengths come first, so they are used up first.
    """
    mask, full = (1 << room + 1) - 1, 1 << room
    sums, steps = 1, []
    for length in sorted((n for n, c in counts.items() if c and n <= room), reverse=True):
        left, step = min(counts[length], room // length), 1
        while left:
            take = min(step, left)
            after = sums | (sums << take * length) & mask
            if after != sums:
                steps.append((length, take, sums))
                sums = after
            left -= take
            step *= 2
        if sums & full:
            break
    at, used = sums.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> at & 1:
            used[length] = used.get(length, 0) + take
            at -= take * length
    return used


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[Slot]:
    """Where every rank of every length goes."""
    counts = {n: c for n, c in histogram.items() if c > 0}
    if any(not 0 < n <= capacity for n in counts):
        raise ValueError("lengths must lie between 1 and the capacity")
    placed = dict.fromkeys(counts, 0)
    slots: list[Slot] = []
    sequence = 0
    for longest in sorted(counts, reverse=True):
        while counts[longest]:
            counts[longest] -= 1
            pattern = best_fill(counts, capacity - longest)
            counts[longest] += 1
            pattern[longest] = pattern.get(longest, 0) + 1
            times = min(counts[n] // k for n, k in pattern.items())
            offset = 0
            for n, k in sorted(pattern.items(), reverse=True):
                slots.append(Slot(n, placed[n], placed[n] + k * times, k, sequence, offset))
                placed[n] += k * times
                counts[n] -= k * times
                offset += k * n
            sequence += times
    return slots


def pack(items: DataFrame, keys: list[str], length: str = "length", capacity: int = CAPACITY,
         slice_rows: int = SLICE_ROWS) -> DataFrame:
    """``items`` with sequence_id and offset appended.

    ``keys`` identify an item up to interchangeable repeats. ``items`` is read
    twice: give a staged table.
    """
    spark = items.sparkSession
    histogram = {r[0]: r[1] for r in items.groupBy(length).count().collect()}
    slots = spark.createDataFrame(
        plan(histogram, capacity) or [], "length int, rank_from bigint, rank_to bigint, per_sequence int,"
        " first_sequence bigint, first_offset int")
    slots = slots.withColumnRenamed("length", "__length")
    n_slices = max([1, *(-(-c // slice_rows) for c in histogram.values())])
    sliced = items.withColumn("__slice", F.pmod(F.xxhash64(*keys), F.lit(n_slices)).cast("int"))
    # Ranks of a length run through its hash slices in order: a few counts a length.
    per_slice = sliced.groupBy(length, "__slice").count()
    before = per_slice.alias("a").select(
        F.col(length), F.col("__slice"),
        (F.sum("count").over(_running(length)) - F.col("count")).alias("__before"))
    within = sliced.withColumn("__rank", F.row_number().over(_ranked(length, keys)) - 1)
    ranked = (within.join(before, [length, "__slice"]) if n_slices > 1
              else within.withColumn("__before", F.lit(0).cast("bigint")))
    ranked = ranked.withColumn("__rank", F.col("__rank") + F.col("__before"))
    # The plan has a bounded number of slots (it grows with the capacity only).
    placed = ranked.join(F.broadcast(slots), (F.col(length) == F.col("__length"))
                         & (F.col("__rank") >= F.col("rank_from")) & (F.col("__rank") < F.col("rank_to")))
    turn = F.col("__rank") - F.col("rank_from")
    return placed.select(
        *items.columns,
        (F.col("first_sequence") + F.floor(turn / F.col("per_sequence"))).cast("bigint").alias("sequence_id"),
        (F.col("first_offset") + turn % F.col("per_sequence") * F.col(length)).cast("bigint").alias("offset"))


def _running(length: str):
    return Window.partitionBy(length).orderBy("__slice")


def _ranked(length: str, keys: list[str]):
    return Window.partitionBy(length, "__slice").orderBy(*keys)


_PIECES = "struct<doc_tokens:bigint,crcs:array<bigint>>"
_PIECES_IDS = "struct<doc_tokens:bigint,crcs:array<bigint>,ids:array<int>>"


def _token_column(text: Column, vocabulary: str, capacity: int, closing_id: int, keep_ids: bool) -> Column:
    """Per text its token count and the CRC-32 of each piece's ids."""
    def compute(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = tokens.encoder(vocabulary)
        for column in columns:
            sizes, per_doc, crcs, kept = [], [], [], []
            for _, _, raw, offsets in blocks.byte_slices(column, SLICE_BYTES):
                ids, edges = encoder.encode(raw, offsets, closing_id)
                view = memoryview(ids.astype("<u4").tobytes())
                n = np.diff(edges)
                sizes.append(n)
                per_doc.append(-(-n // capacity))
                for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
                    crcs += [zlib.crc32(view[4 * i:4 * min(i + capacity, b)]) for i in range(a, b, capacity)]
                if keep_ids:
                    kept.append(ids.astype(np.int32))
            edge = lambda parts: np.concatenate([[0], np.cumsum(np.concatenate(parts))]) if parts else np.zeros(1)
            fields = [pa.array(np.concatenate(sizes) if sizes else [], pa.int64()),
                      blocks.list_array(edge(per_doc), pa.array(crcs, pa.int64()))]
            names = ["doc_tokens", "crcs"]
            if keep_ids:
                fields.append(blocks.list_array(edge(sizes), pa.array(np.concatenate(kept) if kept else [], pa.int32())))
                names.append("ids")
            yield pa.StructArray.from_arrays(fields, names=names)
    kind = _PIECES_IDS if keep_ids else _PIECES
    return F.arrow_udf(compute, kind).asNondeterministic()(text.cast("string"))


def token_pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, closing_id: int = CLOSING_ID,
                 keep_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens (and ids).

    ``vocabulary`` is the path of a ``tokenizers`` file, readable on every
    executor. Pieces of a document are full but for the last.
    """
    coded = docs.select("doc_id", _token_column(F.col("text"), vocabulary, capacity, closing_id, keep_ids).alias("t"))
    rows = coded.select("doc_id", F.col("t.doc_tokens").alias("doc_tokens"),
                        *([F.col("t.ids").alias("all_ids")] if keep_ids else []),
                        F.posexplode("t.crcs").alias("n", "ids_crc32"))
    start = (F.col("n") * capacity).cast("bigint")
    length = F.least(F.lit(capacity).cast("bigint"), F.col("doc_tokens") - start)
    ids = [F.slice("all_ids", start.cast("int") + 1, length.cast("int")).alias("ids")] if keep_ids else []
    return rows.select("doc_id", start.alias("start"), length.alias("length"), "ids_crc32", "doc_tokens", *ids)


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, closing_id: int = CLOSING_ID,
                   keep_ids: bool = False) -> DataFrame:
    """The pieces of ``docs`` with their sequence and offset."""
    pieces = staged(token_pieces(docs, vocabulary, capacity, closing_id, keep_ids), "pieces")
    return pack(pieces, ["doc_id", "start", "doc_tokens", "ids_crc32"], capacity=capacity)
