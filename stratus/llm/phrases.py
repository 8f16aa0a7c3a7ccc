"""Phrase collocations by set-oriented mining of occurrence relations.

Every text is cut into pieces and words. The relation of length k lists where
each k-word phrase occurs: per block of texts the positions in order, and with
each position the phrase there. It is persisted at every length, and its phrases
are group-counted in Spark. The next length comes from a merge-join: after a
semi-join with the frequent phrases, two occurrences at adjacent positions of
one piece (pieces are kept apart by a free position) make one of length k + 1.

A block holds the texts of one language from one Arrow batch, up to
``BLOCK_BYTES`` or one longer text; its phrases are numbered within the block,
so a pair of numbers names the longer phrase exactly. Between blocks a phrase is
the sequence of its words' 64-bit hashes. Words are counted by their text, and
the hashes are seeded anew if two different words share one. A length is counted
once, by these keys, from one row per block and phrase. The semi-join sees the
frequent ones as a bitmap of a bounded size. A phrase that passes it by chance is
dropped by its own count, so neither the hash nor the bitmap's size ever changes a
result.

Scores compare a phrase with its two parts at the worst cut: its count times all
words over the product of the parts' counts, in decimals of 38 digits.

Defined cases: a null text is empty, a null language ``und``; repeated rows count
each time; equal scores and counts rank by the phrase's bytes; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import blocks
from .stage import drop, staged, staged_path

MIN_COUNT = 100
MAX_WORDS = 5
TOP = 2000
#: A candidate goes if a longer one around it has this share of its count, in percent.
COVERED_PERCENT = 100
BLOCK_BYTES = 2 << 20
#: Blocks in one file, so that a reader's batch of rows is bounded in bytes.
BLOCKS_PER_FILE = 16
#: Bits of the semi-join's bitmap per frequent phrase, and at most in all (128 MB).
BITS_PER_PHRASE = 64
MAX_BITS = 1 << 30
#: Bits by which a word's hash is turned more than the word's before it.
TURN = 13
#: Parts of a language that are ranked on their own first.
RANK_SLICES = 64

_SPLIT, _BLANK = b".,;:!?\x0a\x0b\x0c\x0d", b"\x20\x09"
_KIND = np.zeros(256, np.uint8)
_KIND[list(_BLANK)] = 1
_KIND[list(_SPLIT)] = 2

_KINDS = ("i1", "<i2", "<i4")

_BLOCK = "lang string, ats binary, ids binary, keys binary, phrases binary, counts binary"


def _words(raw: np.ndarray, offsets: np.ndarray) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The lower-cased words of a slice and their positions; pieces lie a position apart."""
    kind = _KIND[raw]
    words, starts = blocks.lowered_words(raw, offsets, kind == 0)
    edge = kind == 2
    edge[offsets[:-1][offsets[:-1] < len(raw)]] = True
    piece = np.cumsum(edge)[starts]
    apart = np.zeros(len(starts), np.int64)
    apart[1:] = piece[1:] != piece[:-1]
    return words, np.arange(len(starts)) + np.cumsum(apart)


def _lang_salt(lang: str) -> np.uint64:
    return np.uint64(xxhash.xxh64_intdigest(lang.encode(), 42))


def _key_hash(hashes: np.ndarray, phrases: np.ndarray, salt: np.uint64) -> np.ndarray:
    """One hash per phrase, from its words' hashes: each turned by its place, all xored (``_hash_of``)."""
    out = np.full(phrases.shape[1], salt, np.uint64)
    for place, numbers in enumerate(phrases):
        turn = TURN * place % 64
        out ^= (hashes << np.uint64(turn) | hashes >> np.uint64(-turn % 64) if turn else hashes)[numbers]
    return out


def _hash_of(lang: Column, key: Column, words: int) -> Column:
    """``_key_hash`` of a language and a phrase's key."""
    out = F.xxhash64(lang)
    for place in range(words):
        word = F.conv(F.hex(F.substring(key, place * 8 + 1, 8)), 16, -10).cast("bigint")
        turn = TURN * place % 64
        if turn:
            word = F.shiftleft(word, turn).bitwiseOR(F.shiftrightunsigned(word, 64 - turn))
        out = out.bitwiseXOR(word)
    return out


def _packed(rows: np.ndarray) -> bytes:
    """The rows of a matrix of integers, each in the fewest bytes a number that hold it; their kinds first."""
    kinds = [next((i for i, k in enumerate(_KINDS) if not row.size or (np.iinfo(k).min <= row.min() and row.max() <= np.iinfo(k).max)))
             for row in rows]
    return bytes(kinds) + b"".join(row.astype(_KINDS[k]).tobytes() for row, k in zip(rows, kinds))


def _unpacked(data: pa.Buffer, height: int) -> np.ndarray:
    kinds = [np.dtype(_KINDS[k]) for k in np.frombuffer(data, np.uint8, height)]
    size = (len(data) - height) // sum(k.itemsize for k in kinds)
    out, at = np.empty((height, size), np.int64), height
    for row, kind in zip(out, kinds):
        row[:] = np.frombuffer(data, kind, size, at)
        at += size * kind.itemsize
    return out


def _row(lang: str, ats: np.ndarray, ids: np.ndarray, hashes: np.ndarray, phrases: np.ndarray, counts: np.ndarray,
         words: pa.Array | None = None) -> pa.RecordBatch:
    """A block: its occurrences, its words' hashes (highest byte first), its phrases and their counts.

    A phrase is the numbers of its words in the block; phrases come in ascending order, so the
    steps from one to the next in each column are small."""
    parts = [_packed(np.diff(ats, prepend=0)[None]), _packed(ids[None]), hashes.astype(">u8").tobytes(),
             _packed(np.diff(phrases, axis=1, prepend=0)), _packed(counts[None])]
    columns = [pa.array([lang], pa.string()), *(pa.array([x], pa.binary()) for x in parts)]
    names = ["lang", "ats", "ids", "keys", "phrases", "counts"]
    if words is not None:
        columns, names = [*columns, blocks.list_array(np.array([0, len(words)]), words)], [*names, "words"]
    return pa.RecordBatch.from_arrays(columns, names=names)


def _ints(batch: pa.RecordBatch, name: str, i: int) -> np.ndarray:
    return _unpacked(batch.column(name)[i].as_buffer(), 1)[0]


def _phrases(batch: pa.RecordBatch, i: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """A block's word hashes, and its phrases as word numbers, a row per place in the phrase."""
    hashes = np.frombuffer(batch.column("keys")[i].as_buffer(), ">u8").astype(np.uint64)
    return hashes, np.cumsum(_unpacked(batch.column("phrases")[i].as_buffer(), width), axis=1)


def _key_array(keys: np.ndarray) -> pa.Array:
    """The rows of a matrix of word hashes as binary keys, highest byte first."""
    raw, width = np.ascontiguousarray(keys).astype(">u8"), 8 * keys.shape[1]
    edges = (np.arange(len(keys) + 1) * width).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(keys), [None, pa.py_buffer(edges), pa.py_buffer(raw.tobytes())])


def _listed(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    place = h & np.uint64(len(bitmap) * 8 - 1)
    return (bitmap[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _word_counts(relation: DataFrame) -> DataFrame:
    """A row per block and word: lang, word, n and its key as a number."""
    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                lang = batch.column("lang")[i].as_py()
                hashes, phrases = _phrases(batch, i, 1)
                k = hashes[phrases[0]].view(np.int64)
                columns = [pa.repeat(lang, len(k)), batch.column("words")[i].values, pa.array(_ints(batch, "counts", i)), pa.array(k)]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "word", "n", "k"])
    return relation.select("lang", "keys", "phrases", "counts", "words").mapInArrow(
        rows_of, "lang string, word string, n bigint, k bigint")


def _phrase_counts(relation: DataFrame, width: int) -> DataFrame:
    """A row per block and phrase: lang, key, n."""
    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                hashes, phrases = _phrases(batch, i, width)
                keys = _key_array(hashes[phrases].T)
                yield pa.RecordBatch.from_arrays(
                    [pa.repeat(batch.column("lang")[i].as_py(), len(keys)), keys, pa.array(_ints(batch, "counts", i))],
                    names=["lang", "key", "n"])
    return relation.select("lang", "keys", "phrases", "counts").mapInArrow(rows_of, "lang string, key binary, n bigint")


def _occurrences(docs: DataFrame, seed: int, block_bytes: int) -> DataFrame:
    """The relation of single words."""
    def blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column("lang").dictionary_encode()
            for number, lang in enumerate(langs.dictionary.to_pylist()):
                texts = batch.column("text").filter(pc.equal(langs.indices, number))
                for _, _, raw, offsets in blocks.byte_slices(texts, block_bytes):
                    words, ats = _words(raw, offsets)
                    if not len(words):
                        continue
                    ids = words.indices.to_numpy()
                    hashes = np.array([xxhash.xxh64_intdigest(w, seed) for w in
                                       words.dictionary.cast(pa.binary()).to_pylist()], np.uint64)
                    numbers = np.arange(len(hashes))[None, :]
                    yield _row(lang, ats, ids, hashes, numbers, np.bincount(ids, minlength=len(hashes)), words.dictionary)
    named = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"),
                        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return named.mapInArrow(blocks_of, f"{_BLOCK}, words array<string>")


def _extended(relation: DataFrame, width: int, frequent: Broadcast) -> DataFrame:
    """The relation one word longer than ``relation``, whose phrases have ``width`` words."""
    def blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = np.frombuffer(frequent.value, np.uint8)
        for batch in batches:
            for i in range(batch.num_rows):
                lang = batch.column("lang")[i].as_py()
                hashes, phrases = _phrases(batch, i, width)
                ids = _ints(batch, "ids", i)
                kept = _listed(bitmap, _key_hash(hashes, phrases, _lang_salt(lang)))[ids]
                ats, ids = np.cumsum(_ints(batch, "ats", i))[kept], ids[kept]
                joined = np.flatnonzero(ats[1:] == ats[:-1] + 1)
                if not len(joined):
                    continue
                size = phrases.shape[1]
                pairs, numbers, counts = np.unique(ids[joined] * size + ids[joined + 1],
                                                   return_inverse=True, return_counts=True)
                left, right = np.divmod(pairs, size)
                longer = np.concatenate([phrases[:, left], phrases[-1:, right]])
                used = np.zeros(len(hashes), bool)
                used[longer] = True
                yield _row(lang, ats[joined], numbers, hashes[used], (np.cumsum(used) - 1)[longer], counts)
    return relation.select("lang", "ats", "ids", "keys", "phrases").mapInArrow(blocks_of, _BLOCK)


def _persisted(df: DataFrame, label: str) -> DataFrame:
    path = staged_path(df.sparkSession, label)
    df.write.option("maxRecordsPerFile", BLOCKS_PER_FILE).option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _bitmap(frequent: DataFrame, count: int) -> Broadcast:
    """The frequent phrases' hashes as a bitmap for the tasks; at most ``MAX_BITS`` bits reach the driver."""
    n_bits = 1 << 15
    while n_bits < min(count * BITS_PER_PHRASE, MAX_BITS):
        n_bits *= 2
    place = (F.col("h").bitwiseAND(F.lit(n_bits - 1)) + 1).alias("place")
    rows = frequent.select(place).groupBy(F.expr("bitmap_bucket_number(place)").alias("bucket")).agg(
        F.expr("bitmap_construct_agg(bitmap_bit_position(place))").alias("bits"))
    out = bytearray(n_bits // 8)
    for row in rows.toLocalIterator():
        first = (row.bucket - 1) * 4096
        out[first:first + 4096] = row.bits
    return frequent.sparkSession.sparkContext.broadcast(bytes(out))


def frequent_phrases(docs: DataFrame, min_count: int, max_words: int, block_bytes: int = BLOCK_BYTES
                     ) -> tuple[DataFrame, DataFrame]:
    """``(lang, key, words, n)`` of every phrase of up to ``max_words`` words that
    occurs ``min_count`` times, with ``word`` for single words; ``(lang, n)`` of all words."""
    for seed in range(1, 100):
        relation = _persisted(_occurrences(docs, seed, block_bytes), "phrase-relation")
        # A word's key is the same in every block; sums and maxima of numbers are hashed, not sorted.
        counted = _word_counts(relation).groupBy("lang", "word").agg(F.sum("n").alias("n"), F.max("k").alias("k"))
        vocabulary = staged(counted.select("lang", "word", "n", F.unhex(F.lpad(F.hex("k"), 16, "0")).alias("key")), "phrase-words")
        clash = vocabulary.groupBy("lang", "key").count().where("count > 1").limit(1).count()
        if not clash:
            break
        drop(relation, vocabulary)
    totals = vocabulary.groupBy("lang").agg(F.sum("n").alias("n"))
    frequent = staged(vocabulary.where(F.col("n") >= min_count), "phrase-counts")
    found = [frequent.withColumn("words", F.lit(1))]
    for width in range(2, max_words + 1):
        size = frequent.count()
        if not size:
            break
        shared = _bitmap(frequent.select(_hash_of(F.col("lang"), F.col("key"), width - 1).alias("h")), size)
        longer = _persisted(_extended(relation, width - 1, shared), "phrase-relation")
        shared.destroy()
        drop(relation)
        relation = longer
        # Every phrase is counted by its key: the rows are the blocks' phrases, however many of them are frequent.
        frequent = staged(_phrase_counts(relation, width).groupBy("lang", "key").agg(
            F.sum("n").alias("n")).where(F.col("n") >= min_count), "phrase-counts")
        found.append(frequent.withColumn("words", F.lit(width)))
    drop(relation)
    phrases = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), found)
    return phrases.select("lang", "key", "words", "n", "word"), totals


def _part(key: Column, first: Column, words: Column) -> Column:
    return F.substring(key, first * 8 + 1, words * 8)


def collocations(docs: DataFrame, min_count: int = MIN_COUNT, max_words: int = MAX_WORDS, top: int = TOP,
                 covered_percent: int = COVERED_PERCENT, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The first ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score."""
    phrases, totals = frequent_phrases(docs, min_count, max_words, block_bytes)
    counts = phrases.select("lang", "key", "n")
    candidates = phrases.where("words >= 2")

    cuts = candidates.select("lang", "key", "words", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("cut"))
    cuts = cuts.withColumns({"left": _part(F.col("key"), F.lit(0), F.col("cut")),
                             "right": _part(F.col("key"), F.col("cut"), F.col("words") - F.col("cut"))})
    for side, name in (("left", "l"), ("right", "r")):
        cuts = cuts.join(counts.select("lang", F.col("key").alias(side), F.col("n").alias(name)), ["lang", side])
    cuts = cuts.join(totals, "lang")
    exact = lambda c: F.col(c).cast("decimal(20,0)")
    cuts = cuts.withColumns({"over": (F.lit(1000).cast("decimal(4,0)") * exact("a")).cast("decimal(24,0)") * exact("n"),
                             "under": exact("l") * exact("r")})
    worst = cuts.withColumn("score", F.expr("over div under")).groupBy("lang", "key", "words", "a", "n").agg(
        F.min(F.struct("score", "cut", "l", "r")).alias("worst"))

    # A phrase inside a longer candidate is inside one that is a word longer: that one occurs as often at least.
    around = candidates.where("words >= 3").select("lang", "n", F.explode(F.array(
        _part(F.col("key"), F.lit(0), F.col("words") - 1), _part(F.col("key"), F.lit(1), F.col("words") - 1))).alias("key"))
    around = around.groupBy("lang", "key").agg(F.max("n").alias("longer"))
    kept = worst.join(around, ["lang", "key"], "left").where(
        F.coalesce(F.col("longer") * 100 < F.lit(covered_percent) * F.col("a"), F.lit(True)))

    words = phrases.where("words = 1").select("lang", F.col("key").alias("__word"), "word")
    spelled = kept.select("lang", "key", F.explode(F.sequence(F.lit(0), F.col("words") - 1)).alias("i")).withColumn(
        "__word", _part(F.col("key"), F.col("i"), F.lit(1))).join(words, ["lang", "__word"])
    spelled = spelled.groupBy("lang", "key").agg(
        F.array_join(F.expr("transform(array_sort(collect_list(struct(i, word))), x -> x.word)"), " ").alias("phrase"))
    scored = kept.join(spelled, ["lang", "key"]).select(
        "lang", "phrase", "a", F.col("worst.l").alias("l"), F.col("worst.r").alias("r"), "n",
        F.col("worst.score").alias("score"))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    scored = scored.withColumn("__slice", F.pmod(F.xxhash64("phrase"), F.lit(RANK_SLICES)))
    first = scored.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "__slice").orderBy(*order)))
    first = first.where(F.col("rank") <= top)
    last = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint"))
    return last.where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
