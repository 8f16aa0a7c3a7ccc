"""Language-model scores of whole texts, beside a word-frequency baseline.

One pass cuts every text into subword ids (a public vocabulary) and into
lower-cased words, in blocks of bounded bytes. The training documents' words and
ids are counted over the whole corpus by grouped sums.

The model (``attention``) starts from the corpus's id counts. Training is local
descent with averaging: in each of ``ROUNDS`` rounds every task walks through
its share of the training documents' windows, one in ``TRAIN_EVERY`` by hash, in
each round others (so the rounds together take every window once), and the rows
of the parameters that tasks touched are averaged in Spark, weighted by how often. What reaches the
driver is the parameters, whose size is the vocabulary's. Scoring splits every
text into overlapping windows and scores each id, and the closing id, once.

The baseline needs the corpus count of every word of a document. The ``HEAD``
most frequent words at most are broadcast; the other distinct words of each block are
joined with the counts, and the document sums are made from the block's answer.

Defined cases: a null text is empty: one token, the end; a null id is held out;
repeated rows count each time; without training documents the counts are zero
and the model is the uniform tree; an empty table gives no rows; other columns
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import attention, blocks, tokens
from .sampling import held_out
from .stage import drop, staged, staged_path

FOLDS, FOLD = 10, 0
BLOCK_BYTES = 4 << 20
#: Blocks in one file, so that a reader's batch of rows is bounded in bytes.
BLOCKS_PER_FILE = 16
SMOOTHING = 0.1
#: Words whose counts are broadcast; the counts of all others come from a join.
HEAD = 1 << 17
ROUNDS = 2
#: One window in so many is trained on in a round, in each round others: as many as rounds, so all are.
TRAIN_EVERY = ROUNDS
RATE = 0.15
#: Windows computed at once.
BATCH = 384
#: Hidden rows that are scored at once, about.
STATES = 1 << 18
#: Words, of several blocks, that are counted together before they are dealt out.
COUNTED = 1 << 19
#: Parameter rows that travel as one row.
CHUNK = 512

_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True

_RELATION = ("doc_ids array<bigint>, held array<boolean>, n_words array<int>, codes binary,"
             " words binary, counts binary, n_ids array<int>, ids binary")


def _one(values: np.ndarray | pa.Array) -> pa.ListArray:
    values = values if isinstance(values, pa.Array) else pa.array(values)
    return blocks.list_array(np.array([0, len(values)]), values)


def _kind(below: int) -> str:
    return "<u2" if below <= 1 << 16 else "<u4"


def _packed(values: np.ndarray, below: int) -> bytes:
    """Numbers below ``below`` in as few bytes as hold them all."""
    return values.astype(_kind(below)).tobytes()


def _relation(docs: DataFrame, vocabulary: str, end: int, block_bytes: int) -> DataFrame:
    """One row per block of texts: its words (numbered within the block) and its ids."""
    def blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.encoder(vocabulary)
        for batch in batches:
            held = batch.column("held").to_numpy(zero_copy_only=False).astype(bool)
            for lo, hi, raw, offsets in blocks.byte_slices(batch.column("text"), block_bytes):
                words, starts = blocks.lowered_words(raw, offsets, ~_BLANK[raw])
                codes = words.indices.to_numpy()
                n_words = np.diff(np.searchsorted(starts, offsets)).astype(np.int32)
                learnt = codes[np.repeat(~held[lo:hi], n_words)]
                counts = np.bincount(learnt, minlength=len(words.dictionary))
                ids, edges = encoder.encode(raw, offsets, end)
                # No word holds a blank. One value per block: lists of many words are dear to pass on.
                joined = pc.binary_join(_one(words.dictionary), " ").cast(pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [_one(batch.column("doc_id").slice(lo, hi - lo)), _one(held[lo:hi]), _one(n_words),
                     pa.array([_packed(codes, len(counts))], pa.binary()), joined, pa.array([counts.astype("<i8").tobytes()], pa.binary()),
                     _one(np.diff(edges).astype(np.int32)), pa.array([_packed(ids, end + 1)], pa.binary())],
                    names=["doc_ids", "held", "n_words", "codes", "words", "counts", "n_ids", "ids"])
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
                       held_out(F.col("doc_id"), FOLDS, FOLD).alias("held"))
    path = staged_path(docs.sparkSession, "lm-blocks")
    (rows.mapInArrow(blocks_of, _RELATION).withColumn("block", F.monotonically_increasing_id())
     .write.option("maxRecordsPerFile", BLOCKS_PER_FILE).option("compression", "zstd").parquet(path))
    return docs.sparkSession.read.parquet(path)


def _ids(batch: pa.RecordBatch, i: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    sizes = batch.column("n_ids")[i].values.to_numpy().astype(np.int64)
    return np.frombuffer(batch.column("ids")[i].as_buffer(), _kind(end + 1)).astype(np.int64), sizes


def _words(batch: pa.RecordBatch, i: int) -> pa.Array:
    """A block's distinct words."""
    joined = batch.column("words").slice(i, 1).cast(pa.string())
    return pc.split_pattern(joined, " ").flatten() if joined[0].as_py() else pa.array([], pa.string())


def _word_counts(relation: DataFrame) -> DataFrame:
    """How often every word occurs in the training documents."""
    def summed(parts: list[pa.Table]) -> Iterator[pa.RecordBatch]:
        yield from pa.concat_tables(parts).group_by("word").aggregate([("n", "sum")]).rename_columns(
            {"n_sum": "n"}).select(["word", "n"]).to_batches(max_chunksize=1 << 16)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                n = np.frombuffer(batch.column("counts")[i].as_buffer(), "<i8")
                parts.append(pa.table({"word": _words(batch, i), "n": n}).filter(pa.array(n > 0)))
                size += len(parts[-1])
                if size >= COUNTED:
                    yield from summed(parts)
                    parts, size = [], 0
        if parts:
            yield from summed(parts)
    rows = relation.select("words", "counts").mapInArrow(counted, "word string, n bigint")
    return rows.groupBy("word").agg(F.sum("n").alias("c"))


def _id_counts(relation: DataFrame, end: int) -> np.ndarray:
    """How often every id occurs in the training documents, the closing id included."""
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(end + 1, np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                ids, sizes = _ids(batch, i, end)
                held = batch.column("held")[i].values.to_numpy(zero_copy_only=False).astype(bool)
                total += np.bincount(ids[np.repeat(~held, sizes)], minlength=end + 1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["id", "n"])
    rows = relation.select("held", "n_ids", "ids").mapInArrow(counted, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n"))
    out = np.zeros(end + 1, np.int64)
    for row in rows.collect():  # at most the vocabulary
        out[row.id] = row.n
    return out


def _inputs(ids: np.ndarray, sizes: np.ndarray, end: int, picked: np.ndarray | None = None
            ) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Batches of windows: inputs, targets, which targets count, and their places in ``ids``."""
    base = np.cumsum(sizes) - sizes
    doc, first, scores_from = attention.windows(sizes)
    if picked is not None:
        keep = picked[doc] if picked.dtype == bool else picked
        doc, first, scores_from = doc[keep], first[keep], scores_from[keep]
    before = np.concatenate([[end], ids[:-1]])
    for i in range(0, len(doc), BATCH):
        d, f = doc[i:i + BATCH], first[i:i + BATCH, None]
        at = f + np.arange(attention.WINDOW)
        counts = (at < sizes[d, None]) & (at >= scores_from[i:i + BATCH, None])
        place = np.minimum(base[d, None] + at, len(ids) - 1)
        yield before.take(place), ids.take(place), counts, place


def _chosen(block: int, sizes: np.ndarray, held: np.ndarray, turn: int, every: int) -> np.ndarray:
    """The numbers of a block's windows that a round trains on."""
    doc = attention.windows(sizes)[0]
    hashed = blocks.mix((np.uint64(block) << np.uint64(20)) * np.uint64(blocks.BASE) + np.arange(len(doc), dtype=np.uint64))
    return np.flatnonzero((hashed % np.uint64(every) == np.uint64(turn % every)) & ~held[doc])


def _averaged(relation: DataFrame, tree: attention.Tree, params: dict, end: int, turn: int, every: int, rate: float) -> dict:
    """The parameters after one round over the training windows."""
    shared = relation.sparkSession.sparkContext.broadcast((tree, params))

    def trained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_tree, start = shared.value
        trainer = attention.Trainer(attention.Model(own_tree, {k: v.copy() for k, v in start.items()}), rate)
        rest: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            for i in range(batch.num_rows):
                ids, sizes = _ids(batch, i, end)
                held = batch.column("held")[i].values.to_numpy(zero_copy_only=False).astype(bool)
                chosen = _chosen(batch.column("block")[i].as_py(), sizes, held, turn, every)
                for windows in _inputs(ids, sizes, end, chosen):
                    rest.append(windows[:3])
                    if sum(len(x[0]) for x in rest) >= BATCH // 2:
                        trainer.step(*(np.concatenate(x) for x in zip(*rest)))
                        rest = []
        if rest:
            trainer.step(*(np.concatenate(x) for x in zip(*rest)))
        for name, touched in trainer.touched.items():
            moved = (trainer.model.p[name] - start[name]).astype("<f2")
            for first in range(0, len(touched), CHUNK):
                part = slice(first, first + CHUNK)
                if touched[part].any():
                    yield _chunk(name, first, touched[part].astype("<i4"), moved[part])
    sums = relation.select("block", "held", "n_ids", "ids").mapInArrow(trained, _CHUNKS).repartition("name", "first").mapInArrow(
        _chunk_sums, _CHUNKS)
    after = {k: v.copy() for k, v in params.items()}
    for row in sums.collect():  # at most the parameters
        weight = np.frombuffer(row.weights, "<i8")
        at = row.first + np.flatnonzero(weight)
        moved = np.frombuffer(row.moved, "<f8").reshape(len(weight), -1)
        after[row.name][at] += (moved[weight > 0] / weight[weight > 0, None]).astype(after[row.name].dtype)
    return after


_CHUNKS = "name string, first bigint, weights binary, moved binary"


def _chunk(name: str, first: int, weights: np.ndarray, moved: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(
        [{"name": name, "first": first, "weights": weights.tobytes(), "moved": moved.tobytes()}],
        pa.schema([("name", pa.string()), ("first", pa.int64()), ("weights", pa.binary()), ("moved", pa.binary())]))


def _chunk_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per chunk of parameter rows the summed weights and weighted moves; a task holds the parameters at most."""
    sums: dict[tuple[str, int], list[np.ndarray]] = {}
    for batch in batches:
        for row in batch.to_pylist():
            weight = np.frombuffer(row["weights"], "<i4").astype(np.int64)
            moved = np.frombuffer(row["moved"], "<f2").astype(np.float64).reshape(len(weight), -1) * weight[:, None]
            held = sums.setdefault((row["name"], row["first"]), [0 * weight, 0 * moved])
            held[0] += weight
            held[1] += moved
    for (name, first), (weight, moved) in sums.items():
        yield _chunk(name, first, weight, moved)


def train(relation: DataFrame, end: int, rounds: int = ROUNDS, every: int = TRAIN_EVERY, rate: float = RATE
          ) -> tuple[attention.Tree, dict]:
    tree = attention.huffman(_id_counts(relation, end))
    params = attention.fresh(tree)
    for turn in range(rounds):
        params = _averaged(relation, tree, params, end, turn, every, rate)
    return tree, params


def _model_scores(relation: DataFrame, tree: attention.Tree, params: dict, end: int) -> DataFrame:
    shared = relation.sparkSession.sparkContext.broadcast((tree, params))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = attention.Model(*shared.value)
        tables = model.tables()
        for batch in batches:
            for i in range(batch.num_rows):
                ids, sizes = _ids(batch, i, end)
                each = np.zeros(len(ids))
                states, places = [], []
                for inputs, _, counts, place in _inputs(ids, sizes, end):
                    states.append(model.states(inputs, counts, tables))
                    places.append(place[counts])
                    if len(states) * BATCH * attention.WINDOW > STATES or places[-1][-1] == len(ids) - 1:
                        at = np.concatenate(places)
                        each[at] = model.path_scores(np.concatenate(states), ids[at])
                        states, places = [], []
                total = np.add.reduceat(each, np.cumsum(sizes) - sizes) / np.log(10)
                block = np.full(len(sizes), batch.column("block")[i].as_py())
                yield pa.RecordBatch.from_arrays([pa.array(block), pa.array(np.arange(len(sizes))), pa.array(total)],
                                                 names=["block", "at", "score"])
    return relation.select("block", "n_ids", "ids").mapInArrow(scored, "block bigint, at bigint, score double")


_HEAD_PART = ("doc_ids array<bigint>, held array<boolean>, n_words array<int>, known array<int>, scores array<double>,"
              " at binary, codes binary, words array<string>")


def _head_part(relation: DataFrame, frequent: tuple[pa.Array, np.ndarray], below: float) -> DataFrame:
    """Per block the documents' scores over the broadcast words, and where the other words occur."""
    shared = relation.sparkSession.sparkContext.broadcast(frequent)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed_words, listed_counts = shared.value
        for batch in batches:
            for i in range(batch.num_rows):
                words = _words(batch, i)
                place = pc.index_in(words, value_set=listed_words).fill_null(-1).to_numpy()
                c = np.append(listed_counts, 0)[place]
                codes = np.frombuffer(batch.column("codes")[i].as_buffer(), _kind(len(words)))
                n_words = batch.column("n_words")[i].values.to_numpy()
                doc = np.repeat(np.arange(len(n_words)), n_words)
                listed, rest = (c > 0)[codes], np.flatnonzero(c == 0)
                number = np.zeros(len(words), np.int64)
                number[rest] = np.arange(len(rest))
                value = np.log10(c + SMOOTHING) - below
                other = ~listed
                yield pa.RecordBatch.from_arrays(
                    [pa.array(batch.column("block")[i:i + 1]), *(_one(batch.column(k)[i].values) for k in ("doc_ids", "held", "n_words")),
                     _one(np.bincount(doc[listed], minlength=len(n_words)).astype(np.int32)),
                     _one(np.bincount(doc[listed], value[codes[listed]], len(n_words)).astype(float)),
                     pa.array([_packed(doc[other], len(n_words))], pa.binary()),
                     pa.array([_packed(number[codes[other]], len(rest))], pa.binary()), _one(words.take(pa.array(rest)))],
                    names=["block", "doc_ids", "held", "n_words", "known", "scores", "at", "codes", "words"])
    return relation.select("block", "doc_ids", "held", "n_words", "codes", "words").mapInArrow(
        scored, "block bigint, " + _HEAD_PART)


def _threshold(counts: DataFrame, head: int) -> int:
    """The least power of two that at most ``head`` words reach."""
    sizes = {r.k: r["count"] for r in counts.groupBy(F.floor(F.log2("c")).cast("int").alias("k")).count().collect()}
    least = max(sizes, default=0) + 1
    while least > 0 and sum(n for k, n in sizes.items() if k >= least - 1) <= head:
        least -= 1
    return 1 << least


def _base_scores(relation: DataFrame, counts: DataFrame, total: int, distinct: int, ends: int, head: int) -> DataFrame:
    """Per document its tokens, how many are known, and the smoothed frequency score."""
    top = counts.where(F.col("c") >= _threshold(counts, head))
    below = float(np.log10(total + SMOOTHING * (distinct + 1)))
    found = top.select("word", "c").toArrow().combine_chunks()
    frequent = pa.array(found["word"].to_pylist(), pa.string()), found["c"].to_numpy().astype(np.int64)
    part = staged(_head_part(relation, frequent, below), "lm-head")
    known = part.select("block", F.posexplode("words").alias("i", "word")).join(counts, "word").groupBy("block").agg(
        F.collect_list(F.struct("i", "c")).alias("listed"))
    rows = part.withColumn("size", F.size("words")).drop("words").join(known, "block", "left")

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                c = np.zeros(batch.column("size")[i].as_py(), np.int64)
                listed = batch.column("listed").slice(i, 1).flatten()
                if len(listed):
                    c[listed.field("i").to_numpy()] = listed.field("c").to_numpy()
                head_known, scores, n_words = (batch.column(k)[i].values.to_numpy() for k in ("known", "scores", "n_words"))
                doc = np.frombuffer(batch.column("at")[i].as_buffer(), _kind(len(n_words)))
                codes = np.frombuffer(batch.column("codes")[i].as_buffer(), _kind(len(c)))
                rest = np.bincount(doc, (np.log10(c + SMOOTHING) - below)[codes], len(n_words))
                n_known = head_known + np.bincount(doc, (c > 0)[codes], len(n_words)) + (ends > 0)
                block = np.full(len(n_words), batch.column("block")[i].as_py())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(block), pa.array(np.arange(len(n_words))), batch.column("doc_ids")[i].values,
                     batch.column("held")[i].values, pa.array(n_words.astype(np.int64) + 1), pa.array(n_known.astype(np.int64)),
                     pa.array(scores + rest + np.log10(ends + SMOOTHING) - below)],
                    names=["block", "at", "doc_id", "held_out", "n_tokens", "n_known", "base_score"])
    return rows.mapInArrow(scored, "block bigint, at bigint, doc_id bigint, held_out boolean, n_tokens bigint,"
                                   " n_known bigint, base_score double")


def score(docs: DataFrame, vocabulary: str, end: int, rounds: int = ROUNDS, every: int = TRAIN_EVERY, rate: float = RATE,
          block_bytes: int = BLOCK_BYTES, head: int = HEAD) -> DataFrame:
    """Per document its base score and the trained model's log10 probability.

    ``end``, the highest id, closes every text and stands before its first id.
    """
    relation = _relation(docs, vocabulary, end, block_bytes)
    counts = staged(_word_counts(relation), "lm-words")
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    ends = relation.agg(F.coalesce(F.sum(F.size(F.filter("held", lambda h: ~h))), F.lit(0))).first()[0]
    total, distinct = total + ends, distinct + (ends > 0)
    tree, params = train(relation, end, rounds, every, rate)
    base = staged(_base_scores(relation, counts, total, distinct, ends, head), "lm-base")
    model = staged(_model_scores(relation, tree, params, end), "lm-scores")
    drop(relation, counts)
    return base.join(model, ["block", "at"]).select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("bigint").alias("train_tokens"), "base_score", "score")
