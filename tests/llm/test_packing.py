import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from stratus.llm import blocks, packing, tokens
from stratus.llm.queries import vocabulary_path

ODD = ["", " ", "  a", "a  b", "a \n b", "a\n\nb", "a\nb", "é\né ü", "x  y z", "I'm don't 've", "a\tb \tc", "日本 語 \n日本\n語",
       "tail ", "tail\n", "\n lead", "x" * 200 + " y", "a\x0bb\x1cc d", "a\u0085 b\u0085\nc", "emoji 😀 😀\n😀 x", "ß\nß",
       "a  b", "..\n.. 12 3\n4", "a\r\nb \r c", "​ ​x\n​", "a　 b", "\x7f \x7f\n\x7f", "a   b", "Ωμ \nя"]


def plain_ids(texts):
    coder = tokens.encoder(vocabulary_path()).tokenizer
    return [c.ids + [1] for c in coder.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def encode(texts, encoder=None):
    encoder = encoder or tokens.Encoder(vocabulary_path())
    out = []
    for _, _, raw, offsets in blocks.byte_slices(pa.array(texts, pa.string()), 500):
        ids, edges = encoder.encode(raw, offsets, 1)
        out += [x.tolist() for x in np.split(ids, edges[1:-1])]
    return out


def test_ids_equal_the_tokenizer():
    rng = random.Random(5)
    texts = ODD + ["".join(rng.choice(["a", " ", "\n", "é", "the", " the", "'s", "1", "!", "\t", "語", " ", "  "])
                           for _ in range(rng.randrange(60))) for _ in range(400)]
    assert encode(texts) == plain_ids(texts)
    assert encode(texts, tokens.Encoder(vocabulary_path(), max_kept=50)) == plain_ids(texts)


def thue_morse(n):
    text = "a"
    while len(text) < n:
        text += text.translate(str.maketrans("ab", "ba"))
    return text


def test_chunks_with_equal_polynomial_hashes_keep_their_own_ids():
    swap = str.maketrans("ab", "ba")
    texts = [t for n in (1024, 2048) for t in (thue_morse(n), thue_morse(n).translate(swap))]
    texts += ["x " + t + " y" for t in texts]
    assert encode(texts) == plain_ids(texts)


def test_special_token_strings_and_words_of_every_script():
    rng = random.Random(9)
    letters = [chr(c) for c in [*range(0x20, 0x7F), 0xA0, 0xAD, 0xDF, 0xE9, 0x300, 0x661, 0x4E2D, 0x200D, 0x1F600]]
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|>y z"]
    texts += ["".join(rng.choices(letters, k=rng.randrange(300))) for _ in range(500)]
    assert encode(texts) == plain_ids(texts)
    slow = tokens.Encoder(vocabulary_path())
    slow.fast = None
    assert encode(texts, slow) == plain_ids(texts)


def test_best_fill_is_the_least_slack():
    rng = random.Random(6)
    for _ in range(200):
        counts = {rng.randrange(1, 30): rng.randrange(1, 4) for _ in range(4)}
        room = rng.randrange(0, 40)
        reach = {0}
        for n, c in counts.items():
            reach = {s + k * n for s in reach for k in range(c + 1)}
        used = packing.best_fill(counts, room)
        assert sum(n * k for n, k in used.items()) == max(s for s in reach if s <= room)
        assert all(0 < k <= counts[n] for n, k in used.items())


def test_plan_places_every_rank_once():
    histogram = {5: 7, 64: 3, 33: 10, 1: 4, 31: 9}
    seen, fill = defaultdict(list), defaultdict(list)
    for s in packing.plan(histogram, 64):
        for r in range(s.rank_from, s.rank_to):
            turn = r - s.rank_from
            seen[s.length].append(r)
            fill[s.first_sequence + turn // s.per_sequence].append((s.offset + turn % s.per_sequence * s.length, s.length))
    assert {n: sorted(r) for n, r in seen.items()} == {n: list(range(c)) for n, c in histogram.items()}
    for parts in fill.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 64
    assert sorted(fill) == list(range(len(fill)))
    assert packing.plan({}, 64) == []
    with pytest.raises(ValueError):
        packing.plan({65: 1}, 64)


def check(pieces, docs, capacity, max_padding):
    ids = defaultdict(list)
    for (doc, _), coded in zip(docs, plain_ids([t for _, t in docs])):
        ids[doc].append(coded)
    want = sorted((repr(d), i, min(capacity, len(c) - i), zlib.crc32(np.array(c[i:i + capacity], "<u4").tobytes()), len(c))
                  for d, cs in ids.items() for c in cs for i in range(0, len(c), capacity))
    rows = pieces.collect()
    assert sorted((repr(r.doc_id), r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows) == want
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    padding = 0
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= capacity
        padding += 0 if at & (at - 1) == 0 else capacity - at
    assert padding <= max_padding


@pytest.mark.parametrize("slice_rows", [packing.SLICE_ROWS, 3])
def test_documents_are_packed_whole(spark, docs_of, monkeypatch, slice_rows):
    monkeypatch.setattr(packing.pack, "__defaults__", ("length", packing.CAPACITY, slice_rows))
    docs = [(i, t) for i, t in enumerate(ODD)] + [(100, None), (101, "word " * 9_000), (None, "no id")]
    docs += [(200 + i % 20, "same copy of a text " * 20) for i in range(40)]
    check(packing.pack_documents(docs_of(docs), vocabulary_path(), capacity=256), docs, 256, 1024)


def test_whole_table(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    check(packing.pack_documents(docs, vocabulary_path()), [(r.doc_id, r.text) for r in docs.collect()], 2048, 4096)


def test_kept_ids_and_empty_table(spark, docs_of):
    docs = [(1, "some words " * 60), (2, "")]
    rows = packing.pack_documents(docs_of(docs), vocabulary_path(), capacity=64, keep_ids=True).collect()
    whole = {d: c for (d, _), c in zip(docs, plain_ids([t for _, t in docs]))}
    for r in rows:
        assert r.ids == whole[r.doc_id][r.start:r.start + r.length]
    assert packing.pack_documents(docs_of([]), vocabulary_path()).count() == 0
