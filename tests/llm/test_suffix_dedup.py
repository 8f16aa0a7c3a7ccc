import hashlib
import random

import numpy as np
import pytest

from stratus.llm import blocks
from stratus.llm import suffix_dedup as S


def brute(docs, width=50):
    first = {}
    for d, t in sorted((x for x in docs if x[0] is not None), key=lambda x: x[0]):
        b = (t or "").encode()
        for i in range(len(b) - width + 1):
            first.setdefault(b[i:i + width], d)
    out = []
    for d, t in docs:
        b = (t or "").encode()
        cover = bytearray(len(b))
        for i in range(len(b) - width + 1 if d is not None else 0):
            if first[b[i:i + width]] < d:
                cover[i:i + width] = b"\x01" * width
        kept = bytes(x for x, c in zip(b, cover) if not c)
        spans = sum(1 for i in range(len(b)) if cover[i] and (i == 0 or not cover[i - 1]))
        out.append((d, len(b), sum(cover), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def result(docs, **options):
    return sorted((tuple(r) for r in S.remove_repeats(docs, **options).collect()), key=repr)


def some_docs():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdé ") for _ in range(rng.randrange(2, 9)))
    shared = [" ".join(word() for _ in range(30)) for _ in range(4)]
    out = [(0, None), (1, ""), (2, "a" * 49), (3, "a" * 50), (4, "a" * 200), (5, "a" * 51 + "b"), (6, "ab" * 60), (7, "ba" * 60),
           (None, shared[0]), (8, shared[0]), (8, shared[0] + "x"), (9, "y" + shared[0]), (9, "y" + shared[0])]
    for i in range(10, 60):
        text = " ".join(word() for _ in range(rng.randrange(5, 60)))
        for _ in range(rng.randrange(3)):
            s = rng.choice(shared)
            a = rng.randrange(0, 40)
            at = rng.randrange(len(text))
            text = text[:at] + s[a:a + rng.randrange(40, 120)] + text[at:]
        out.append((i, text))
    out += [(60 + i, shared[3]) for i in range(20)]
    out.append((90, shared[1] * 600))
    return out


@pytest.mark.parametrize("options", [{}, {"chunk_bytes": 2_000, "bucket_bytes": 3_000}, {"width": 20, "gram": 9},
                                     {"chunk_bytes": 2_000, "bucket_bytes": 3_000, "hot_chunks": 2, "sort_windows": 40}])
def test_equals_brute_force(spark, docs_of, options):
    docs = some_docs()
    assert result(docs_of(docs), **options) == brute(docs, options.get("width", 50))


def test_whole_table_in_many_chunks(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    assert result(docs, chunk_bytes=60_000, bucket_bytes=100_000) == want


def test_empty_table(spark, docs_of):
    assert result(docs_of([])) == []


def test_kept_bytes(spark, docs_of):
    docs = docs_of([(1, "x" * 60), (2, "ab" + "x" * 55 + "é")])
    kept = {r.doc_id: bytes(r.kept) for r in S.remove_repeats(docs, keep_text=True).collect()}
    assert kept == {1: b"x" * 60, 2: "abé".encode()}


def test_suffix_order_equals_sorting_the_bytes():
    rng = random.Random(4)
    raw = np.frombuffer(bytes(rng.choice(b"ab") for _ in range(2_000)), np.uint8)
    starts = np.array(rng.sample(range(1_950), 700))
    groups = np.sort(np.array([rng.randrange(9) for _ in starts]))
    order, equal = S.SuffixOrder(raw, blocks.PrefixHash(raw, blocks.Powers()), 50).verified(starts, groups)
    text = lambda k: (groups[k], raw[starts[k]:starts[k] + 50].tobytes())
    assert [text(k) for k in order] == sorted(text(k) for k in range(len(starts)))
    assert equal.tolist() == [False] + [text(a) == text(b) for a, b in zip(order[:-1], order[1:])]


def test_colliding_hashes_fall_back_to_the_bytes(monkeypatch):
    raw = np.frombuffer(b"abcabdabcabe" * 20, np.uint8)
    starts, groups = np.arange(0, 180, 3), np.zeros(60, np.int64)
    order_of = S.SuffixOrder(raw, blocks.PrefixHash(raw, blocks.Powers()), 50)
    monkeypatch.setattr(order_of, "common", lambda x, y: np.full(len(x), 50))
    order, equal = order_of.verified(starts, groups)
    texts = [raw[starts[k]:starts[k] + 50].tobytes() for k in order]
    assert texts == sorted(texts) and equal.sum() == len(texts) - len(set(texts))


def test_few_long_documents_that_share_a_templated_line(spark, docs_of):
    rng = random.Random(5)
    line = lambda: f"{rng.randrange(10 ** 6)} the request was answered within the time of {rng.randrange(50)} ms\n"
    docs = [(i, "".join(line() for _ in range(120))) for i in range(4)]
    options = {"chunk_bytes": 4_000, "bucket_bytes": 4_000, "hot_bytes": 2_000}
    assert result(docs_of(docs), **options) == brute(docs)


def test_an_anchor_is_hot_by_what_it_sends():
    anchors = np.repeat(np.arange(1, 4, dtype=np.uint64), (1, 40, 70_000))
    texts = np.concatenate([[0], np.arange(40), np.zeros(70_000)]).astype(np.uint64)
    keys, loads = S.anchor_loads(anchors, texts)
    assert keys.tolist() == [1, 2, 3] and loads.tolist() == [1, 45, 1 + 70_000 // 8]
    blob = keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()
    table = S.pa.table({"bucket": [0, 0], "chunk": [0, 1], "anchors": [blob, blob], "loads": [loads.tobytes()] * 2})
    bits = lambda name, limit: [list(np.unpackbits(np.frombuffer(b, np.uint8))[:3])
                                for b in S._marks(table, 1_000, limit).column(name).to_pylist()]
    assert bits("shared", 89) == [[1, 1, 1]] * 2 and bits("hot", 89) == [[0, 1, 1]] * 2 and bits("hot", 90) == [[0, 0, 1]] * 2


def packed(docs):
    """A chunk's rows as the shuffle brings them."""
    ids, texts = zip(*docs)
    batch = S.pa.RecordBatch.from_arrays([S.pa.array(ids, S.pa.int64()), S.pa.array(texts), S.pa.array(ids, S.pa.int64()),
                                          S.pa.array([0] * len(ids), S.pa.int64())], ["doc_id", "text", "row_key", "chunk"])
    return S.pa.Table.from_batches(list(S._pack([batch])))


def sent(*chunks):
    """Bytes of text that each of the chunks sends to a single bucket."""
    key = lambda i: (S.pa.scalar(i, S.pa.int64()),)
    anchors = S.pa.concat_tables([S._emit_anchors(1, 50, 16)(key(i), packed(c)) for i, c in enumerate(chunks)])
    marks = S._mark_shared(None, 10 ** 6)(anchors)
    out = []
    for i, c in enumerate(chunks):
        mine = marks.filter(S.pa.compute.equal(marks["chunk"], i))
        rows = S._emit_contexts(1, 50, 16)(key(i), packed(c), mine)
        out.append(len(S._contexts(rows)[0]) if rows.num_rows else 0)
    return out


def test_strings_that_are_met_by_chance_send_no_text():
    import pyarrow.compute  # noqa: F401
    rng = random.Random(6)
    own = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(34))
    phrases = ["".join(rng.choice("qrstuvwxyz ") for _ in range(30)) for _ in range(20)]
    text = lambda: "".join(own() + rng.choice(phrases) for _ in range(200))
    a, b = text(), text()
    shared = {a[i:i + 16] for i in range(len(a) - 15)} & {b[i:i + 16] for i in range(len(b) - 15)}
    assert len(shared) > 200  # anchors are met again, windows are not
    assert sent([(1, a)], [(2, b)]) == [0, 0]
    passage = own() + own() + own()
    found = sent([(1, a + passage)], [(2, passage + b)])
    assert 2 * len(passage) < min(found) and max(found) < 6 * len(passage)


def test_an_anchor_is_not_hot_because_many_chunks_have_it():
    n = 3_000
    blob = np.array([7], "<u4").tobytes()
    table = S.pa.table({"bucket": [0] * n, "chunk": list(range(n)), "anchors": [blob] * n,
                        "loads": [np.array([1], "<u2").tobytes()] * n})
    marks = lambda load: set(S._mark_shared(None, load)(table).column("hot").to_pylist())
    assert marks(n) == {b"\x00"} and marks(n - 1) == {b"\x80"}


def test_the_keys_of_an_anchor_are_hot_together():
    values = (np.array([5, 5, 6], np.uint64) << np.uint64(20)) | np.array([1, 2, 3], np.uint64)
    table = S.pa.table({"bucket": [0, 0], "chunk": [0, 1], "anchors": [values.astype("<u4").tobytes()] * 2,
                        "loads": [np.array([30, 30, 40], "<u2").tobytes()] * 2})
    hot = lambda load: list(np.unpackbits(np.frombuffer(S._mark_shared(None, load)(table).column("hot")[0].as_py(), np.uint8))[:3])
    assert hot(100) == [1, 1, 0] and hot(120) == [0, 0, 0]


def test_a_bucket_in_lots(spark, docs_of):
    docs = some_docs()
    assert result(docs_of(docs), lot_bytes=700) == brute(docs)


def test_a_run_that_segments_cut(monkeypatch):
    monkeypatch.setattr(S, "_SEGMENT", 7)
    docs = [(i, t) for i, t in some_docs()[:40] if i is not None and t]
    chunk = S._Chunk(packed(docs))
    anchor, key, text, at, first, last, doc = chunk.runs(blocks.Powers(), 50, 16)
    seen = sorted((int(d), w) for d, a, b in zip(doc, first, last) for w in range(a, b + 1))
    starts = chunk.offsets
    assert seen == sorted((d, w) for d in range(len(starts) - 1) for w in range(starts[d], starts[d + 1] - 49))
    assert sum(sent(docs)) > 0
