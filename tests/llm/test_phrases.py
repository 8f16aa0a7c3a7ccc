import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratus.llm import phrases as P


def brute(rows, min_count, top, max_words=5, covered=100):
    counts, total = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for k in range(1, max_words + 1):
                counts.update((lang, tuple(words[i:i + k])) for i in range(len(words) - k + 1))
    cands = {x: f for x, f in counts.items() if len(x[1]) > 1 and f >= min_count}
    out = {}
    for (lang, g), a in cands.items():
        if any(o == lang and len(b) > len(g) and 100 * f >= covered * a
               and any(b[i:i + len(g)] == g for i in range(len(b))) for (o, b), f in cands.items()):
            continue
        cuts = [(1000 * a * total[lang] // (counts[lang, g[:k]] * counts[lang, g[k:]]), k) for k in range(1, len(g))]
        score, k = min(cuts)
        out.setdefault(lang, []).append((" ".join(g), a, counts[lang, g[:k]], counts[lang, g[k:]], total[lang], score))
    rows = []
    for lang, found in out.items():
        found.sort(key=lambda x: (-x[5], -x[1], x[0].encode()))
        rows += [(lang, i + 1, *x) for i, x in enumerate(found[:top])]
    return sorted(rows)


def frame(spark, rows):
    return spark.createDataFrame([(t, lang) for lang, t in rows], "text string, lang string")


def random_rows(seed, n=60):
    rng = np.random.default_rng(seed)
    words = ["the", "The", "of", "a", "é", "ß x", "to-day", "x" * 90, "in", "it"]
    marks = [" ", " ", " ", "  ", "\t", " ", ", ", ".", "\n", "; ", "\x0b"]
    return [(["en", "de", None, "und"][rng.integers(4)],
             "".join(words[rng.integers(len(words))] + marks[rng.integers(len(marks))] for _ in range(rng.integers(120))))
            for _ in range(n)]


@pytest.mark.parametrize("seed,covered,block", [(0, 100, 1 << 20), (1, 60, 300)])
def test_equals_counting_everything(spark, seed, covered, block):
    rows = random_rows(seed)
    out = P.collocations(frame(spark, rows), min_count=4, top=25, covered_percent=covered, block_bytes=block)
    assert sorted(map(tuple, out.collect())) == brute(rows, 4, 25, covered=covered)


def test_a_tiny_bitmap_changes_nothing(spark, monkeypatch):
    monkeypatch.setattr(P, "MAX_BITS", 1)
    monkeypatch.setattr(P, "BITS_PER_PHRASE", 1)
    rows = random_rows(2, 30)
    rows += [("en", f"w{i} w{i + 1} w{i}") for i in range(300)]
    out = P.collocations(frame(spark, rows), min_count=3, top=50)
    assert sorted(map(tuple, out.collect())) == brute(rows, 3, 50)


def test_words_that_share_a_hash_are_hashed_anew(spark, monkeypatch):
    rows = [("en", "red fox. blue fox. red fox. blue dog")] * 3
    out = P.collocations(frame(spark, rows), min_count=3)
    seeds = []
    real = P._occurrences

    def clashing(docs, seed, size):
        seeds.append(seed)
        made = real(docs, seed, size)
        if seed == 1:
            # every word of every block gets the same key
            return made.withColumn("keys", F.expr("unhex(repeat('0000000000000001', cast(octet_length(keys) / 8 as int)))"))
        return made
    monkeypatch.setattr(P, "_occurrences", clashing)
    assert P.collocations(frame(spark, rows), min_count=3).collect() == out.collect() != []
    assert seeds == [1, 2]


def test_defined_cases(spark):
    long = "big text " * 60_000 + "end"
    rows = [(None, None), ("en", ""), ("en", " \t.,"), ("en", long), ("und", "big text"), (None, "big text"), ("en", "same row"),
            ("en", "same row")]
    docs = frame(spark, rows)
    for c in ("key", "n", "h", "groups", "rank", "score", "a", "l", "r", "word", "words"):
        docs = docs.withColumn(c, F.lit(None).cast("int"))
    out = sorted(map(tuple, P.collocations(docs, min_count=2).collect()))
    assert out == brute(rows, 2, 2000)
    assert P.collocations(docs.limit(0)).collect() == []


def test_rows_counted_by_keys_grow_with_the_input(spark, monkeypatch):
    # Pairs are frequent in the larger corpus only; all words are in both.
    rng = np.random.default_rng(5)
    rows = [("en", " ".join(f"w{i}" for i in rng.integers(10, size=50))) for _ in range(40)]
    found = []
    real = type(frame(spark, rows)).mapInArrow

    def kept(df, function, schema):
        out = real(df, function, schema)
        if "key binary" in schema:
            found.append(out.count())
        return out
    monkeypatch.setattr(type(frame(spark, rows)), "mapInArrow", kept)
    made = []
    for copies in (1, 5):
        found.clear()
        out = P.collocations(frame(spark, rows * copies), min_count=50, max_words=2, block_bytes=1000)
        assert sorted(map(tuple, out.collect())) == brute(rows * copies, 50, 2000, max_words=2)
        made.append(sum(found))
    assert 0 < made[1] <= 6 * made[0]


def test_hash_of_a_key_is_the_blocks_hash(spark):
    rng = np.random.default_rng(6)
    hashes = rng.integers(0, 1 << 64, 9, dtype=np.uint64)
    hashes[:2] = 0, (1 << 64) - 1
    for width in range(1, 8):
        phrases = rng.integers(0, 9, (width, 30))
        keys = P._key_array(hashes[phrases].T).to_pylist()
        df = spark.createDataFrame([(i, "en", bytearray(k)) for i, k in enumerate(keys)], "i int, lang string, key binary")
        got = df.select("i", P._hash_of(F.col("lang"), F.col("key"), width).alias("h")).orderBy("i").collect()
        assert [r.h for r in got] == P._key_hash(hashes, phrases, P._lang_salt("en")).view(np.int64).tolist()
