import hashlib
import re

from stratus.llm import decontaminate as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(t):
    return WORD.findall((t or "").translate(LOWER))


def brute(docs, items, width=13):
    grams = {}
    for item, text in items:
        w = words(text)
        n = min(len(w), width)
        for i in range(len(w) - n + 1 if n else 0):
            grams.setdefault(tuple(w[i:i + n]), set()).add(item)
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(g) for g in grams}:
            for i in range(len(w) - n + 1):
                if tuple(w[i:i + n]) in grams:
                    hit |= set(range(i, i + n))
                    found |= grams[tuple(w[i:i + n])]
        ids = sorted(str(x) for x in found if x is not None)
        out.append((doc, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(),
                    bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


LONG = " ".join(f"w{i}" for i in range(30))
ITEMS = [(1, LONG), (2, "Short Item"), (3, None), (4, ""), (5, LONG), (10, "é ß2 x"), (None, "lone words here"), (2, "short item")]
DOCS = [(1, "before " + LONG.upper() + " after"), (2, "a short, ITEM! b"), (3, None), (4, ""), (5, "..."),
        (6, "clean " * 100 + " short item"), (7, LONG[:40]), (8, " ".join(LONG.split()[3:16])), (9, "É ß2 x é ß2 x"),
        (10, "see lone words here"), (10, "see lone words here"), (None, "short item"),
        (11, ("pad " * 50_000) + LONG), (12, "short"), (13, "item")]


def run(spark, docs_of, docs, items, **kw):
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    rows = D.digest(D.scan(docs_of(docs), bench, **kw)).collect()
    return sorted((tuple(r) for r in rows), key=repr)


def test_scan_equals_brute_force(spark, docs_of):
    assert run(spark, docs_of, DOCS, ITEMS) == brute(DOCS, ITEMS)


def test_blocks_of_a_large_benchmark_give_the_same(spark, docs_of):
    assert run(spark, docs_of, DOCS, ITEMS, max_block_chars=20) == brute(DOCS, ITEMS)


def test_empty_tables(spark, docs_of):
    assert run(spark, docs_of, [], ITEMS) == []
    assert run(spark, docs_of, DOCS, []) == brute(DOCS, [])


def test_whole_tables_equal_brute_force(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    bench = spark.read.parquet(f"{sf_small}/benchmark.parquet")
    got = sorted((tuple(r) for r in D.digest(D.scan(docs, bench)).collect()), key=repr)
    plain = lambda df, *c: [tuple(r) for r in df.select(*c).collect()]
    assert got == brute(plain(docs, "doc_id", "text"), plain(bench, "item_id", "text"))


def test_removal_keeps_columns_and_clean_rows(spark, docs_of):
    bench = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    docs = docs_of(DOCS).selectExpr("*", "'x' AS n_words", "1 AS contaminated")
    kept = D.remove_documents(docs, bench)
    assert kept.columns == docs.columns
    dirty = {r[0] for r in brute(DOCS, ITEMS) if r[5]}
    assert sorted(r[0] for r in kept.select("doc_id").collect()) == sorted(i for i, _ in DOCS if i not in dirty)
    cut = {r.doc_id: r.text for r in D.remove_spans(docs, bench).collect()}
    assert cut[2] == "a ! b" and cut[1] == "before  after" and cut[4] == "" and cut[3] is None
