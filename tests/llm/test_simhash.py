import random
import re

import numpy as np
import pytest
import xxhash

from stratus.llm import simhash as H

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_print(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    grams = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else ([" ".join(w)] if w else [])
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hs) > len(hs))


def brute(docs):
    prints = [(d, brute_print(t)) for d, t in docs]
    parent = list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i in range(len(docs)):
        for j in range(i):
            if bin(prints[i][1] ^ prints[j][1]).count("1") <= 3:
                parent[find(i)] = find(j)
    first = {}
    for i, (d, _) in enumerate(prints):
        r = find(i)
        first[r] = d if first.get(r) is None else (first[r] if d is None else min(first[r], d))
    return sorted(((d, f"{p:016x}", first[find(i)]) for i, (d, p) in enumerate(prints)), key=repr)


def some_docs():
    rng = random.Random(1)
    vocab = [f"w{i}" for i in range(50)]
    out = [(0, None), (1, ""), (2, " \t\n"), (3, "one"), (4, "One"), (5, "one two"), (6, "a b c"), (7, "a\x0bb c"), (7, "a b c"),
           (8, "É é x y"), (None, "lone text here"), (9, "lone text here")]
    for i in range(10, 60):
        out.append((i, " ".join(rng.choice(vocab) for _ in range(400))))
    for i in range(60, 90):  # near copies
        w = out[12 + i % 7][1].split()
        w[rng.randrange(len(w))] = "changed"
        out.append((i, " ".join(w)))
    out.append((95, "long " * 60_000))
    return out


@pytest.mark.parametrize("max_bucket", [H.MAX_BUCKET, 1])
def test_groups_equal_brute_force(spark, docs_of, max_bucket):
    docs = some_docs()
    got = H.near_duplicates(docs_of(docs), max_bucket=max_bucket).select("doc_id", "fingerprint", "component_id")
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(docs)


def test_trie_links_connect_all_close_pairs():
    rng = random.Random(2)
    base = [rng.getrandbits(64) for _ in range(40)]
    prints = set(base)
    for b in base:
        for _ in range(6):
            x = b
            for _ in range(rng.randrange(6)):
                x ^= 1 << rng.randrange(64)
            prints.add(x)
    prints = sorted(prints)
    u, v = H.trie_links(np.zeros(len(prints), np.int64), np.array(prints, np.uint64), 3, frontier=50)
    group = {p: p for p in prints}

    def find(x):
        while group[x] != x:
            x = group[x]
        return x
    for a, b in zip(u.tolist(), v.tolist()):
        group[find(a)] = find(b)
    want = {p: p for p in prints}

    def root(x):
        while want[x] != x:
            x = want[x]
        return x
    for i, a in enumerate(prints):
        for b in prints[:i]:
            if bin(a ^ b).count("1") <= 3:
                want[root(a)] = root(b)
    for i, a in enumerate(prints):
        for b in prints[:i]:
            assert (find(a) == find(b)) == (root(a) == root(b))


def test_keep_first(spark, docs_of):
    docs = some_docs()
    want = {c for _, _, c in brute([d for d in docs if d[0] is not None])}
    kept = H.keep_first(docs_of(docs))
    assert sorted(r.doc_id for r in kept.where("doc_id IS NOT NULL").collect()) == sorted(want)
    assert kept.where("doc_id IS NULL").count() == 1 and kept.columns == docs_of(docs).columns


def test_empty_table(spark, docs_of):
    assert H.near_duplicates(docs_of([])).count() == 0
