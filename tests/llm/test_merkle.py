import hashlib
import zlib

import pytest

from stratus.llm import merkle as M

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    values = (row[0], row[3], row[2], row[4], text)
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def tree(nodes):
    """The root and, per leaf, its steps ``(place, run)`` up to it."""
    paths = [[] for _ in nodes]
    under = [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        runs = [nodes[i:i + 3] for i in range(0, len(nodes), 3)]
        for r, run in enumerate(runs):
            for place in range(len(run)):
                for i in under[3 * r + place]:
                    paths[i].append((place, run))
        under = [sum(under[i:i + 3], []) for i in range(0, len(under), 3)]
        nodes = [h(*run) for run in runs]
    return nodes[0], paths


def brute(rows):
    seen = []
    for r in rows:
        even = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
        text = r[1].replace("\n", "") if even and r[1] is not None else r[1]
        seen.append((r, leaf(r, r[1]), leaf(r, text)))
    groups = {}
    for x in seen:
        groups.setdefault(x[0][3], []).append(x)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for g in groups:
        groups[g].sort(key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1], x[2]))
    subs = [tree([x[1] for x in groups[g]]) for g in order]
    root, upper = tree([s for s, _ in subs])
    out = []
    for (sub, paths), above, g in zip(subs, upper, order):
        for (row, own, met), path in zip(groups[g], paths):
            proof, folded = "", met
            for place, run in path + above:
                proof += "".join(run[:place] + run[place + 1:])
                folded = h(*run[:place], folded, *run[place + 1:])
            out.append((row[0], own, sub, root, h(proof), folded, folded == root))
    return sorted(out, key=repr)


def found(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA)
    from pyspark.sql import functions as F
    return M.manifest(docs, M.without_line_feeds(F.col("doc_id"), F.col("text")))


def rows_of(sizes):
    out, doc = [], 0
    for g, n in sizes.items():
        for _ in range(n):
            out.append((doc, f"line {doc}\nmore" if doc % 3 else "one line", "en", g, doc * 7))
            doc += 1
    return out


@pytest.mark.parametrize("sizes", [
    {"a": 1}, {"a": 3}, {"a": 4}, {"a": 244, "b": 1, "c": 243}, {"a": 800, None: 2, "é": 9, "Z": 1, "b": 27},
    {f"s{i}": 1 for i in range(10)}, {f"s{i}": 1 + i % 3 for i in range(260)},
])
def test_equals_plain_trees(spark, sizes):
    rows = rows_of(sizes)
    assert sorted(map(tuple, found(spark, rows).collect()), key=repr) == brute(rows)


def test_nulls_repeats_long_texts_and_clashing_columns(spark):
    rows = [(None, "a\nb", None, "s", None), (None, None, "en", None, 0), (7, None, None, None, None),
            (7, "", "en", "s", 0), (7, "x\ny", "en", "s", 3), (7, "x\ny", "en", "s", 3), (8, "é\n" * 200_000, "de", "", 1)]
    rows += [(9, f"t{i}\n", "en", "hot", i) for i in range(40)]
    docs = spark.createDataFrame(rows, SCHEMA)
    from pyspark.sql import functions as F
    for c in ("slot", "n", "tree", "level", "digest", "row", "key", "group", "root", "leaf"):
        docs = docs.withColumn(c, F.lit("x"))
    out = M.manifest(docs, M.without_line_feeds(F.col("doc_id"), F.col("text")))
    assert sorted(map(tuple, out.collect()), key=repr) == brute(rows)
    assert out.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def test_empty_table(spark):
    assert found(spark, []).collect() == []


def test_untampered_rows_verify(spark):
    docs = spark.createDataFrame(rows_of({"a": 50, "b": 2}), SCHEMA)
    assert all(r.verified for r in M.manifest(docs).collect())
