"""Merkle manifest of a dataset, with a proof for every row.

Every row is hashed to a leaf. The leaves of a group, in order, are the lowest
level of the group's tree: every run of three neighbours is hashed to their
parent until one node is left, the group's root. The group roots, in the order
of the groups, are hashed the same way to the root of the dataset.

Proofs come from pointer jumping. Each node holds a pointer to an ancestor and
the segment of sibling steps up to it, at first its parent and one step. A
round joins the nodes with themselves on the pointer: a node takes over the
pointer of its ancestor and appends the ancestor's segment, so the distance
doubles and a tree of n leaves needs about log2(log3 n) rounds.

Ranks within a group come from one range partitioning by (group, key) and the
counts of its partitions, and runs are gathered in blocks of 243 neighbours, so
neither a group that holds a third of all rows nor one source in all is one
task. A step holds its siblings as bytes; hashes take digests as hex text.

Defined cases: a null field is ``-``; rows whose key repeats are ordered by
their leaf, exact repeats are leaves of their own; a null group is a group, the
first one; a null key is never tampered with; an empty table gives no rows.
Columns that are not among the hashed ones are left out.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stage import drop, staged

#: Children of a node.
FAN_OUT = 3
#: Levels that one shuffle builds: a block holds FAN_OUT ** LEVELS neighbours.
LEVELS = 5
#: The tree over the group roots.
TOP = -1
#: Partition number and row within it in monotonically_increasing_id.
_ROW_BITS = 33

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

_STEP = "struct<place:int,others:binary>"
RESULT = ("doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string,"
          " verified boolean")


def field_text(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(*values: Column) -> Column:
    return F.sha2(F.concat(*[field_text(v) for v in values]), 256)


def _hex(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def _joined(digests: Column) -> Column:
    return F.array_join(F.transform(digests, _hex), "")


def ranked(rows: DataFrame, group: list[str], order: list[str], tag: str) -> DataFrame:
    """Staged ``rows`` with ``slot``, the rank from 0 within the group, and ``n``, the group's size.

    The rows are range-partitioned once; a row's rank is its place in its
    partition plus the group's rows in earlier partitions.
    """
    by = [*group, *order]
    laid = staged(rows.repartitionByRange(*by).sortWithinPartitions(*by)
                  .withColumn("__at", F.monotonically_increasing_id()), tag)
    part = F.shiftright("__at", _ROW_BITS)
    counts = laid.groupBy(*group, part.alias("__part")).agg(F.count("*").alias("__n"), F.min("__at").alias("__first"))
    earlier = Window.partitionBy(*group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    runs = counts.select(
        *[F.col(c).alias(f"__g_{c}") for c in group], "__part", "__first",
        F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"),
        F.sum("__n").over(Window.partitionBy(*group)).alias("n"))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__g_{c}")) for c in group],
                  part == F.col("__part"))
    out = laid.join(runs, same).withColumn("slot", F.col("__at") - F.col("__first") + F.col("__before"))
    return out.drop("__at", "__part", "__first", "__before", *[f"__g_{c}" for c in group])


def height(n: Column) -> Column:
    """Levels above the leaves of a tree of ``n`` leaves."""
    return F.size(F.filter(F.array(*[F.lit(FAN_OUT ** i) for i in range(39)]), lambda p: p < n))


def _joined_sql(digests: str) -> str:
    return f"array_join(transform({digests}, x -> lower(hex(x))), '')"


def _parents(digests: str) -> str:
    """SQL: the level above, one hash per run."""
    run = _joined_sql(f"slice({digests}, i * {FAN_OUT} + 1, {FAN_OUT})")
    runs = f"sequence(0, cast((size({digests}) - 1) div {FAN_OUT} as int))"
    return f"transform({runs}, i -> unhex(sha2({run}, 256)))"


def _step(digests: str) -> str:
    """SQL: the place of digest ``i`` in its run and the run's other digests, joined."""
    left = _joined_sql(f"slice({digests}, i - i % {FAN_OUT} + 1, i % {FAN_OUT})")
    right = _joined_sql(f"slice({digests}, i + 2, {FAN_OUT - 1} - i % {FAN_OUT})")
    return f"named_struct('place', cast(i % {FAN_OUT} as int), 'others', unhex(concat({left}, {right})))"


def build(leaves: DataFrame, tallest: int, tag: str) -> list[DataFrame]:
    """Staged nodes ``(tree, level, slot, n, tall, digest, step, row)`` by block of levels.

    ``leaves``: ``(tree, slot, n, digest, row)``; ``row`` is carried along the
    lowest level only. ``tall`` is the height of the tree, ``step`` null at its top.
    """
    size = FAN_OUT ** LEVELS
    base = leaves.withColumn("tall", height(F.col("n")))
    row_type = leaves.schema["row"].dataType.simpleString()
    out = []
    for low in range(0, max(tallest, 1), LEVELS):
        held = F.array_sort(F.collect_list(F.struct("slot", "digest", "row")))
        blocks = base.groupBy("tree", "n", "tall", F.floor(F.col("slot") / size).alias("block")).agg(held.alias("held"))
        blocks = blocks.withColumn("d0", F.col("held.digest"))
        for j in range(LEVELS):
            blocks = blocks.withColumn(f"d{j + 1}", F.expr(f"case when tall > {low + j} then {_parents(f'd{j}')} end"))
        levels = ", ".join(_listed(low, j, row_type) for j in range(LEVELS + 1))
        nodes = blocks.select("tree", "n", "tall", F.expr(f"explode(concat({levels})) as x")).select("tree", "n", "tall", "x.*")
        table = staged(nodes, f"{tag}-{low}")
        edge = F.col("level") == low + LEVELS
        out.append(table.where(~edge | (F.col("tall") == F.col("level"))))
        base = table.where(edge & (F.col("tall") > F.col("level"))).select("tree", "n", "tall", "slot", "digest", "row")
    return out


def _listed(low: int, j: int, row_type: str) -> str:
    """SQL: the nodes of level ``low + j`` of a block; none beyond the top of its tree.

    A block's upper edge has no steps yet: it opens the next block.
    """
    step = f"case when tall > {low + j} then {_step(f'd{j}')} end" if j < LEVELS else "null"
    row = "held[i].row" if j == 0 else "null"
    node = (f"named_struct('level', {low + j}, 'slot', block * {FAN_OUT ** (LEVELS - j)} + i, 'digest', d,"
            f" 'step', {step}, 'row', {row})")
    kind = f"array<struct<level:int,slot:bigint,digest:binary,step:{_STEP},row:{row_type}>>"
    return (f"case when tall >= {low + j} then cast(transform(d{j}, (d, i) -> {node}) as {kind})"
            f" else cast(array() as {kind}) end")


def _pointers(nodes: DataFrame, tallest_top: int) -> DataFrame:
    """A node's pointer and segment before the first round: its parent, one step.

    The top of a group's tree is a leaf of the tree over the groups; a lone
    leaf is that itself, with no step. The pointer to the dataset's root is null.
    """
    in_top, level = F.col("tree") == TOP, F.col("level")
    above = F.when(in_top & (level + 1 < F.col("tall")), F.lit(TOP)).when(
        ~in_top & (level + 1 < F.col("tall")), F.col("tree")).when(~in_top & F.lit(tallest_top > 0), F.lit(TOP))
    inner = level + 1 < F.col("tall")
    return nodes.select(
        "tree", "level", "slot", "tall", "digest", "row",
        F.when(F.col("step").isNull(), F.array().cast(f"array<{_STEP}>")).otherwise(F.array("step")).alias("steps"),
        above.cast("bigint").alias("to_tree"),
        F.when(inner, level + 1).otherwise(0).alias("to_level"),
        F.when(inner, F.floor(F.col("slot") / FAN_OUT)).otherwise(F.col("tree")).cast("bigint").alias("to_slot"))


def _jump(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """Each row's pointer and segment after one round; rows at the root stay as they are."""
    there = targets.select(F.col("tree").alias("to_tree"), F.col("level").alias("to_level"),
                           F.col("slot").alias("to_slot"), F.col("steps").alias("__steps"),
                           F.struct("to_tree", "to_level", "to_slot").alias("__to"))
    moved = rows.where(F.col("to_tree").isNotNull()).join(there, ["to_tree", "to_level", "to_slot"])
    moved = moved.withColumn("steps", F.concat("steps", "__steps")).withColumns(
        {c: F.col(f"__to.{c}") for c in ("to_tree", "to_level", "to_slot")})
    return rows.where(F.col("to_tree").isNull()).unionByName(moved.select(*rows.columns))


def fold(digest: Column, steps: Column) -> Column:
    """The hash at the end of a segment, from the hash at its start (hex text)."""
    def up(below: Column, step: Column) -> Column:
        others, cut = _hex(step["others"]), step["place"] * 64
        return F.sha2(F.concat(F.substring(others, F.lit(1), cut), below,
                               F.substring(others, cut + 1, F.lit(64 * FAN_OUT))), 256)
    return F.aggregate(steps, digest, up)


def manifest(docs: DataFrame, seen_text: Column | None = None, group: str = "source", key: str = "doc_id") -> DataFrame:
    """Per row its leaf, group root, root, proof digest and the check of the proof.

    ``seen_text`` is the text that the check meets in place of the row's own
    one: the root is folded from its leaf and the siblings of the manifest.
    """
    spark = docs.sparkSession
    rows = docs.select(*FIELDS, (F.col("text") if seen_text is None else seen_text).alias("__seen"))
    given = [F.col(c) for c in FIELDS]
    leaves = staged(rows.select(
        F.col(key).alias("key"), F.col(group).alias("group"), F.unhex(leaf_hash(*given)).alias("digest"),
        F.unhex(leaf_hash(*given[:-1], F.col("__seen"))).alias("seen")), "merkle-leaves")
    laid = ranked(leaves, ["group"], ["key", "digest", "seen"], "merkle-ranked")
    sizes = staged(laid.groupBy("group").agg(F.max("n").alias("size")), "merkle-groups")
    widest, n_groups = sizes.agg(F.max("size"), F.count("*")).first()
    if not n_groups:
        return spark.createDataFrame([], RESULT)
    levels = lambda n: next(i for i in range(40) if FAN_OUT ** i >= n)
    tall, tall_top = levels(widest), levels(n_groups)
    trees = ranked(sizes.withColumn("all", F.lit(0)), ["all"], ["group"], "merkle-trees").select(
        F.col("group").alias("__group"), F.col("slot").alias("tree"))
    placed = laid.join(trees, F.col("group").eqNullSafe(F.col("__group"))).select(
        "tree", "slot", "n", "digest", F.struct("key", "seen").alias("row"))

    parts = build(placed, tall, "merkle-nodes")
    nodes = reduce(DataFrame.unionByName, parts)
    tops = nodes.where(F.col("level") == F.col("tall")).select(
        F.lit(TOP).cast("bigint").alias("tree"), F.col("tree").alias("slot"), F.lit(n_groups).cast("bigint").alias("n"),
        "digest", F.lit(None).cast("int").alias("row"))
    upper = reduce(DataFrame.unionByName, build(tops, tall_top, "merkle-top"))
    root = upper.where(F.col("level") == tall_top).select(_hex(F.col("digest"))).first()[0]

    inner = nodes.where((F.col("level") > 0) & (F.col("level") < F.col("tall"))).drop("row").unionByName(
        upper.where(F.col("level") < F.col("tall")).drop("row"))
    leaf_rows = staged(_pointers(nodes.where("level = 0"), tall_top), "merkle-proofs")
    targets = staged(_pointers(inner.withColumn("row", F.lit(None).cast("int")), tall_top).drop("row", "digest", "tall"),
                     "merkle-jumps")
    distance, rounds = 1, (tall + tall_top).bit_length()
    for turn in range(rounds):
        moved = _jump(leaf_rows, targets)
        if turn == rounds - 1:
            leaf_rows = moved
            break
        distance *= 2
        # Within a group's tree only every ``distance``-th level is still pointed at.
        ahead = staged(_jump(targets.where((F.col("tree") == TOP) | (F.col("level") % distance == 0)), targets), "merkle-jumps")
        after = staged(moved, "merkle-proofs")
        drop(leaf_rows, targets)
        leaf_rows, targets = after, ahead
    own, met = _hex(F.col("digest")), _hex(F.col("row.seen"))
    return leaf_rows.select(
        F.col("row.key").alias(key), own.alias("leaf"),
        fold(own, F.slice("steps", F.lit(1), F.col("tall"))).alias("subroot"),
        F.lit(root).alias("root"),
        F.sha2(_joined(F.col("steps.others")), 256).alias("proof_sha256"),
        fold(met, F.col("steps")).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


def without_line_feeds(key: Column, text: Column) -> Column:
    """A tampered copy: rows whose key's CRC-32 is even lose their line feeds."""
    even = F.crc32(key.cast("string").cast("binary")) % 2 == 0
    return F.when(even, F.translate(text, "\n", "")).otherwise(text)
