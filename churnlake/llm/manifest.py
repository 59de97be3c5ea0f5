"""Operator 11: Merkle manifest of a dataset by a rollup of nested structs (DataFrame functions only).

Every document is a leaf; the leaves of a language, ascending by doc_id, form one tree, and the subroots, ordered by language,
form the tree of the whole dataset. In a tree every ``ARITY`` consecutive nodes become one until one remains (a last run may be
shorter, even one node, which is hashed alone).

1. Leaf digests are written once, dealt by range of (language, doc_id, digest) and numbered inside each range; one small row
   per range and language gives the offsets that make those numbers ranks.
2. A rank splits into a block number and ``LEVELS`` digits. Inside a block (at most ARITY ** LEVELS nodes, whatever the
   language holds) the digit columns are grouped away one after the other: each ``groupBy`` nests the children, sorted by their
   digit, as an array of structs beside their common digest. All these groupings use the partitioning by (tree, block), so a
   layer of blocks shuffles its nodes once. Block digests are the nodes of the next layer.
3. Proofs come back down by ``transform`` and ``explode`` of the nested children, which hand every child what stands before
   and after it. Inside blocks there are no joins; a layer receives its blocks' upper paths, one row a block.

Defined results: any field may be null (``-``); null doc_id comes first, equal doc_ids are ordered by digest, equal rows are
leaves of their own with proofs of their own; texts of any length are hashed whole; one leaf alone is its subroot; an empty
table gives an empty result; other columns are ignored whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, small

ARITY, LEVELS = 2, 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Upper paths (up to a few kB each) are broadcast up to so many blocks.
PATH_ROWS = 20_000


def framed(value: Column) -> Column:
    """``-`` for null, else UTF-8 byte count, ``:``, value."""
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(fields: list[Column]) -> Column:
    return F.sha2(F.concat(*[framed(c) for c in fields]).cast("binary"), 256)


def _joined(hashes: Column) -> Column:
    return F.sha2(F.array_join(hashes, "").cast("binary"), 256)


def ranked(rows: DataFrame, by: list[str]) -> DataFrame:
    """``rows`` (tree, ...; already cut) with ``r``, the rank from 0 inside the tree by the columns ``by``, and ``n``, the tree's size.

    The rows are dealt by range, so a tree may span many tasks; a random last key splits runs of equal rows."""
    order = [F.col(c).asc_nulls_first() for c in ("tree", *by)]
    spread = rows.withColumn("_tie", F.rand(11)).repartitionByRange(*order, "_tie").drop("_tie")
    spread = cut(spread.sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    spans = spread.groupBy("tree", part.alias("_part")).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    tree = Window.partitionBy("tree")
    before = F.sum("_n").over(tree.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    spans = cut(spans.select("tree", "_part", "_first", F.coalesce(before, F.lit(0)).alias("_before"), F.sum("_n").over(tree).alias("n")))
    out = spread.withColumn("_part", part).join(small(spans), ["tree", "_part"])
    return out.withColumn("r", F.col("_before") + F.col("_at") - F.col("_first")).drop("_part", "_at", "_first", "_before")


def _rolled(nodes: DataFrame, arity: int, levels: int) -> DataFrame:
    """Nodes (tree, n, r, hash, item) as blocks (tree, n, block, hash, kids): kids nest ``levels`` deep down to the items."""
    digits = [f"cast(r div {arity ** k} % {arity} as int) d{k}" for k in range(levels)]
    out = nodes.selectExpr("tree", "n", f"r div {arity ** levels} block", *digits, "hash", "item kids").repartition("tree", "block")
    for k in range(levels):
        left = ["tree", "n", "block", *[f"d{j}" for j in range(levels - 1, k, -1)]]
        out = out.groupBy(*left).agg(F.expr(f"sort_array(collect_list(struct(d{k} digit, hash, kids))) kids"))
        # a tree that has come down to one node is done: its digest passes through the levels that are left
        out = out.selectExpr(*left, f"if(n > {arity ** k}, sha2(array_join(kids.hash, ''), 256), kids.hash[0]) hash", "kids")
    return out.select("tree", "n", "block", "hash", "kids")


def climb(nodes: DataFrame, arity: int, levels: int) -> list[DataFrame]:
    """The layers of blocks of all trees, lowest first; the last one holds one block a tree, whose hash is the root."""
    most, layers = nodes.agg(F.max("n")).first()[0] or 0, []
    while True:
        layers.append(cut(_rolled(nodes, arity, levels)))
        most = -(-most // arity ** levels)
        if most <= 1:
            return layers
        nodes = layers[-1].select("tree", F.ceil(F.col("n") / arity ** levels).alias("n"), F.col("block").alias("r"), "hash", F.lit(0).alias("item"))


def _beside(kids: str) -> str:
    """Every child with the digests before and after it in its run."""
    side = f"array_join(transform(filter({kids}, y -> y.digit {{0}} x.digit), y -> y.hash), '') {{1}}"
    return f"transform({kids}, x -> struct(x kid, struct({side.format('<', 'before')}, {side.format('>', 'after')}) step))"


def descend(layers: list[DataFrame], start: DataFrame, arity: int, levels: int) -> DataFrame:
    """(hash, item, path, carried columns of ``start``) of every lowest node. ``start`` has (tree, path, ...) of each tree;
    ``path`` lists what stands before and after on each level, lowest first."""
    carried = [c for c in start.columns if c not in ("tree", "path")]
    rows = start.withColumn("block", F.lit(0).cast("long"))
    for i, layer in enumerate(reversed(layers)):
        above = rows if i == 0 else cut(rows)
        out = layer.join(small(above, PATH_ROWS), ["tree", "block"]).drop("hash")
        for k in range(levels - 1, -1, -1):
            out = out.selectExpr("tree", "n", "block", "path", *carried, f"explode({_beside('kids')}) k")
            path = f"if(n > {arity ** k}, concat(array(k.step), path), path) path"
            out = out.selectExpr("tree", "n", f"block * {arity} + k.kid.digit block", path, *carried, "k.kid.hash hash", "k.kid.kids kids")
        rows = out.select("tree", "block", "path", *carried)
    return out.select("hash", F.col("kids").alias("item"), "path", *carried)


def manifest(docs: DataFrame, tampered: Column | None = None, arity: int = ARITY, levels: int = LEVELS) -> DataFrame:
    """(doc_id, leaf, subroot, root, path, folded_root, verified): ``path`` lists (before, after) digests from the leaf to the root.

    Where the condition ``tampered`` holds, the proof is folded from the row with one added to its n_chars."""
    fields = {c: F.col(c) for c in FIELDS}
    changed = leaf([(c.cast("decimal(20,0)") + 1).cast("decimal(20,0)") if k == "n_chars" else c for k, c in fields.items()])
    changed = F.when(tampered, changed) if tampered is not None else F.lit(None).cast("string")
    # names of trees sort like the languages, null first, and are never null
    tree = F.when(F.col("lang").isNull(), F.lit("")).otherwise(F.concat(F.lit(":"), F.col("lang").cast("string")))
    leaves = cut(docs.select(tree.alias("tree"), F.col("doc_id").cast("long").alias("doc_id"), leaf(list(fields.values())).alias("hash"), changed.alias("changed")))
    nodes = ranked(leaves, ["doc_id", "hash"]).select("tree", "n", "r", "hash", F.struct("doc_id", "changed").alias("item"))
    low = climb(nodes, arity, levels)
    subroots = cut(low[-1].select(F.lit("").alias("tree"), F.col("tree").alias("name"), "hash"))
    high = climb(ranked(subroots, ["name"]).select("tree", "n", "r", "hash", F.col("name").alias("item")), arity, levels)
    start = high[-1].select("tree", F.col("hash").alias("root"), F.expr("cast(array() as array<struct<before string, after string>>)").alias("path"))
    trees = descend(high, start, arity, levels).select(F.col("item").alias("tree"), F.col("hash").alias("subroot"), "root", "path")
    out = descend(low, cut(trees), arity, levels)
    fold = F.aggregate("path", F.coalesce("item.changed", "hash"), lambda acc, s: F.sha2(F.concat(s["before"], acc, s["after"]).cast("binary"), 256))
    out = out.select(F.col("item.doc_id").alias("doc_id"), F.col("hash").alias("leaf"), "subroot", "root", "path", fold.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def proof_digest(path: Column) -> Column:
    """Digest of all siblings, level by level, left to right."""
    return _joined(F.transform(path, lambda s: F.concat(s["before"], s["after"])))
