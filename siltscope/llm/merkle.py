"""A Merkle manifest of a dataset: trees built level by level, proofs climbed by a recursive query.

Each row is a leaf: the SHA-256 of its fields with their lengths. Per tree key (``source``) leaves stand in the order of
``doc_id``; every ``fanout`` neighbours become their hash until one is left, the subroot. Subroots, in the order of their keys,
become the root in the same way. Levels are stored as tables; their rows are turned into nodes that name their parent (``up``)
and hold the digests of the siblings before and after. A recursive SQL query then climbs from every leaf to the root at once:
each round joins the rows to their next nodes, appends the siblings and folds the leaf's (perhaps tampered) hash.

A node high in a tree has millions of leaves below it. So nodes are laid out per block of ``fanout ** 6`` leaves: a block has its
own copy of its path to the root (one row a level), and a round's join never brings more rows to one key than a block holds.
Leaves are ordered by range partitioning; what crosses ranges is one count a range.

Defined results: a null field is ``-``, an empty text ``0:``. Null keys form a tree of their own, before all others; null ids come
first. Rows of one id are ordered by their digest; equal rows are interchangeable. A tree of one leaf is that leaf; with one tree
the root is its subroot. A row that is the whole dataset has an empty proof. An empty table gives no rows. Other columns,
whatever their names, are not read; very long texts are hashed whole, in place.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltscope.llm.common import documents, dropped, ready, saved

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
FANOUT = 3
#: levels below a block's top; a block is fanout ** BLOCK_LEVELS leaves
BLOCK_LEVELS = 6
#: rows a recursive query may give: a setting of Spark's, lifted while the climb runs
ROW_LIMIT = "spark.sql.cteRecursionRowLimit"


def field(value: Column) -> Column:
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def written(value: Column) -> Column:
    """A digest (or several in a row) as lowercase hex text."""
    return F.lower(F.hex(value))


def leaf_digest(fields: Sequence[str], **instead: Column) -> Column:
    return digest(F.concat(*[field(instead.get(f, F.col(f"`{f}`"))) for f in fields]))


def power(base: int, exponent: Column) -> Column:
    """base ** exponent, exactly; exponents up to the largest a long holds."""
    return F.element_at(F.array(*[F.lit(base**i).cast("long") for i in range(64) if base**i < 2**63]), exponent.cast("int") + 1)


def depth(n: Column, base: int) -> Column:
    """Levels between n leaves and their one root."""
    return F.size(F.filter(F.array(*[F.lit(base**i).cast("long") for i in range(64) if base**i < 2**63]), lambda p: p < n))


def placed(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """``df`` as a table in the order of ``order``, with each row's ``part`` (range) and ``place`` (from 0).

    Of the ranges only their counts come to the driver, one a shuffle partition.
    """
    spark = df.sparkSession
    tie = df.withColumn("tie", F.monotonically_increasing_id())
    held = saved(
        tie.repartitionByRange(*order, "tie").sortWithinPartitions(*order, "tie").drop("tie")
        .withColumn("row", F.monotonically_increasing_id()).withColumn("part", F.spark_partition_id()),
        name,
    )
    at, starts = 0, []
    for r in held.groupBy("part").agg(F.min("row").alias("row"), F.count("*").alias("n")).orderBy("part").collect():
        starts.append((r.part, at - r.row))
        at += r.n
    starts_df = spark.createDataFrame(starts, "part int, shift long")
    return held.join(F.broadcast(starts_df), "part").withColumn("place", F.col("row") + F.col("shift")).drop("row", "shift")


def runs(nodes: DataFrame, fanout: int, *kept: str) -> DataFrame:
    """Neighbouring nodes(tree, pos, n, digest) of trees with more than one, as rows (tree, n, run, members)."""
    return (
        nodes.filter("n > 1")
        .groupBy("tree", "n", F.floor(F.col("pos") / fanout).cast("long").alias("run"))
        .agg(F.sort_array(F.collect_list(F.struct("pos", "digest", *kept))).alias("members"))
    )


def joined(members: Column) -> Column:
    """Digests of some members, one after the other."""
    return F.aggregate(members, F.lit(b""), lambda acc, m: F.concat(acc, m["digest"]))


def parents(level: DataFrame, fanout: int) -> DataFrame:
    n = F.ceil(F.col("n") / fanout).cast("long")
    return level.select("tree", F.col("run").alias("pos"), n.alias("n"), digest(written(joined(F.col("members")))).alias("digest"))


def links(level: DataFrame, *kept: str) -> DataFrame:
    """One row per node: tree, n, pos, up (its parent's position), siblings before and after."""
    before = F.slice("members", F.lit(1), F.col("i"))
    after = F.slice("members", F.col("i") + 2, F.size("members"))
    return level.select("tree", "n", F.col("run").alias("up"), "members", F.posexplode("members").alias("i", "m")).select(
        "tree", "n", F.col("m.pos").alias("pos"), "up", joined(before).alias("before"), joined(after).alias("after"), *[F.col(f"m.{c}").alias(c) for c in ("digest", *kept)]
    )


def built(nodes: DataFrame, largest: int, fanout: int, name: str, *kept: str) -> tuple[list[DataFrame], DataFrame]:
    """All levels of the trees over ``nodes`` as stored runs, and the trees' roots(tree, digest)."""
    levels: list[DataFrame] = []
    roots = [nodes.filter("n = 1").select("tree", "digest")]
    while largest > 1:
        levels.append(saved(runs(nodes, fanout, *([] if levels else kept)), f"{name}-{len(levels)}"))
        nodes = parents(levels[-1], fanout)
        roots.append(nodes.filter("n = 1").select("tree", "digest"))
        largest = -(-largest // fanout)
    return levels, reduce(DataFrame.unionByName, roots)


CLIMB = """
WITH RECURSIVE climb(tree, leaf_pos, step, up, siblings, folded, doc_id, leaf, subroot) AS (
  SELECT tree, pos, step, up, concat(before, after), folded, doc_id, leaf, CAST(NULL AS BINARY) FROM {leaves}
  UNION ALL
  SELECT c.tree, c.leaf_pos, n.step, n.up, concat(n.before, n.after),
         unhex(sha2(concat(lower(hex(n.before)), lower(hex(c.folded)), lower(hex(n.after))), 256)),
         CAST(NULL AS BIGINT), CAST(NULL AS BINARY), n.subroot
  FROM climb c JOIN {nodes} n
    ON n.tree = c.tree AND n.block = c.leaf_pos DIV {block} AND n.step = c.step + 1 AND n.pos = c.up
)
SELECT * FROM climb"""


def manifest(docs: DataFrame, tampered: Column, fields: Sequence[str] = FIELDS, tree: str = "source", fanout: int = FANOUT) -> DataFrame:
    """Per row: doc_id, leaf, subroot, root, proof_sha256, and the root folded from the leaf of ``tampered`` (a text) with the
    original siblings; ``verified`` tells whether that is the root."""
    spark = docs.sparkSession
    ready(spark)
    hashed = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col(tree).cast("string").alias("key"),
        leaf_digest(fields).alias("leaf"), leaf_digest(fields, text=tampered).alias("other"),
    ).withColumn("other", F.when(F.col("other") != F.col("leaf"), F.col("other")))
    hashed = saved(hashed, "merkle-leaves")
    leaves = placed(hashed, ["key", "doc_id", "leaf"], "merkle-order")
    dropped(hashed)

    # a tree's leaves stand in a row: its first place and their number, one row per tree and range
    pieces = saved(leaves.groupBy("key", "part").agg(F.min("place").alias("first"), F.count("*").alias("n")), "merkle-pieces")
    ordered = placed(pieces.groupBy("key").agg(F.min("first").alias("first"), F.sum("n").alias("n")), ["key"], "merkle-trees")
    trees = saved(ordered.select("key", "first", "n", F.col("place").alias("tree"), depth(F.col("n"), fanout).alias("depth")), "merkle-ranked")
    size = trees.agg(F.count("*").alias("trees"), F.max("n").alias("largest")).first()
    of_tree = trees.withColumnRenamed("key", "tree_key")
    of_piece = pieces.select("key", "part").join(of_tree, F.col("key").eqNullSafe(F.col("tree_key"))).drop("tree_key")
    of_piece = of_piece.withColumnRenamed("key", "piece_key").withColumnRenamed("part", "piece_part")
    nodes = leaves.join(of_piece, F.col("key").eqNullSafe(F.col("piece_key")) & (F.col("part") == F.col("piece_part"))).select(
        "tree", (F.col("place") - F.col("first")).alias("pos"), "n", F.col("leaf").alias("digest"), "doc_id", "other"
    )
    nodes = saved(nodes, "merkle-bottom")
    dropped(leaves, pieces, ordered)

    levels, subroots = built(nodes, size.largest or 0, fanout, "merkle-level", "doc_id", "other")
    subroots = saved(subroots, "merkle-subroots")
    top = subroots.select(F.lit(-1).cast("long").alias("tree"), F.col("tree").alias("pos"), F.lit(size.trees).alias("n"), "digest")
    top_levels, roots = built(top, size.trees, fanout, "merkle-top")
    root = roots.select(F.first("digest")).first()[0]  # one row

    # leaves start with their own run's siblings; a lone leaf starts at its tree's place among the subroots
    folded = F.coalesce("other", "digest")
    own = [F.col("doc_id"), F.col("digest").alias("leaf")]
    lone = nodes.filter("n = 1").select("tree", "pos", F.lit(-1).alias("step"), F.col("tree").alias("up"), F.lit(b"").alias("before"), F.lit(b"").alias("after"), folded.alias("folded"), *own)
    start = lone
    if levels:
        hashed_up = digest(F.concat(written(F.col("before")), written(folded), written(F.col("after"))))
        start = lone.unionByName(
            links(levels[0], "doc_id", "other").select(
                "tree", "pos", F.lit(0).alias("step"), F.when(F.col("n") <= fanout, F.col("tree")).otherwise(F.col("up")).alias("up"), "before", "after", hashed_up.alias("folded"), *own
            )
        )
    start = saved(start, "merkle-start")
    block = fanout**BLOCK_LEVELS
    path = saved(block_paths(trees, subroots, levels, top_levels, fanout, size), "merkle-nodes")
    dropped(nodes, trees, subroots, *levels, *top_levels)
    out = climbed(spark, start, path, block, root)
    dropped(start, path)
    return out


def block_paths(trees: DataFrame, subroots: DataFrame, levels: list[DataFrame], top_levels: list[DataFrame], fanout: int, size) -> DataFrame:
    """Parent-linked nodes above the leaves, per block: tree, block, step, pos, up, before, after, subroot."""
    out: list[DataFrame] = []
    none = F.lit(None).cast("binary").alias("subroot")
    last = F.col("n") <= fanout  # the next node is the subroot, which goes on at its tree's place
    for step, level in enumerate(levels[1:], 1):
        node = links(level).select("tree", F.lit(step).alias("step"), "pos", F.when(last, F.col("tree")).otherwise(F.col("up")).alias("up"), "before", "after", none)
        if step < BLOCK_LEVELS:
            out.append(node.withColumn("block", F.floor(F.col("pos") / fanout ** (BLOCK_LEVELS - step)).cast("long")))
        else:
            wide = fanout ** (step - BLOCK_LEVELS)
            blocks = every_block(trees.filter(F.col("depth") > step), fanout).select("tree", "block", F.floor(F.col("block") / wide).cast("long").alias("pos"))
            out.append(node.join(blocks, ["tree", "pos"]))
    blocks = every_block(trees, fanout)
    for k, level in enumerate(top_levels):
        at = blocks.select("tree", "block", "depth", F.floor(F.col("tree") / fanout**k).cast("long").alias("pos"))
        node = links(level).select("pos", "up", "before", "after", (F.col("digest") if k == 0 else none).alias("subroot"))
        out.append(at.join(node, "pos").select("tree", (F.col("depth") + k).alias("step"), "pos", "up", "before", "after", "subroot", "block"))
    if not out:
        return trees.sparkSession.createDataFrame([], "tree long, step int, pos long, up long, before binary, after binary, subroot binary, block long")
    return reduce(DataFrame.unionByName, out)


def every_block(trees: DataFrame, fanout: int) -> DataFrame:
    last = F.floor((F.col("n") - 1) / fanout**BLOCK_LEVELS).cast("long")
    return trees.select("tree", "depth", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("block"))


def climbed(spark: SparkSession, start: DataFrame, path: DataFrame, block: int, root: bytes | None) -> DataFrame:
    """The recursive query over all leaves, one row a leaf and step, folded to one row a leaf."""
    names = {"leaves": f"merkle_leaves_{id(start)}", "nodes": f"merkle_nodes_{id(path)}"}
    start.createOrReplaceTempView(names["leaves"])
    path.createOrReplaceTempView(names["nodes"])
    before = spark.conf.get(ROW_LIMIT)
    spark.conf.set(ROW_LIMIT, "-1")
    try:
        steps = spark.sql(CLIMB.format(block=block, **names))
        per_leaf = steps.groupBy("tree", "leaf_pos").agg(
            F.max("doc_id").alias("doc_id"), F.max("leaf").alias("leaf"), F.max("subroot").alias("subroot"),
            F.sort_array(F.collect_list(F.struct("step", "siblings"))).alias("proof"), F.max_by("folded", "step").alias("folded"),
        )
        top = F.lit(root).cast("binary")
        proof = F.aggregate("proof", F.lit(b""), lambda acc, s: F.concat(acc, s["siblings"]))
        return saved(
            per_leaf.select(
                "doc_id", written(F.col("leaf")).alias("leaf"), written(F.coalesce("subroot", top)).alias("subroot"), written(top).alias("root"),
                F.sha2(written(proof), 256).alias("proof_sha256"), written(F.col("folded")).alias("folded_root"), F.coalesce(F.col("folded") == top, F.lit(False)).alias("verified"),
            ),
            "merkle-manifest",
        )
    finally:
        spark.conf.set(ROW_LIMIT, before)
        for n in names.values():
            spark.catalog.dropTempView(n)


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    tampers = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.lit(False))
    return manifest(docs, F.when(tampers, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text")))


#: crc32 of the decimal id, from its defining polynomial; trees and climbs by recursion over levels
OP11_SQL = """
WITH RECURSIVE d AS (
  SELECT doc_id, source, lang, n_chars, text, row_number() OVER () AS id,
         list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS UBIGINT))),
           lambda crc, b: list_reduce(list_prepend(xor(crc, b), list_transform(range(8), lambda i: 0::UBIGINT)),
             lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384::UBIGINT) ELSE x // 2 END)) AS crc
  FROM documents
), l AS (
  SELECT id, doc_id, source, sha256(head || body) AS leaf, sha256(head || other) AS tampered
  FROM (SELECT *, coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
                 || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head,
               coalesce(strlen(text) || ':' || text, '-') AS body,
               CASE WHEN coalesce(xor(crc, 4294967295::UBIGINT) % 2 = 0, false)
                    THEN coalesce(strlen(replace(text, chr(10), '')) || ':' || replace(text, chr(10), ''), '-')
                    ELSE coalesce(strlen(text) || ':' || text, '-') END AS other FROM d)
), trees AS (
  SELECT source, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, n FROM (SELECT source, count(*) AS n FROM l GROUP BY source)
), bottom AS (
  SELECT l.*, tree, n, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf, id) - 1 AS pos
  FROM l JOIN trees ON l.source IS NOT DISTINCT FROM trees.source
), forest(tree, lvl, pos, n, h) AS (
  SELECT tree, 0, pos, n, leaf FROM bottom
  UNION ALL
  SELECT tree, lvl + 1, pos // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM forest WHERE n > 1 GROUP BY tree, lvl, pos // 3, n
), subs AS (SELECT tree, h AS subroot FROM forest WHERE n = 1
), top(lvl, pos, n, h) AS (
  SELECT 0, tree, (SELECT count(*) FROM trees), subroot FROM subs
  UNION ALL
  SELECT lvl + 1, pos // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM top WHERE n > 1 GROUP BY lvl, pos // 3, n
), climb(id, tree, lvl, pos, n, proof, folded) AS (
  SELECT id, tree, 0, pos, n, '', tampered FROM bottom
  UNION ALL
  SELECT c.id, c.tree, c.lvl + 1, c.pos // 3, (c.n + 2) // 3,
         c.proof || (SELECT coalesce(string_agg(f.h, '' ORDER BY f.pos), '') FROM forest f WHERE f.tree = c.tree AND f.lvl = c.lvl AND f.pos // 3 = c.pos // 3 AND f.pos <> c.pos),
         sha256((SELECT string_agg(CASE WHEN f.pos = c.pos THEN c.folded ELSE f.h END, '' ORDER BY f.pos) FROM forest f WHERE f.tree = c.tree AND f.lvl = c.lvl AND f.pos // 3 = c.pos // 3))
  FROM climb c WHERE c.n > 1
), over(id, lvl, pos, n, proof, folded) AS (
  SELECT id, 0, tree, (SELECT count(*) FROM trees), proof, folded FROM climb WHERE n = 1
  UNION ALL
  SELECT c.id, c.lvl + 1, c.pos // 3, (c.n + 2) // 3,
         c.proof || (SELECT coalesce(string_agg(t.h, '' ORDER BY t.pos), '') FROM top t WHERE t.lvl = c.lvl AND t.pos // 3 = c.pos // 3 AND t.pos <> c.pos),
         sha256((SELECT string_agg(CASE WHEN t.pos = c.pos THEN c.folded ELSE t.h END, '' ORDER BY t.pos) FROM top t WHERE t.lvl = c.lvl AND t.pos // 3 = c.pos // 3))
  FROM over c WHERE c.n > 1
)
SELECT b.doc_id, b.leaf, s.subroot, r.h AS root, sha256(o.proof) AS proof_sha256, o.folded AS folded_root, o.folded = r.h AS verified
FROM bottom b JOIN subs s USING (tree) JOIN (SELECT * FROM over WHERE n = 1) o USING (id) JOIN (SELECT h FROM top WHERE n = 1) r ON true"""
