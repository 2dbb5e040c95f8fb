"""A Merkle manifest of a dataset, with the proof of every document by pointer jumping.

Documents are leaves of their source's tree, the sources' roots leaves of one tree above.  Every node starts with a pointer
to its parent and the digests beside it; joining the table of pointers with itself doubles how far each one reaches and
strings the segments together, until all leaves hold the way to the root.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tachado.llm.ranks import ranked
from tachado.llm.tables import written

ARITY = 3
#: The tree above the sources; a source's own tree is named by ``_tree``.
TOP = "top"
#: Steps up to which all nodes jump together: at most 3^8 nodes point to one and the same.  Beyond, only every eighth level jumps.
STRIDE = 8
NODE = "struct<tree:string,lvl:int,idx:bigint>"
KIDS = f"array<struct<idx:bigint,digest:binary,doc_id:bigint,altered:binary>>"
PROOFS = ("doc_id bigint, source string, leaf string, altered string, subroot string, "
          "path array<struct<left:binary,right:binary,top:binary>>")
NOTHING = bytearray()


@dataclass(frozen=True)
class Manifest:
    """``root`` (null without documents) and ``proofs``: one row per document, ``path`` from its run up to the root.

    A step of the path has the digests left and right of the node in its run, and in ``top`` the source's root where it
    is reached.
    """

    root: str | None
    proofs: DataFrame


def encoded(value: Column) -> Column:
    """A value with its length in bytes before it; null is a dash."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(values: list[Column]) -> Column:
    return F.unhex(F.sha2(F.concat(*values), 256))


def hexed(value: Column) -> Column:
    return F.lower(F.hex(value))


def _tree(source: Column) -> Column:
    """Names that sort as sources do: null first, then by bytes."""
    return F.coalesce(F.concat(F.lit("s"), source), F.lit("n"))


def _height(n: int) -> int:
    return 0 if n < 2 else 1 + _height(-(-n // ARITY))


def _runs(nodes: DataFrame, height: int) -> list[DataFrame]:
    """Runs of siblings, a table per level; ``nodes`` are leaves (tree, n, idx, digest, doc_id, altered), n to a tree."""
    levels = []
    for lvl in range(height):
        kid = F.struct("idx", "digest", "doc_id", "altered")
        runs = nodes.where("n > 1").groupBy("tree", "n", F.expr(f"idx div {ARITY}").alias("parent")).agg(
            F.array_sort(F.collect_list(kid)).cast(KIDS).alias("kids"))
        levels.append(written(runs.withColumn("lvl", F.lit(lvl)), "runs"))
        above = digest([F.array_join(F.transform("kids", lambda k: hexed(k["digest"])), "")])
        nodes = levels[-1].select("tree", F.expr(f"(n + {ARITY - 1}) div {ARITY}").alias("n"), F.col("parent").alias("idx"),
                                  above.alias("digest"), F.lit(None).cast("bigint").alias("doc_id"),
                                  F.lit(None).cast("binary").alias("altered"))
    return levels


def _tops(leaves: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """(tree, digest) of every tree's root: the only leaf, or what the run on the highest level becomes."""
    above = digest([F.array_join(F.transform("kids", lambda k: hexed(k["digest"])), "")])
    found = [leaves.where("n = 1").select("tree", "digest")]
    found += [runs.where(f"n <= {ARITY}").select("tree", above.alias("digest")) for runs in levels]
    return reduce(DataFrame.unionByName, found)


def _steps(levels: list[DataFrame], above: DataFrame | None) -> DataFrame:
    """A pointer of every node but the trees' roots to its parent; the parent of the last ones is the leaf of the tree above.

    ``above`` (tree, rank, digest) names those leaves; without it the way ends there (null).
    """
    kid = [F.get("kids", F.lit(i))["digest"] for i in range(ARITY)]
    left = F.concat(*[F.when(F.col("pos") > i, d).otherwise(F.lit(NOTHING)) for i, d in enumerate(kid)])
    right = F.concat(*[F.coalesce(F.when(F.col("pos") < i, d), F.lit(NOTHING)) for i, d in enumerate(kid)])
    every = reduce(DataFrame.unionByName, levels).select("*", F.posexplode("kids").alias("pos", "kid")).select(
        "tree", "n", "parent", F.struct("tree", "lvl", F.col("kid.idx").alias("idx")).cast(NODE).alias("node"),
        F.struct("tree", (F.col("lvl") + 1).alias("lvl"), F.col("parent").alias("idx")).cast(NODE).alias("to"),
        left.alias("left"), right.alias("right"), "kid.doc_id", "kid.digest", "kid.altered")
    inner = every.where(f"n > {ARITY}").withColumn("top", F.lit(None).cast("binary"))
    last = every.where(f"n <= {ARITY}")
    if above is None:
        last = last.withColumn("to", F.lit(None).cast(NODE)).withColumn("top", F.lit(None).cast("binary"))
    else:
        last = last.join(above.select("tree", "rank", F.col("digest").alias("top")), "tree").withColumn("to", _leaf_of_top("rank")).drop("rank")
    return inner.unionByName(last).select("node", "to", F.array(F.struct("left", "right", "top")).alias("path"), "doc_id", "digest", "altered")


def _leaf_of_top(rank: str) -> Column:
    return F.struct(F.lit(TOP).alias("tree"), F.lit(0).alias("lvl"), F.col(rank).alias("idx")).cast(NODE)


def _jumped(pointers: DataFrame, to: DataFrame) -> DataFrame:
    """Pointers that reach on from where they pointed to; those at the root stay."""
    onward = to.select(F.col("node").alias("_at"), F.col("to").alias("_to"), F.col("path").alias("_path"))
    moved = pointers.where("to IS NOT NULL").join(onward, F.col("to") == F.col("_at"))
    moved = moved.withColumn("to", F.col("_to")).withColumn("path", F.concat("path", "_path")).select(pointers.columns)
    return written(pointers.where("to IS NULL").unionByName(moved), "pointers")


def manifest(docs: DataFrame, altered: Column | None = None) -> Manifest:
    """The Merkle tree over ``docs`` (doc_id, source, lang, n_chars, text) and a proof for every row.

    ``altered`` is a text found now in place of a row's own (null: its own); its digest goes along as ``altered``.
    Every row is a leaf, repeated rows too; leaves of a source ascend by doc_id (null first), equal ids by digest.  Null
    sources are a source of their own, the first; nulls and empty texts differ.  Other columns are ignored.  An empty
    table has no root and no proofs.

    Nothing is gathered by source: places come from ranges, runs are groups of three, and a join's key has at most
    3^8 pointers below 2.8e11 documents, since beyond eight levels only every eighth level jumps on and the leaves join
    those once they have arrived.
    """
    spark = docs.sparkSession
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    now = F.col("text") if altered is None else F.coalesce(altered, F.col("text"))
    rows = docs.select(_tree(F.col("source")).alias("tree"), F.col("doc_id").cast("bigint").alias("doc_id"),
                       digest([encoded(x) for x in [*fields, F.col("text")]]).alias("digest"),
                       F.when(~now.eqNullSafe(F.col("text")), digest([encoded(x) for x in [*fields, now]])).alias("altered"))
    placed, sizes = ranked(rows, "tree", ["doc_id", "digest"])
    sizes = written(sizes, "sizes")
    high = sizes.agg(F.max("n")).first()[0]
    if high is None:
        return Manifest(None, spark.createDataFrame([], PROOFS))
    leaves = written(placed.join(sizes, "tree").select("tree", "n", "idx", "digest", "doc_id", "altered"), "leaves")
    levels = _runs(leaves, _height(high))
    tops, count = ranked(_tops(leaves, levels).withColumn("all", F.lit(TOP)), "all", ["tree"])
    n = count.first()["n"]
    tops = written(tops.select("tree", "digest", F.col("idx").alias("rank")), "tops")
    upper = tops.select(F.lit(TOP).alias("tree"), F.lit(n).cast("bigint").alias("n"), F.col("rank").alias("idx"), "digest",
                        F.lit(None).cast("bigint").alias("doc_id"), F.lit(None).cast("binary").alias("altered"))
    top_levels = _runs(upper, _height(n))
    root = _tops(upper, top_levels).first()["digest"].hex()

    # A leaf alone in its source is itself a leaf of the tree above; with one source, that leaf is the root.
    alone = leaves.where("n = 1").join(tops.select("tree", "rank"), "tree").select(
        F.struct("tree", F.lit(0).alias("lvl"), "idx").cast(NODE).alias("node"),
        (_leaf_of_top("rank") if n > 1 else F.lit(None).cast(NODE)).alias("to"),
        F.array().cast("array<struct<left:binary,right:binary,top:binary>>").alias("path"), "doc_id", "digest", "altered")
    found = [alone] + ([_steps(levels, tops)] if levels else []) + ([_steps(top_levels, None)] if top_levels else [])
    pointers = reduce(DataFrame.unionByName, found)
    if n == 1:
        pointers = pointers.withColumn("to", F.when(F.col("to.tree") != TOP, F.col("to")))
    pointers = written(pointers, "pointers")
    total, reach = _height(high) + _height(n), 1
    above, is_leaf = F.col("node.tree") == TOP, (F.col("node.tree") != TOP) & (F.col("node.lvl") == 0)
    while reach < min(total, STRIDE):  # only levels that someone can still point to go on
        pointers = _jumped(pointers.where(above | (F.col("node.lvl") % (2 * reach) == 0)), pointers.where(~is_leaf))
        reach *= 2
    below, far = pointers.where(is_leaf), pointers.where(~is_leaf)
    if reach < total:
        while reach < total:
            far, reach = _jumped(far, far), reach * 2
        below = _jumped(below, far)
    subroot = F.get(F.filter("path", lambda s: s["top"].isNotNull()), F.lit(0))["top"]
    source = F.when(F.col("node.tree") != "n", F.substr("node.tree", F.lit(2)))
    return Manifest(root, below.select(
        "doc_id", source.alias("source"), hexed(F.col("digest")).alias("leaf"), hexed(F.col("altered")).alias("altered"),
        hexed(F.coalesce(subroot, "digest")).alias("subroot"), "path"))


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the digests beside its way lead to."""
    return F.aggregate(path, leaf, lambda at, s: F.sha2(F.concat(hexed(s["left"]), at, hexed(s["right"])), 256))


def verified(made: Manifest) -> DataFrame:
    """Every document's leaf (as found now) folded up its proof and held against the root."""
    root = F.lit(made.root).cast("string")
    beside = F.array_join(F.transform("path", lambda s: F.concat(hexed(s["left"]), hexed(s["right"]))), "")
    out = made.proofs.select("doc_id", "leaf", "subroot", root.alias("root"), F.sha2(beside, 256).alias("proof_sha256"),
                             folded(F.coalesce("altered", "leaf"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
