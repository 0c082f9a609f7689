"""Merkle manifests of a table by blocks of higher-order SQL.

Leaves are hashes of rows. Within a group they are put in order by a two-level ranking, and BLOCK of them (a power
of ARITY) become one row with an array. `sequence`, `transform`, `slice` and `aggregate` collapse such an array level by
level to the block's root; the block roots, numbered by their blocks, are the nodes of the next round, until each
group has one node. The groups' roots, in the order of the groups, are then nodes of one more tree.

Proofs go down the same tables: a block row gets the path above it once, by a join on (group, block), and its nodes
add their siblings inside the block. So no task holds more than a block and a path, whatever the group's size, and
leaves are dealt out twice, as rows of some hundred bytes. All of it runs in the JVM.

Defined cases: a null value is hashed as `-`; rows without an id come first; rows of one id follow each other in the
order of their hashes; equal rows are leaves of their own, with equal hashes; a group of one row has its leaf as root;
rows whose group is null form the first group; an empty table has no rows and no root; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import ranked
from .store import written

ARITY, DEPTH = 8, 3
BLOCK = ARITY**DEPTH
STEP = "struct<l:string,r:string>"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(*parts: Column) -> Column:
    """The lower-case hex SHA-256 of the parts, one after another."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def field(value: Column) -> Column:
    """A value inside a leaf's hash: `-` for null, else its bytes' number, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def _level(nodes: Column) -> Column:
    """The parents of an array of nodes."""
    runs = F.sequence(F.lit(1), F.size(nodes), F.lit(ARITY))
    return F.transform(runs, lambda i: digest(F.array_join(F.slice(nodes, i, F.lit(ARITY)), "")))


def _levels(nodes: Column, depth: Column) -> Column:
    """array of levels: the nodes themselves, their parents, and so on, `depth` times."""
    steps = F.filter(F.sequence(F.lit(1), F.lit(DEPTH)), lambda k: k <= depth)
    return F.aggregate(steps, F.array(nodes), lambda done, _: F.concat(done, F.array(_level(F.element_at(done, -1)))))


def _path(levels: Column, depth: Column, place: Column) -> Column:
    """The steps from a node of a block (by its place, from 0) to the block's root: the siblings on its left and right."""
    steps = F.filter(F.sequence(F.lit(0), F.lit(DEPTH - 1)), lambda k: k < depth)

    def step(k: Column) -> Column:
        nodes, at = F.get(levels, k), F.floor(place / F.pow(F.lit(float(ARITY)), k)).cast("int")
        first = at - at % ARITY
        return F.struct(F.array_join(F.slice(nodes, first + 1, at - first), "").alias("l"), F.array_join(F.slice(nodes, at + 2, first + (ARITY - 1) - at), "").alias("r"))

    return F.transform(steps, step).cast(f"array<{STEP}>")


def fold(node: Column, path: Column) -> Column:
    """The root that a node and its path give."""
    return F.aggregate(path, node, lambda h, s: digest(s["l"], h, s["r"]))


def tree(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """nodes (grp, pos, n, hash, ...): a group's n nodes numbered from 0 -> (tables of blocks, lowest first; tops (grp, root)).

    A table of blocks has grp, block, depth, levels and own: the lowest one's further columns, in the order of places.
    """
    tables: list[DataFrame] = []
    more = [c for c in nodes.columns if c not in ("grp", "pos", "n", "hash")]
    while True:
        own = F.struct("pos", "hash", *more)
        blocks = nodes.groupBy("grp", F.expr(f"pos div {BLOCK}").alias("block")).agg(F.max("n").alias("n"), F.array_sort(F.collect_list(own)).alias("own"))
        depth = F.size(F.filter(F.array(*(F.lit(ARITY**k) for k in range(DEPTH))), lambda x: x < F.col("n")))  # levels until one node is left, DEPTH at most
        blocks = blocks.withColumn("depth", depth).withColumn("levels", _levels(F.transform("own", lambda x: x["hash"]), F.col("depth")))
        kept = F.transform("own", lambda x: F.struct(*(x[c].alias(c) for c in more))) if more else F.size("own")
        tables.append(written(blocks.select("grp", "block", "n", "depth", "levels", kept.alias("own")), "blocks"))
        nodes = tables[-1].select("grp", F.col("block").alias("pos"), F.expr(f"(n + {BLOCK - 1}) div {BLOCK}").alias("n"), F.get(F.element_at("levels", -1), F.lit(0)).alias("hash"))
        more = []
        if not nodes.where("n > 1").take(1):
            return tables, nodes.select("grp", F.col("hash").alias("root"))


def paths(tables: list[DataFrame], above: DataFrame) -> DataFrame:
    """The lowest table of blocks with `above`, the path from each block's root to the very top; above (grp, path, ...) has that of each group's root.

    Further columns of above go along, so that every join is by (group, block) and none by the group alone.
    """
    more = [c for c in above.columns if c not in ("grp", "path")]
    ups = above.select(F.col("grp").alias("g"), F.lit(0).cast("long").alias("b"), F.col("path").alias("above"), *more)
    for k, blocks in enumerate(reversed(tables)):
        placed = blocks.join(ups, (F.col("grp") == F.col("g")) & (F.col("block") == F.col("b"))).drop("g", "b")
        if k == len(tables) - 1:
            return placed
        nodes = placed.select("grp", "block", "depth", "levels", "above", *more, F.explode(F.sequence(F.lit(0), F.size(F.get("levels", F.lit(0))) - 1)).alias("i"))
        ups = nodes.select(F.col("grp").alias("g"), (F.col("block") * BLOCK + F.col("i")).alias("b"), F.concat(_path(F.col("levels"), F.col("depth"), F.col("i")), "above").alias("above"), *more)
    raise ValueError("no tables")


def manifest(rows: DataFrame, group: str, leaves: dict[str, Column], order: list[str], keep: list[str]) -> DataFrame:
    """rows -> keep, the leaves, subroot, root and path; one row per input row.

    leaves: names and hashes of a row; the first one's tree is built, others are carried along (such as a hash to be checked
    against the tree). order: columns that order the rows of a group; ties are ordered by the first leaf. path is
    array<struct<l, r>>, from the leaf to the root: siblings on the left and right, each run's joined.
    """
    first = next(iter(leaves))
    thin = rows.select(F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("")).alias("grp"), *(F.col(c).alias(f"__{k}") for k, c in enumerate([*keep, *order])), *(h.alias(f"__leaf_{n}") for n, h in leaves.items()))
    by = [f"__{len(keep) + k}" for k in range(len(order))]
    placed = ranked(thin, ["grp"], [*by, f"__leaf_{first}"], "pos", "n", written).drop(*by).withColumnRenamed(f"__leaf_{first}", "hash")
    blocks, tops = tree(placed)
    tops = ranked(written(tops, "tops").withColumn("one", F.lit("")), ["one"], ["grp"], "pos", "n", written)
    upper, top = tree(tops.select(F.col("one").alias("grp"), "pos", "n", F.col("root").alias("hash"), F.col("grp").alias("of")))
    start = top.select("grp", F.array().cast(f"array<{STEP}>").alias("path"), "root")
    own = F.col("o.of").alias("grp"), F.get(F.get("levels", F.lit(0)), F.col("i")).alias("subroot"), "root"
    subs = written(_nodes(paths(upper, start), "root").select(*own, F.concat(_path(F.col("levels"), F.col("depth"), F.col("i")), "above").alias("path")), "subroots")
    out = _nodes(paths(blocks, subs), "subroot", "root")
    hashes = [F.get(F.get("levels", F.lit(0)), F.col("i")) if n == first else F.col("o")[f"__leaf_{n}"] for n in leaves]
    path = F.concat(_path(F.col("levels"), F.col("depth"), F.col("i")), "above")
    return out.select(*(F.col("o")[f"__{k}"].alias(c) for k, c in enumerate(keep)), *(h.alias(n) for h, n in zip(hashes, leaves, strict=True)), "subroot", "root", path.alias("path"))


def _nodes(blocks: DataFrame, *more: str) -> DataFrame:
    """A row for each node of the blocks: its place i and its own columns o."""
    return blocks.select("depth", "levels", "above", *more, F.posexplode("own").alias("i", "o"))


def row_hash(columns: list[str], text: str = "", change=None) -> Column:
    """A leaf: the hash of the columns' fields; `change` alters the column named text."""
    return digest(*(field(change(F.col(c)) if change and c == text else F.col(c)) for c in columns))


def document_manifest(docs: DataFrame, every: int = 3) -> DataFrame:
    """docs (doc_id, source, lang, n_chars, text) -> doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    Where `every` divides the crc32 of the id, the text is tampered with (A-Z in lower case) before its hash is folded along the
    untampered proof.
    """
    columns = ["doc_id", "source", "lang", "n_chars", "text"]
    touched = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % every == 0
    seen = F.when(touched, row_hash(columns, "text", lambda t: F.translate(t, _UPPER, _LOWER)))
    made = manifest(docs.select(*columns), "lang", {"leaf": row_hash(columns), "seen": seen}, ["doc_id"], ["doc_id"])
    siblings = F.array_join(F.transform("path", lambda s: F.concat(s["l"], s["r"])), "")
    out = made.withColumn("folded_root", fold(F.coalesce("seen", "leaf"), F.col("path")))
    return out.select("doc_id", "leaf", "subroot", "root", digest(siblings).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
