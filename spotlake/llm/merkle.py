"""Merkle manifest of a dataset, its upper proofs by a butterfly exchange.

Rows become leaves; the leaves of a group (a source) form a tree of its own, and the roots of the groups form one more
tree. A tree is cut into aligned blocks of ``fanout ** depth`` leaves. Each block hashes its own subtree. Then the blocks
swap subtree roots round by round: in round r a block gets one root from each of the aligned subtrees of
``fanout ** r`` blocks beside its own, from the block there that has the same low digits. It hashes their common ancestor
itself, as every block below that ancestor does, and so holds its siblings of one more level. After the last
round every block has the whole path from its subtree root to the top: nothing has to be passed down again.

A path is an array of texts: for each level what stands left of a node in its run and what stands right of it, so
that folding is ``H(left + node + right)``, level by level.
"""

from __future__ import annotations

import hashlib
from collections.abc import Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spotlake.llm.tables import stored
from spotlake.operators.index import position

FANOUT, DEPTH = 16, 3
DIGEST = 64  # hex digits of a node


def leaf_digest(*fields: Column) -> Column:
    """SHA-256 (lowercase hex) over all fields: ``-`` for null, else the UTF-8 length, ``:`` and the value."""
    values = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in values]), 256)


def folded(leaf: Column, path: Column) -> Column:
    """The root that ``leaf`` and the siblings in ``path`` lead to."""
    levels = F.filter(F.sequence(F.lit(0), F.size(path)), lambda i: (i % 2 == 0) & (i < F.size(path)))
    return F.aggregate(levels, leaf, lambda node, i: F.sha2(F.concat(F.get(path, i), node, F.get(path, i + 1)), 256))


def _runs(nodes: list[str], fanout: int) -> list[str]:
    """The nodes of each run, joined."""
    return ["".join(nodes[at:at + fanout]) for at in range(0, len(nodes), fanout)]


def _levels(nodes: list[str], block: int, fanout: int, depth: int) -> tuple[list[list[str]], str]:
    """Joined runs of each level of a block, and the root of the block.

    Only the first block can be the whole tree; it ends where one node is left, every other one after ``depth`` levels.
    """
    levels: list[list[str]] = []
    while len(nodes) > 1 or (block and len(levels) < depth):
        levels.append(_runs(nodes, fanout))
        nodes = [hashlib.sha256(run.encode()).hexdigest() for run in levels[-1]]
    return levels, nodes[0]


def _block_roots(nodes: DataFrame, fanout: int, depth: int) -> DataFrame:
    """(grp, block, blocks, node): the subtree root of each block, and how many blocks its tree has. Stored."""

    def root(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("pos")
        block = rows.column("block")[0].as_py()
        _, node = _levels(rows.column("node").to_pylist(), block, fanout, depth)
        return pa.table({"grp": rows.column("grp")[:1], "block": pa.array([block], pa.int64()), "node": [node]})

    roots = stored(nodes.select("grp", "block", "pos", "node").groupBy("grp", "block").applyInArrow(root, "grp string, block long, node string"), "blocks")
    return roots.join(roots.groupBy("grp").agg(F.count(F.lit(1)).alias("blocks")), "grp")


def butterfly(blocks: DataFrame, fanout: int) -> DataFrame:
    """(grp, block, path, top) of ``blocks`` (grp, block, blocks, node): each block's path to the top of its tree. Stored.

    ``block`` is gapless from 0 in each tree. A partner in the last, incomplete subtree is chosen by the low digits modulo its size.
    """
    state = stored(blocks.withColumn("path", F.array().cast("array<string>")), "exchange")
    most = state.agg(F.max("blocks")).first()[0] or 0
    span = 1
    while span < most:
        first = F.floor(F.col("block") / (span * fanout)) * (span * fanout)
        digits = F.transform(F.sequence(F.lit(0), F.lit(fanout - 1)), lambda j: F.struct(j.alias("digit"), (first + j * span).alias("start")))
        size = F.least(F.lit(span).cast("long"), F.col("blocks") - F.col("d.start"))
        going = state.where(F.col("blocks") > span)
        asks = going.select("grp", "block", "blocks", F.explode(F.filter(digits, lambda d: d["start"] < F.col("blocks"))).alias("d")).select(
            "grp", "block", "d.digit", (F.col("d.start") + F.col("block") % size).alias("partner"))
        theirs = going.select("grp", F.col("block").alias("partner"), F.col("node").alias("theirs"))
        got = asks.join(theirs, ["grp", "partner"]).groupBy("grp", "block").agg(F.sort_array(F.collect_list(F.struct("digit", "theirs"))).alias("run"))
        own = F.floor(F.col("block") / span) % fanout

        def side(keep) -> Column:
            return F.array_join(F.transform(F.filter("run", lambda x: keep(x["digit"])), lambda x: x["theirs"]), "")

        step = got.select("grp", "block", F.sha2(side(lambda d: F.lit(True)), 256).alias("up"), F.array(side(lambda d: d < own), side(lambda d: d > own)).alias("pair"))
        state = stored(state.join(step, ["grp", "block"], "left").select(
            "grp", "block", "blocks", F.coalesce("up", "node").alias("node"),
            F.when(F.col("pair").isNull(), F.col("path")).otherwise(F.concat("path", "pair")).alias("path")), "exchange")
        span *= fanout
    return state.select("grp", "block", "path", F.col("node").alias("top"))


def _leaf_paths(nodes: DataFrame, upper: DataFrame, fanout: int, depth: int) -> DataFrame:
    """``nodes`` with the columns of ``upper`` (grp, block, path, ...) of their block; the path then begins at the leaf."""
    more = [f for f in upper.schema if f.name not in ("grp", "block", "path")]
    kept = [f for f in nodes.schema if f.name not in ("block", "pos")]
    width = fanout ** depth
    schema = T.StructType([*kept, *more, T.StructField("path", T.ArrayType(T.StringType()))])

    def paths(rows: pa.Table, above: pa.Table) -> pa.Table:
        rows = rows.sort_by("pos")
        levels, _ = _levels(rows.column("node").to_pylist(), rows.column("block")[0].as_py(), fanout, depth)
        rest = above.column("path")[0].as_py()
        out = []
        for pos in rows.column("pos").to_pylist():
            at, path = pos % width, []
            for runs in levels:
                run, place = runs[at // fanout], at % fanout * DIGEST
                path += run[:place], run[place + DIGEST:]
                at //= fanout
            out.append(path + rest)
        columns = {f.name: rows.column(f.name) for f in kept}
        columns |= {f.name: pa.array([above.column(f.name)[0].as_py()] * rows.num_rows, above.schema.field(f.name).type) for f in more}
        return pa.table(columns | {"path": pa.array(out, pa.list_(pa.string()))})

    return nodes.groupBy("grp", "block").cogroup(upper.groupBy("grp", "block")).applyInArrow(paths, schema)


def _placed(leaves: DataFrame, order: Sequence[Column], width: int) -> DataFrame:
    """``leaves`` (grp, node, ...) with their position in the group and their block. Stored."""
    placed = position(leaves, ["grp"], order, "pos")
    return stored(placed.withColumn("block", F.floor(F.col("pos") / width).cast("long")), "leaves")


def manifest(
    docs: DataFrame, fields: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"), key: str = "doc_id", group: str = "source",
    also: Mapping[str, Column] | None = None, fanout: int = FANOUT, depth: int = DEPTH,
) -> DataFrame:
    """(key, group, leaf, subroot, root, path, and the columns of ``also``) for every row of ``docs``.

    A leaf is the digest of ``fields``; in a group leaves ascend by ``key`` (null first, ties by digest). While several
    nodes remain, each ``fanout`` consecutive ones become the digest of their hex texts; what remains is the subroot.
    Subroots ascend by group (null first, bytewise) and give the root in the same way. Repeated rows are leaves each;
    nulls are hashed as such; other columns are ignored; an empty table has no rows. ``also`` names further columns
    over ``docs`` that come along. A block of ``fanout ** depth`` leaves is one group of one task.
    """
    if fanout < 2 or depth < 1:
        raise ValueError("fanout must be at least 2, depth at least 1")
    more = dict(also or {})
    # A text that is never null and sorts like the group, null first.
    grp = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))
    carried = [F.col(key).alias("c_key"), F.col(group).alias("c_group"), *[c.alias(f"c_{name}") for name, c in more.items()]]
    leaves = docs.select(grp.alias("grp"), leaf_digest(*map(F.col, fields)).alias("node"), *carried)
    nodes = _placed(leaves, [F.col("c_key").asc_nulls_first(), F.col("node")], fanout ** depth)
    upper = butterfly(_block_roots(nodes, fanout, depth), fanout)
    subroots = upper.where("block = 0").select(F.lit("").alias("grp"), F.col("top").alias("node"), F.col("grp").alias("c_grp"))
    tops = _placed(subroots, [F.col("c_grp")], fanout ** depth)
    over = stored(_leaf_paths(tops, butterfly(_block_roots(tops, fanout, depth), fanout), fanout, depth), "tops")
    over = over.select(F.col("c_grp").alias("grp"), F.col("path").alias("over"), F.col("top").alias("root"))
    upper = upper.join(over, "grp").select("grp", "block", F.concat("path", "over").alias("path"), F.col("top").alias("subroot"), "root")
    found = _leaf_paths(nodes, stored(upper, "upper"), fanout, depth)
    return found.select(
        F.col("c_key").alias(key), F.col("c_group").alias(group), F.col("node").alias("leaf"), "subroot", "root", "path",
        *[F.col(f"c_{name}").alias(name) for name in more])


def altered(docs: DataFrame, proofs: DataFrame, fields: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"), key: str = "doc_id") -> DataFrame:
    """Rows of ``docs`` that ``proofs`` (of ``manifest``, unique keys) does not vouch for: the key and why.

    ``changed`` if the row does not fold to the root, ``added`` without a proof, ``missing`` if only the proof is there.
    """
    now = docs.select(F.col(key).alias("now_key"), leaf_digest(*map(F.col, fields)).alias("now"))
    both = now.join(proofs.select(F.col(key).alias("then_key"), "root", "path"), F.col("now_key").eqNullSafe(F.col("then_key")), "full")
    why = F.when(F.col("root").isNull(), "added").when(F.col("now").isNull(), "missing").when(folded(F.col("now"), F.col("path")) != F.col("root"), "changed")
    return both.select(F.coalesce("now_key", "then_key").alias(key), why.alias("why")).where("why IS NOT NULL")
