import hashlib
import zlib

import duckdb
import pytest

from spotlake.llm import merkle, queries
from spotlake.llm.queries_sql import MERKLE_SQL

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(nodes, fanout):
    """(root, siblings of each leaf as (left, right), level by level)."""
    paths, own = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[i:i + fanout] for i in range(0, len(nodes), fanout)]
        for leaf_no, at in enumerate(own):
            run, place = runs[at // fanout], at % fanout
            paths[leaf_no].append(("".join(run[:place]), "".join(run[place + 1:])))
        nodes, own = [digest("".join(r)) for r in runs], [at // fanout for at in own]
    return nodes[0], paths


def brute(rows, fanout=16):
    """Every row as (doc_id, leaf, subroot, root, proof_sha256, folded_root, verified)."""
    groups = {}
    for row in rows:
        groups.setdefault(row[1], []).append(row)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        groups[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[s] = tree([leaf(r) for r in groups[s]], fanout)
    root, over = tree([trees[s][0] for s in order], fanout)
    out = []
    for s, above in zip(order, over, strict=True):
        for row, path in zip(groups[s], trees[s][1], strict=True):
            path, node = path + above, leaf(row)
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0 and row[4] is not None:
                node = leaf((*row[:4], row[4].translate(LOWER)))
            for left, right in path:
                node = digest(left + node + right)
            out.append((row[0], leaf(row), trees[s][0], root, digest("".join(a + b for a, b in path)), node, node == root))
    return sorted(out, key=repr)


def shown(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def rows_of(sizes):
    out, doc_id = [], 0
    for source, n in sizes.items():
        for i in range(n):
            out.append((doc_id * 7 % 1009, source, "en" if i % 3 else None, i if i % 4 else None, f"Text {i} of {source}" if i % 5 else None))
            doc_id += 1
    return out


SCHEMA = "doc_id BIGINT, source STRING, lang STRING, n_chars BIGINT, text STRING"


def test_query_against_brute_force_and_sql(spark, tmp_path):
    rows = rows_of({"b": 300, None: 17, "a": 1, "é": 16, "B": 2}) + [(None, "a", None, None, None), (None, None, None, None, ""), (3, "b", None, None, "Same"), (3, "b", None, None, "Same")]
    rows.append((10**12, "long", "en", 1, "Word " * 20000))
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = shown(queries.op11_merkle_manifest(spark, str(tmp_path)))
    assert got == brute(rows)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(con.execute(MERKLE_SQL).fetchall(), key=repr) == got
    assert {r[-1] for r in got} == {True, False}


@pytest.mark.parametrize("sizes", [{"a": 1}, {"a": 1, "b": 2, "c": 4, "d": 5, "e": 33, "f": 64, "g": 65}])
def test_exchange_over_many_blocks(spark, sizes):
    """Blocks of two leaves: trees of up to 33 blocks, complete or not, go through up to six rounds."""
    rows = rows_of(sizes)
    proofs = merkle.manifest(spark.createDataFrame(rows, SCHEMA), fanout=2, depth=1).collect()
    want = {(r[0], r[1]): (r[2], r[3], r[4]) for r in brute(rows, 2)}
    assert len(proofs) == len(rows)
    for p in proofs:
        assert want[p.doc_id, p.leaf] == (p.subroot, p.root, digest("".join(p.path)))


def test_clashing_columns_and_empty_table(spark, tricky, empty):
    proofs = merkle.manifest(tricky, ("doc_id", "text"), group="names").collect()
    assert len(proofs) == tricky.count() and len({p.root for p in proofs}) == 1
    named = spark.createDataFrame([(1, "s", "n", "g", "p")], "doc_id BIGINT, source STRING, node STRING, grp STRING, path STRING")
    assert merkle.manifest(named, ("doc_id", "node", "grp", "path")).first().path == []
    assert merkle.manifest(empty, ("doc_id", "text"), group="extra").collect() == []


def test_altered_rows_are_named(spark):
    rows = rows_of({"a": 20, "b": 3})
    proofs = merkle.manifest(spark.createDataFrame(rows, SCHEMA))
    changed = [(*rows[0][:4], "other"), *rows[1:-1], (5000, "a", None, None, "new")]
    found = merkle.altered(spark.createDataFrame(changed, SCHEMA), proofs).collect()
    assert sorted((r.doc_id, r.why) for r in found) == sorted([(rows[0][0], "changed"), (rows[-1][0], "missing"), (5000, "added")])
