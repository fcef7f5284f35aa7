import os

import duckdb
import pytest

from spotlake.llm import license_scan, queries
from spotlake.llm.queries_sql import LICENSES_SQL


def test_variants_of_a_text_are_found(spark):
    texts = dict(license_scan.KNOWN)
    mit, isc = texts_of("MIT")[0], texts_of("ISC")[0]
    rows = [
        (1, mit), (2, "Copyright (c) 2019 A. Person\n\n" + mit.upper().replace(" ", "\n")), (3, mit.replace("License", "Licence").replace('"', "“")),
        (4, mit + " And more."), (5, isc), (6, "prose\nReleased under the MIT Licence!\nprose"), (7, "no such thing"), (8, None), (9, ""), (10, "© 2020 B\n" + isc),
    ]
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING")
    out = {(r.doc_id, r.unit): r.license_id for r in license_scan.scan_licenses(docs).collect() if r.license_id or r.unit == "text"}
    assert out == {(1, "text"): "MIT", (2, "text"): "MIT", (3, "text"): "MIT", (4, "text"): None, (5, "text"): "ISC", (6, "text"): None, (6, "line"): "MIT",
                   (7, "text"): None, (8, "text"): None, (9, "text"): None, (10, "text"): "ISC"}
    assert texts


def texts_of(name):
    return [t for k, t in license_scan.KNOWN if k == name]


def test_against_sql(spark, tricky, tmp_path):
    more = [(50 + i, t.replace("\n", "\r\n") if i % 2 else t) for i, (_, t) in enumerate(license_scan.KNOWN)]
    docs = tricky.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id BIGINT, text STRING"))
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(f"SELECT doc_id, unit, line_no, digest, license_id FROM ({LICENSES_SQL})").fetchall()
    assert sorted(want, key=repr) == sorted((tuple(r) for r in queries.op7_license_scan(spark, str(tmp_path)).collect()), key=repr)


def test_every_known_text_mentions_a_license(spark):
    known = license_scan.digests(spark).collect()
    assert len(known) == len(license_scan.KNOWN)
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(license_scan.KNOWN)], "doc_id BIGINT, text STRING")
    out = license_scan.scan_licenses(docs).where("unit = 'text'").collect()
    assert {r.doc_id: r.license_id for r in out} == {i: k for i, (k, _) in enumerate(license_scan.KNOWN)}


def test_every_known_notice_is_found_as_a_line(spark):
    known = [(k, t) for k, t in license_scan.KNOWN if "\n" not in t] + [("MIT", "SPDX: MIT"), ("CC-BY-4.0", "Released under CC-BY 4.0")]
    rows = [(i, f"prose\n\n -- {t.upper()}\r\nand prose") for i, (_, t) in enumerate(known)] + [(99, "It is released under CC0 1.0 now.")]
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING")
    out = license_scan.scan_licenses(docs, tuple(known)).where("unit = 'line'").collect()
    assert sorted((r.doc_id, r.line_no, r.license_id) for r in out) == [(i, 3, k) for i, (k, _) in enumerate(known)]


def test_empty_table(empty):
    assert license_scan.scan_licenses(empty).collect() == []


PUBLISHED = {"Apache-2.0": "Apache-2.0", "CC0-1.0": "CC0-1.0", "GPL-2.0": "GPL-2", "GPL-3.0": "GPL-3", "LGPL-2.1": "LGPL-2.1", "LGPL-3.0": "LGPL-3", "MPL-2.0": "MPL-2.0"}


@pytest.mark.skipif(not os.path.isdir("/usr/share/common-licenses"), reason="the published texts are not on this machine")
def test_published_texts_in_full(spark):
    """The texts as a distribution ships them, with another wrapping and case; one word more is another text."""
    texts = [(k, open(f"/usr/share/common-licenses/{f}", encoding="utf-8", errors="replace").read()) for k, f in PUBLISHED.items()]
    rows = [(i, " ".join(t.split()).upper() if "copyright" not in t.lower()[:400] and k != "CC0-1.0" else t, k) for i, (k, t) in enumerate(texts)]
    rows += [(100 + i, t + " More.", None) for i, (_, t) in enumerate(texts)]
    terms, end = texts[0][1].split("END OF TERMS AND CONDITIONS")[0], "END OF TERMS AND CONDITIONS"
    rows += [(200, terms, "Apache-2.0"), (201, terms + end, "Apache-2.0"), (202, terms[:-200], None)]
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, license_id STRING")
    out = {r.doc_id: r.license_id for r in license_scan.scan_licenses(docs).where("unit = 'text'").collect()}
    assert out == {i: k for i, _, k in rows}


def test_digests_from_a_table(spark):
    table = license_scan.digest_table(spark.createDataFrame([("House-1", "You may use this under the House Licence.\nCopyright 2020 A")], "license_id STRING, text STRING"))
    docs = spark.createDataFrame([(1, "YOU MAY USE THIS, under the house license"), (2, "You may not"), (3, "prose\nYou may use this under the House License.")], "doc_id BIGINT, text STRING")
    out = {(r.doc_id, r.unit): r.license_id for r in license_scan.scan_licenses(docs, more=table).collect()}
    assert out == {(1, "text"): "House-1", (2, "text"): None, (3, "text"): None, (3, "line"): "House-1", (1, "line"): "House-1"}


def test_bsd_as_projects_ship_it(spark):
    """Owner and year, wrapping, bullets, case and the older word for the holder do not matter; another condition does."""
    two, three = (next(t for k, t in license_scan.KNOWN if k == f"BSD-{n}-Clause") for n in (2, 3))
    owned = "Copyright (c) 2005-2024, Some People.\nAll rights reserved.\n\n"
    bare = three[three.index("Redistribution"):]
    bullets = bare.replace("1. ", "    * ").replace("2. ", "    * ").replace("3. ", "    * ")
    rows = [
        (1, three, "BSD-3-Clause"), (2, two, "BSD-2-Clause"), (3, owned + bare, "BSD-3-Clause"), (4, owned + bullets, "BSD-3-Clause"),
        (5, owned + bare.replace("COPYRIGHT HOLDER OR", "COPYRIGHT OWNER OR").replace(", ", ",\n"), "BSD-3-Clause"),
        (6, "BSD 2-Clause License\n\n" + owned + two[two.index("Redistribution"):].upper(), "BSD-2-Clause"),
        (7, "(c) 2020 A, all rights reserved\n" + bare, "BSD-3-Clause"), (8, bare.replace("3. Neither", "3. Either"), None),
        (9, owned + bare + "\n4. Pay.", None), (10, "Copyright 2011 B\n\n" + texts_of("MIT")[3], "MIT"),
    ]
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, want STRING")
    out = {r.doc_id: r.license_id for r in license_scan.scan_licenses(docs).where("unit = 'text'").collect()}
    assert out == {i: want for i, _, want in rows}
