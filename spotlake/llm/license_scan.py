"""Licence scan by canonical digests; DataFrame functions only.

A text is brought to a canonical form (lower case, no copyright lines, one spelling, no punctuation) and its digest
is looked up among the digests of known licences, by a hash join. The unit is the entire text, and also every
line that mentions a licence or is a known notice, since documents often end with a one-line notice.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spotlake.llm.tables import ascii_lower

# Spellings that count as equal.
SPELLINGS = (
    ("licence", "license"), ("licenced", "licensed"), ("sub license", "sublicense"), ("non commercial", "noncommercial"),
    ("organisation", "organization"), ("favour", "favor"), ("fulfil", "fulfill"), ("per cent", "percent"),
    ("copyright owner", "copyright holder"), ("copyright owners", "copyright holders"), ("merchantibility", "merchantability"),
    ("judgement", "judgment"), ("version 2 0", "version 2"), ("version 3 0", "version 3"),
)
COPYRIGHT_LINE = r"(?md)^[^a-z0-9\n]*(?:copyright[^\n]*(?:\(c\)|©|[0-9]{4})|\(c\) *[0-9]{4}|© *[0-9]{4})[^\n]*$"
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F©“”‘’–—]"
MENTION = "licen[cs]e|copyright|public domain|all rights reserved"

_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
    "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE "
    "FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION "
    "WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF '
    "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY "
    "DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, "
    "ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
    'files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, '
    "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
    "following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the "
    "Software.\n\n" + _WARRANTY
)
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_CONDITIONS = (
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution.",
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
    "software without specific prior written permission.",
)
_BSD_WARRANTY = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, '
    "THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR "
    "CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, "
    "PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF "
    "LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS "
    "SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)


def _bsd(clauses: int) -> tuple[tuple[str, str], ...]:
    """The text with and without a heading, a line that reserves all rights, and numbers before the conditions."""
    texts = []
    for heading in (f"BSD {clauses}-Clause License", ""):
        for reserved in ("", "All rights reserved."):
            for numbered in (True, False):
                conditions = [f"{i}. {c}" if numbered else f"* {c}" for i, c in enumerate(_BSD_CONDITIONS[:clauses], 1)]
                texts.append("\n\n".join([part for part in (heading, reserved) if part] + [_BSD, *conditions, _BSD_WARRANTY]))
    return tuple((f"BSD-{clauses}-Clause", text) for text in texts)


# Public licence texts and customary one-line notices.
KNOWN = (
    ("MIT", "MIT License\n\n" + _MIT),
    ("MIT", "The MIT License (MIT)\n\n" + _MIT),
    ("MIT", "The MIT License\n\n" + _MIT),
    ("MIT", _MIT),
    *_bsd(2),
    *_bsd(3),
    ("ISC", "ISC License\n\n" + _ISC + ", provided that the above copyright notice and this permission notice appear in all copies.\n\n" + _ISC_WARRANTY),
    ("ISC", _ISC + ", provided that the above copyright notice and this permission notice appear in all copies.\n\n" + _ISC_WARRANTY),
    ("0BSD", "BSD Zero Clause License\n\n" + _ISC + ".\n\n" + _ISC_WARRANTY),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Released under CC0 1.0."),
    ("NONE", "All rights reserved."),
)


# Digests of the canonical forms of public licence texts (made by ``digest_table`` from the texts as published).
DIGESTS: tuple[tuple[str, str], ...] = (
    ("Apache-2.0", "e440eb4b067ab3a0604cc274e564c22d407effa41f60ffddd2e80e17f45db876"),
    ("Apache-2.0", "8d7c31f10cecf5237270c0218f1c0200b470f31618e6770309a5ad405adb00b6"),  # without the appendix
    ("Apache-2.0", "bafe3e95edb5ddb356c0840d40f461550c718daae3f39231905da043653e16c9"),  # and without the line before it
    ("CC0-1.0", "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
    ("GPL-2.0", "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821"),
    ("GPL-3.0", "a8cd54d6683aa630f0b8d05d56184ad91dc486756da2df61c94d3e4e8d5ecb68"),
    ("LGPL-2.1", "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891"),
    ("LGPL-3.0", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", "3f0343dd4f3b064be36e0c6584737c9b7bb5c322721694563f9009e088ce96d1"),
    ("MPL-2.0", "22c9324e5634aa07c32060365e6191d4f9ec61fafc6091ce7394333c6d7db95e"),
    ("GFDL-1.3", "93d6108daecdddc5f284cf8f2512fb0d72f6e9ee12381feb9704ba194b00c3e6"),
    ("Artistic-1.0-Perl", "e963bc30f4d3c45f45030c34409ee37315564625649c1394e32bb5ddd99e01b2"),
    ("BSD-3-Clause-Regents", "3d151449461c0c776e892a4dc41cac0d251eb00c9fc49d2d48802d9bed818fe9"),
)


def canonical(low: Column) -> Column:
    """Canonical form of a lower-case text: copyright lines, punctuation and white space go, spellings are made equal.

    Spellings matter only where a licence is mentioned.
    """
    marked = low.contains("copyright") | low.contains("(c)") | low.contains("©")
    body = F.when(marked, F.regexp_replace(low, COPYRIGHT_LINE, "")).otherwise(low)
    plain = F.trim(F.regexp_replace(body, f"{GAP}+", " "))
    spelled = F.concat(F.lit(" "), plain, F.lit(" "))
    for old, new in SPELLINGS:
        spelled = F.replace(spelled, F.lit(f" {old} "), F.lit(f" {new} "))
    return F.when(plain.rlike(MENTION), F.trim(spelled)).otherwise(plain)


def _canonical_known(spark: SparkSession, known: tuple) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(k).alias("license_id"), F.lit(t).alias("text")) for k, t in known])
    return spark.range(1).select(F.inline(rows)).select("license_id", canonical(ascii_lower(F.col("text"))).alias("form"))


def silent_notices(spark: SparkSession, known: tuple = KNOWN) -> str:
    """A pattern of the known texts that mention no licence, in any punctuation; empty without any."""
    forms = sorted({r.form for r in _canonical_known(spark, known).collect() if r.form and not re.search(MENTION, r.form)})
    return "|".join(f"{GAP}+".join(re.escape(word) for word in form.split(" ")) for form in forms)


def digest_table(texts: DataFrame) -> DataFrame:
    """(digest, license_id) of a table (license_id, text) of licence texts."""
    return texts.select(F.sha2(canonical(ascii_lower(F.col("text"))), 256).alias("digest"), "license_id")


def digests(spark: SparkSession, known: tuple = KNOWN) -> DataFrame:
    """(license_id, digest) of the known texts; a table as long as ``known``, hence broadcast."""
    return _canonical_known(spark, known).select(F.sha2("form", 256).alias("digest"), "license_id").groupBy("digest").agg(F.min("license_id").alias("license_id"))


def _every_digest(spark: SparkSession, known: tuple, more: DataFrame | None) -> DataFrame:
    """(digest, license_id) of the known texts, of the fixed digests, and of ``more`` (of ``digest_table``)."""
    fixed = spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(d).alias("digest"), F.lit(k).alias("license_id")) for k, d in DIGESTS])))
    every = digests(spark, known).unionByName(fixed)
    return (every if more is None else every.unionByName(more)).groupBy("digest").agg(F.min("license_id").alias("license_id"))


def scan_licenses(docs: DataFrame, known: tuple = KNOWN, more: DataFrame | None = None) -> DataFrame:
    """(doc_id, unit, line_no, digest, license_id): the entire text of every row, and its lines that mention a licence or are a known notice.

    unit is ``text`` (line_no 0) or ``line`` (line_no from 1); license_id is null if the digest is unknown. Null
    texts count as empty; an empty text has one unit ``text`` without a licence. Repeated rows give repeated units.
    ``known`` are texts and notices in the code, ``more`` a table of further digests (of ``digest_table``), which is shuffled
    if it is long; a notice in ``more`` is found as a line if it mentions a licence.
    """
    units = docs.select("doc_id", F.explode(F.array(ascii_lower(F.coalesce("text", F.lit(""))))).alias("low"))
    low, silent = F.col("low"), silent_notices(docs.sparkSession, known)
    # A known text without a word of MENTION is looked for by itself, and only counts as an entire line.
    hint, whole_line = (f"{MENTION}|{silent}", f"{MENTION}|^{GAP}*(?:{silent}){GAP}*$") if silent else (MENTION, MENTION)
    whole = F.array(F.struct(F.lit("text").alias("unit"), F.lit(0).cast("long").alias("line_no"), F.sha2(canonical(low), 256).alias("digest")))
    numbered = F.transform(F.split(low, "\n", -1), lambda line, i: F.struct((i + 1).cast("long").alias("line_no"), line.alias("line")))
    telling = F.filter(numbered, lambda x: x["line"].rlike(whole_line))
    lines = F.transform(telling, lambda x: F.struct(F.lit("line").alias("unit"), x["line_no"].alias("line_no"), F.sha2(canonical(x["line"]), 256).alias("digest")))
    units = units.select("doc_id", F.inline(F.when(low.rlike(hint), F.concat(whole, lines)).otherwise(whole)))
    found = _every_digest(docs.sparkSession, known, more)
    return units.join(found if more is not None else F.broadcast(found), "digest", "left").select("doc_id", "unit", "line_no", "digest", "license_id")
