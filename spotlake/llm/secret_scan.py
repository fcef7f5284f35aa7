"""Secret scan with multipart credential linking; DataFrame functions only.

Strong kinds (assign, access, hex) are reported wherever their pattern holds. Weak kinds (an account name, a bare
key-like token, an endpoint) are parts of a credential: an interval join looks for complementary parts that start
within ``SCOPE`` characters in the same text, and a weak part is only reported next to those.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spotlake.llm.tables import checked_broadcast, fresh, stored

# Kind, role in a credential, pattern, group that must be long, its least length.
_VALUE = "[A-Za-z0-9+/_.=-]+"
_SIGN = r"[\"']?\x20*[:=]\x20*[\"']?"
KINDS = (
    ("assign", "secret", rf"(?i:(password|passwd|secret|token|api_?key)){_SIGN}({_VALUE})", 2, 8),
    ("access", "id", "AKIA[A-Z0-9]+", 0, 16),
    ("hex", "", "[0-9a-f]{32,}", 0, 32),  # the same spans as [0-9a-f]+ of 32 and more characters
    ("id", "id", rf"(?i:\b(?:user(?:_?name)?|login|account|client_?id|access_?key(?:_?id)?)){_SIGN}([A-Za-z0-9_.@+-]+)", 1, 3),
    ("key", "secret", r"\b[A-Za-z0-9_/+-]{20,}", 0, 20),
    ("endpoint", "endpoint", r"\b(?:https?|jdbc:[a-z]+|ftp|ssh|redis|mongodb|postgres(?:ql)?|mysql|amqp)://[^\x20\x09-\x0D\"'<>]+", 0, 8),
)
HOLDS = {"key": ("[0-9]", "[a-z]", "[A-Z]")}  # what a match must contain
STRONG = ("assign", "access", "hex")
NEEDS = {"id": ("secret",), "key": ("id",), "endpoint": ("id", "secret")}  # roles that must be in scope
SCOPE = 400
MASK = "[SECRET]"


def _pieces(text: Column) -> Column:
    """array<struct<kind_no,nth,gap,length,passed>>: each match with the number of characters since the last one."""
    kind = "array<struct<kind_no:int,nth:int,gap:int,length:int,passed:boolean>>"
    return F.concat(*[F.coalesce(F.when(text.rlike(k[2]), _matches(text, no)), F.array().cast(kind)) for no, k in enumerate(KINDS)])


def _matches(text: Column, no: int) -> Column:
    name, _, pattern, group, least = KINDS[no]

    def passes(value: Column) -> Column:
        out = F.char_length(value) >= least
        for needed in HOLDS.get(name, ()):
            out = out & value.rlike(needed)
        return out

    parts, found, tested = F.split(text, pattern, -1), *(F.regexp_extract_all(text, F.lit(pattern), F.lit(g)) for g in (0, group))
    bound = F.array(F.struct(parts.alias("parts"), found.alias("found"), tested.alias("tested")))  # each computed once
    each = F.transform(bound, lambda b: F.transform(b["found"], lambda m, i: F.struct(
        F.lit(no).alias("kind_no"), i.alias("nth"), F.char_length(F.get(b["parts"], i)).alias("gap"), F.char_length(m).alias("length"),
        passes(F.get(b["tested"], i)).alias("passed"))))
    return each[0]


def _scanned(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return stored(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.sha2(text, 256).alias("text_sha256"), _pieces(text).alias("pieces")), "pieces")


def _spans(scanned: DataFrame, scope: int) -> DataFrame:
    """(row, kind_no, start, end) of all reported spans."""
    order = Window.partitionBy("row", "kind_no").orderBy("nth")
    placed = scanned.select("row", F.inline("pieces")).withColumn("end", F.sum((F.col("gap") + F.col("length")).cast("long")).over(order))
    spans = stored(placed.where("passed").select("row", "kind_no", (F.col("end") - F.col("length")).alias("start"), "end"), "spans")
    strong = F.col("kind_no") < len(STRONG)
    # The nearest part of each role before and after a place lies at the rim of its own cell, so rims suffice.
    role = F.element_at(F.array(*[F.lit(k[1]) for k in KINDS]), F.col("kind_no") + 1)
    parts = spans.select("row", role.alias("role"), "start").where("role <> ''")
    cell = F.floor(F.col("start") / scope)
    rims = parts.groupBy("row", "role", cell.alias("at")).agg(F.min("start").alias("low"), F.max("start").alias("high"))
    rims = rims.select("row", "role", "low", "high", F.explode(F.array(*[F.col("at") + d for d in (-1, 0, 1)])).alias("cell"))
    weak = spans.where(~strong).withColumn("cell", cell)
    met = weak.join(rims, ["row", "cell"]).where(
        F.col("start").between(F.col("low") - scope, F.col("low") + scope) | F.col("start").between(F.col("high") - scope, F.col("high") + scope))
    roles = met.groupBy("row", "kind_no", "start", "end").agg(F.collect_set("role").alias("roles"))
    complete = F.lit(False)
    for no, kind in enumerate(KINDS):
        if kind[0] in NEEDS:
            complete = complete | ((F.col("kind_no") == no) & F.arrays_overlap("roles", F.array(F.lit(NEEDS[kind[0]][0]))))
            for more in NEEDS[kind[0]][1:]:
                complete = complete & ((F.col("kind_no") != no) | F.array_contains("roles", more))
    return spans.where(strong).union(roles.where(complete).select("row", "kind_no", "start", "end"))


def scan_secrets(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """(row, doc_id, text_sha256, spans) for every row of ``docs``; spans is array<struct<start,kind_no,end>>, sorted.

    Positions count code points from 0, the end is exclusive. Null texts count as empty; texts without a secret
    have an empty array; repeated rows are scanned each; other columns are ignored.
    """
    scanned = _scanned(docs)
    each = _spans(scanned, scope).groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "kind_no", "end"))).alias("spans"))
    joined = scanned.select("row", "doc_id", "text_sha256").join(each, "row", "left")
    return joined.select("row", "doc_id", "text_sha256", F.coalesce("spans", F.array().cast("array<struct<start:bigint,kind_no:int,end:bigint>>")).alias("spans"))


def redact_secrets(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """``docs`` with each reported span replaced by a mask; n_chars, if there, follows the new text.

    The text of a document is cut at its own spans only, which are looked up by the digest of the text.
    """
    found = stored(scan_secrets(docs, scope).where(F.size("spans") > 0).select("text_sha256", "spans"), "found")
    by_text = stored(found.groupBy("text_sha256").agg(F.first("spans").alias("spans")), "by_text")
    digest, spans, key = (fresh(docs, n) for n in ("text_sha256", "spans", "secret_key"))
    right = checked_broadcast(by_text).select(F.col("text_sha256").alias(key), F.col("spans").alias(spans))
    joined = docs.withColumn(digest, F.sha2(F.coalesce("text", F.lit("")), 256))
    joined = joined.join(right, joined[digest] == right[key], "left")
    # Each span with the furthest end before it: what lies between that end and the span's start stays.
    ends = F.transform(F.array(F.col(spans)), lambda s: F.transform(s, lambda x, i: F.struct(
        x["start"].alias("start"), F.greatest(F.lit(0).cast("long"), F.array_max(F.transform(F.slice(s, 1, i), lambda y: y["end"]))).alias("before"))))[0]
    kept = F.transform(F.filter(ends, lambda x, i: (x["start"] >= x["before"])), lambda x: F.substr("text", (x["before"] + 1).cast("int"), (x["start"] - x["before"]).cast("int")))
    tail = F.substr(F.col("text"), (F.array_max(F.transform(F.col(spans), lambda x: x["end"])) + 1).cast("int"))
    masked = F.concat(F.array_join(F.concat(kept, F.array(tail)), MASK))
    columns = {c: F.col(c) for c in docs.columns}
    hit = F.col(spans).isNotNull()
    columns["text"] = F.when(hit, masked).otherwise(F.col("text"))
    out = joined.select(*[v.alias(c) for c, v in columns.items()])
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        flag = joined.select(*[columns[c].alias(c) for c in docs.columns], hit.alias(spans))
        out = flag.select(*[F.when(F.col(spans), F.char_length("text").cast(kind)).otherwise(F.col(c)).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])
    return out
