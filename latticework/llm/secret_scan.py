"""Secret scans in SQL functions: strong spans alone, weak ones only beside complementary parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latticework.functions.durable import written
from latticework.llm.spans import merged, replaced

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Kinds in the order of the output: pattern, role, whether it stands alone. Of an assignment, the value needs 8 characters.
KINDS = [
    ("assign", ASSIGN, "secret", True),
    ("access", r"AKIA[A-Z0-9]{12,}", "identifier", True),
    ("hex", r"[0-9a-f]{32,}", "secret", True),
    ("user", r"""(?i)\b(?:user(?:name|_id)?|login|client_?id|account_?id|tenant_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9._@+-]{3,}""", "identifier", False),
    ("opaque", r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])[A-Za-z0-9+/_=-]{20,}", "secret", False),
    ("endpoint", r"""(?i)\b(?:https?|ssh|s?ftp|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[^\s"'<>]{3,}""", "endpoint", False),
]
MATCH = "struct<kind:int,nth:int,gap:int,len:int,ok:boolean>"


def _fresh(name: str, taken: list[str]) -> str:
    return name if name.lower() not in {t.lower() for t in taken} else _fresh(f"_{name}", taken)


def _pieces(text: Column, number: int, pattern: str) -> Column:
    """Of each match: the characters since the match before, and its own; in order."""
    match = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    ok = (lambda m: F.length(F.regexp_extract(m, pattern, 2)) >= 8) if pattern == ASSIGN else F.isnotnull
    both = F.zip_with(gaps, match, lambda g, m: F.struct(g.alias("gap"), m.alias("own")))  # the text after the last match has no match of its own
    found = F.transform(both, lambda x, i: F.struct(F.lit(number).alias("kind"), i.alias("nth"), x["gap"].alias("gap"), F.length(x["own"]).alias("len"), ok(x["own"]).alias("ok")))
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(f"array<{MATCH}>"))


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = 200) -> DataFrame:
    """``(uid, doc_id, kind, start, end)``: each span, and one row of null kind for each document.

    Places are code points, end exclusive; matches of one kind don't overlap. Strong kinds always
    stay. A weak part stays when a part of another role (identifier, secret, endpoint) begins or ends within ``scope``
    characters of it and one of the two is a secret: an equi-join on cells of ``scope`` characters, in which only so many parts have room. Null
    and empty texts have no spans; other columns are ignored; repeated rows have their own uid; empty in, empty out.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    head = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    rows = head.select("uid", "doc_id", F.explode(F.concat(F.array(F.lit(None).cast(MATCH)), *[_pieces(F.col("text"), n, k[1]) for n, k in enumerate(KINDS)])).alias("x")).select("uid", "doc_id", "x.*")
    end = F.expr("sum(gap + len) over (partition by uid, kind order by nth rows unbounded preceding)")
    parts = rows.withColumn("end", end.cast("int")).where("ok or kind is null").select("uid", "doc_id", "kind", (F.col("end") - F.col("len")).alias("start"), "end")
    parts = written(parts)
    role = F.element_at(F.array(*[F.lit(k[2]) for k in KINDS]), F.col("kind") + 1)
    placed = parts.where("kind is not null").withColumn("role", role)
    weak = [n for n, k in enumerate(KINDS) if not k[3]]
    cells = lambda a, b: F.explode(F.sequence((a / scope).cast("int"), (b / scope).cast("int"))).alias("cell")
    low = placed.where(F.col("kind").isin(weak)).select("uid", "kind", "start", "end", "role", cells(F.greatest(F.col("start") - scope, F.lit(0)), F.col("end") + scope))
    ends = placed.select("uid", F.col("role").alias("r2"), F.col("start").alias("s2"), F.col("end").alias("e2"), F.explode(F.array_distinct(F.array((F.col("start") / scope).cast("int"), (F.col("end") / scope).cast("int")))).alias("cell"))
    meets = (F.col("role") != F.col("r2")) & ((F.col("role") == "secret") | (F.col("r2") == "secret")) & (F.col("s2") - F.col("end") <= scope) & (F.col("start") - F.col("e2") <= scope)
    confirmed = low.join(ends, ["uid", "cell"]).where(meets).select("uid", "kind", "start", "end").distinct()
    strong = parts.where(F.col("kind").isNull() | ~F.col("kind").isin(weak))
    return strong.unionByName(confirmed.withColumn("doc_id", F.lit(None).cast("long")))


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = 200) -> DataFrame:
    """One row ``(uid, doc_id, found)`` a document; found is the sorted array of (start, kind number, end)."""
    one = F.when(F.col("kind").isNotNull(), F.struct("start", "kind", "end"))
    return spans(docs, id_col, text_col, scope).groupBy("uid").agg(F.max("doc_id").alias("doc_id"), F.array_sort(F.collect_list(one)).alias("found"))


def digest(found: Column, kinds: int) -> Column:
    """kind:start:end of the first ``kinds`` kinds, comma-joined."""
    names = F.array(*[F.lit(k[0]) for k in KINDS])
    own = F.filter(found, lambda x: x["kind"] < kinds)
    return F.concat_ws(",", F.transform(own, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))))


def redacted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mask: str = "[REDACTED]", scope: int = 200) -> DataFrame:
    """The rows of ``docs`` with every reported span of the text replaced by ``mask``; overlapping spans are one.

    Null and empty texts stay as they are; repeated rows and rows without an id are masked one by one; other columns,
    whatever their names, are kept; empty in, empty out.
    """
    own, found = _fresh("_row", docs.columns), _fresh("_found", docs.columns)
    docs = written(docs.withColumn(own, F.monotonically_increasing_id()))
    hits = spans(docs.select(F.col(own).alias("doc_id"), F.col(text_col).alias("text")), scope=scope)
    # confirmed weak spans carry no doc_id of their own; their uid's other rows have it
    rows = hits.groupBy("uid").agg(F.max("doc_id").alias(own), F.array_sort(F.collect_list(F.when(F.col("kind").isNotNull(), F.struct("start", "end")))).alias(found)).where(F.size(found) > 0).drop("uid")
    rows = rows.withColumn(found, merged(found, [("start", "end")]))
    new = replaced(F.col(text_col), found, "start", "end", mask)
    out = docs.join(rows, own, "left")
    return out.select(*[(new if c == text_col else F.col(c)).alias(c) for c in docs.columns if c != own])
