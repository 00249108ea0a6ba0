r"""Secret scans: strong patterns plus multipart credential linking, in DataFrame functions only.

Base spans are leftmost non-overlapping matches (whole match, code points, end exclusive). Weak candidates
(identifiers, short or loosely named secrets, endpoints) are reported only if the parts that complete them start
within ``SCOPE`` code points in the same document: an interval join on (document, scope cell), whose sides are first
reduced to the first and last start of each class in a cell, so no pairs of parts are made.

Defined cases: a null text is an empty one; rows with null or repeated ids each keep a row (parts are linked within
a row's own id and text); overlapping kinds are all reported; an empty table gives no row; other columns are not
looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm._common import materialize, text_of

SCOPE = 200
KINDS = ["assign", "access", "hex", "identifier", "weak_secret", "endpoint"]
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"  # a run of 18 or more: the same spans as a run of any length that is then measured
HEX = r"[0-9a-f]{16,}"
IDENTIFIER = r"""\b(?:user(?:name|_id)?|login|client_?id|account(?:_?id)?|access_?key(?:_?id)?)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@_.-]{3,}"""
LOOSE = r"""\b(?:pwd|pass|passphrase|auth|credentials?|private_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=!@#$%-]{6,}"""
ENDPOINT = r"\b(?:https?|ftp|postgres(?:ql)?|mysql|redis|mongodb|s3|jdbc:[a-z]{2,})://[A-Za-z0-9._~:-]{3,}"
#: Group 1: access identifiers, 2: secrets under looser names, 3: endpoints. Each is scanned alone: one may begin inside another.
WEAK = f"(?i)({IDENTIFIER})|({LOOSE})|({ENDPOINT})"


def running(lengths: Column) -> Column:
    """Inclusive running sums of an array, in blocks of 256 so that long arrays stay near-linear."""
    grow = lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x))
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / 256).cast("int")), lambda c: F.slice(lengths, c * 256 + 1, 256))
    totals = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0).cast("long"), lambda s, x: s + x))
    offsets = F.aggregate(totals, F.array(F.lit(0).cast("long")), grow)
    inner = F.transform(blocks, lambda b, i: F.slice(F.aggregate(b, F.array(F.get(offsets, i)), grow), 2, 256))
    return F.when(F.size(lengths) > 0, F.flatten(inner)).otherwise(F.array().cast("array<bigint>"))


def _positions(df: DataFrame, name: str, pattern: str) -> DataFrame:
    """Adds ``name``: array of (start, end, value) of the matches of ``pattern`` in ``_text``.

    ``split`` gives the text between matches; its lengths and the matches' give positions. Only rows that have a
    match run the pattern a second time.
    """
    p, gaps, found = F.lit(pattern), f"_gaps_{name}", f"_found_{name}"
    df = df.withColumn(gaps, F.split("_text", pattern, -1))
    df = df.withColumn(found, F.when(F.size(gaps) > 1, F.regexp_extract_all("_text", p, F.lit(0))).otherwise(F.array().cast("array<string>")))
    lens = F.transform(F.col(found), lambda m, i: F.char_length(F.get(F.col(gaps), i)).cast("long") + F.when(i > 0, F.char_length(F.get(F.col(found), i - 1))).otherwise(0))
    df = df.withColumn(f"_starts_{name}", F.when(F.size(found) > 0, running(lens)).otherwise(F.array().cast("array<bigint>")))
    span = lambda m, s: F.struct(s.alias("start"), (s + F.char_length(m)).alias("end"), m.alias("value"))
    return df.withColumn(name, F.zip_with(found, f"_starts_{name}", span)).drop(gaps, found, f"_starts_{name}")


def _spans(items: str, kind: int, keep=None) -> Column:
    col = F.col(items) if keep is None else F.filter(items, keep)
    return F.transform(col, lambda x: F.struct(x["start"].alias("start"), F.lit(kind).alias("kind"), x["end"].alias("end")))


def _secret_length(value: Column) -> Column:
    return F.char_length(F.regexp_extract(value, ASSIGN, 2))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """A row per document: id, ``base`` and ``linked``, arrays of (start, kind, end); kind indexes ``KINDS``."""
    df = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("_text"))
    for name, pattern in (("a", ASSIGN), ("k", ACCESS), ("h", HEX), ("i", f"(?i){IDENTIFIER}"), ("l", f"(?i){LOOSE}"), ("e", f"(?i){ENDPOINT}")):
        df = _positions(df, name, pattern)
    base = F.array_sort(F.concat(_spans("a", 0, lambda x: _secret_length(x["value"]) >= 12), _spans("k", 1), _spans("h", 2)))
    weak = F.concat(
        _spans("i", 3),
        _spans("l", 4),
        _spans("a", 4, lambda x: _secret_length(x["value"]).between(6, 11)),
        _spans("e", 5),
    )
    df = df.select("id", "_text", base.alias("base"), F.array_distinct(weak).alias("weak"))
    key = F.when(F.size("weak") > 0, F.md5(F.concat_ws("|", F.lit("row"), F.col("id").cast("string"), "_text")))
    df = materialize(df.select("id", "base", "weak", key.alias("key")), "secret_parts")

    kind_class = F.when(F.col("p.kind").isin(1, 3), "I").when(F.col("p.kind") == 5, "E").otherwise("S")
    parts = df.where(F.col("key").isNotNull()).select("key", F.explode(F.concat("base", "weak")).alias("p")).distinct()
    parts = parts.select("key", "p", F.col("p.start").alias("at"), kind_class.alias("cls"), F.floor(F.col("p.start") / scope).alias("cell"))
    cells = parts.groupBy("key", "cell", "cls").agg(F.min("at").alias("lo"), F.max("at").alias("hi"))
    cells = cells.select("key", F.col("cls").alias("other"), "lo", "hi", F.explode(F.array(F.col("cell") - 1, F.col("cell"), F.col("cell") + 1)).alias("cell"))
    near = (F.col("lo") - F.col("at") <= scope) & (F.col("at") - F.col("hi") <= scope)  # the cell's nearest start is in reach
    has = lambda c: F.max((F.col("other") == c).cast("int")) == 1
    met = parts.where("p.kind >= 3").join(cells.hint("merge"), ["key", "cell"]).where(near).groupBy("key", "p", "cls").agg(has("I").alias("i"), has("S").alias("s"), has("E").alias("e"))
    full = met.where("(cls = 'I' AND s) OR (cls = 'S' AND (i OR e)) OR (cls = 'E' AND i AND s)")
    linked = full.groupBy("key").agg(F.array_sort(F.collect_set("p")).alias("linked"))
    empty = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    return df.join(linked, "key", "left").select(F.col("id").alias(id_col), "base", F.coalesce("linked", empty).alias("linked"))


def listed(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.concat_ws(",", F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))))


def op1(docs: DataFrame) -> DataFrame:
    found = find_secrets(docs)
    n = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long")
    return found.select("doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.concat("base", "linked")).alias("spans"))
