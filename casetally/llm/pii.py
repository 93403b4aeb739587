"""Operator 10: personal data by patterns and by information-theoretic sanitisation, in DataFrame operations only.

Mail addresses, IP addresses, card numbers and telephone numbers are found by pattern. Each distinct value is
a protected entity. Terms that occur in the same documents may reveal it: over the whole corpus, the disclosure
of entity e by term t is PMI(t, e) / IC(e), the information that t gives about e as a share of all the
information in e, from the numbers of documents with e, with t, and with both. It is 1 if t occurs nowhere else.
A term whose disclosure reaches the threshold, and which is seen with e in enough documents, is a span of its
own wherever it occurs, also in documents without e. What lies within values is no term. Sanitised texts replace
values and terms by the name of their kind.

The patterns start only where a run of their first characters starts, or where the last match ended, and
give nothing back once matched: the same matches, without the quadratic search in long runs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

DISCLOSURE, SUPPORT = 0.9, 3
TERM = r"[A-Za-z\x{80}-\x{10FFFF}]{4,}"
KINDS = ("email", "ip", "card", "phone")
_LOCAL = "A-Za-z0-9._%+-"
PATTERNS = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must contain for a pattern to match at all.
_NEEDS = {"email": "@", "ip": ".", "phone": "+"}
_NO_SPANS = "array<struct<start:int,end:int,value:string>>"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _valid(kind: str, value: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        part = F.transform(F.split(value, r"\."), lambda x: F.regexp_replace(x, "^0+(?=.)", ""))
        return F.forall(part, lambda x: (F.length(x) <= 3) & (F.substring(x, 1, 3).cast("int") <= 255))
    digits = _digits(value)
    if kind == "card":
        return F.length(digits).between(16, 19) & F.call_function("luhn_check", digits)
    return F.length(digits).between(8, 15)


def _matches(text: Column, pattern: str, keep: Callable[[Column], Column] | None = None) -> Column:
    """All matches, or those to keep, as (start, end, value) in code points: lengths of what lies between them, added up."""
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.arrays_zip(F.slice(F.transform(F.split(text, pattern, -1), lambda x: F.length(x)), 1, F.size(values)).alias("gap"), values.alias("value"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(_NO_SPANS).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        a = acc["at"] + x["gap"]
        b = a + F.length(x["value"])
        more = F.concat(acc["out"], F.array(F.struct(a.alias("start"), b.alias("end"), x["value"].alias("value"))))
        return F.struct(b.alias("at"), (F.when(keep(x["value"]), more).otherwise(acc["out"]) if keep else more).alias("out"))

    return F.aggregate(pairs, start, step, lambda acc: acc["out"])


def _base(text: Column, kind: str) -> Column:
    likely = F.contains(text, F.lit(_NEEDS[kind])) if kind in _NEEDS else F.lit(True)
    found = F.when(likely & text.rlike(PATTERNS[kind]), F.filter(_matches(text, PATTERNS[kind]), lambda s: _valid(kind, s["value"])))
    return F.coalesce(found, F.array().cast(_NO_SPANS))


def _written(spans: Column, kind: str) -> Column:
    return F.transform(spans, lambda s: F.concat_ws(":", F.lit(kind), s["start"].cast("string"), s["end"].cast("string")))


def base_spans(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, h, text, email, ip, card, phone): the valid matches of each kind; h is a hash of the text."""
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    return rows.select("doc_id", F.xxhash64("text").alias("h"), "text", *(_base(F.col("text"), k).alias(k) for k in KINDS))


def _entity(kind: str, value: Column) -> Column:
    plain = {"email": F.lower, "ip": lambda x: x}.get(kind, _digits)
    return F.concat(F.lit(f"{kind}:"), plain(value))


def _entities() -> Column:
    def of(kind: str) -> Column:
        return F.transform(kind, lambda s: _entity(kind, s["value"]))

    return F.array_distinct(F.concat(*map(of, KINDS)))


def _named(kind: str) -> Column:
    name = F.lit(f"[{kind.upper().removesuffix('S')}]").alias("name")
    return F.transform(kind, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), name))


def _terms() -> Column:
    """The distinct terms of a text outside its values, in lower case."""
    spans = F.array_sort(F.concat(*(F.transform(k, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))) for k in KINDS)))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        piece = F.substring(F.col("text"), acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["out"], F.array(piece)).alias("out"))

    def joined(acc: Column) -> Column:
        return F.array_join(F.concat(acc["out"], F.array(F.substring(F.col("text"), acc["at"] + 1, F.length("text")))), "\n")

    outside = F.when(F.size(spans) > 0, F.aggregate(spans, start, step, joined)).otherwise(F.col("text"))
    return F.array_distinct(F.regexp_extract_all(F.lower(outside), F.lit(TERM), F.lit(0)))


def disclosing(found: DataFrame, threshold: float = DISCLOSURE, support: int = SUPPORT) -> DataFrame:
    """The pairs (entity, term, disclosure) that disclose. ``found`` has (doc_id, h, text) and the values of each row.

    Documents are counted, not mentions; all counts cover the whole corpus. A document gives as many pairs as it
    has entities, of those in enough documents, times terms.
    """
    some = found.where(F.size(F.concat(*KINDS)) > 0).dropDuplicates(["doc_id", "h"])
    within = some.select(F.explode(_entities()).alias("entity"), _terms().alias("terms"))
    n_e = written(some.select(F.explode(_entities()).alias("entity")).groupBy("entity").agg(F.count("*").alias("n_e")).where(F.col("n_e") >= support), "pii-entities")
    pairs = within.join(n_e, "entity").select("entity", "n_e", F.explode("terms").alias("term"))
    pairs = written(pairs.groupBy("entity", "n_e", "term").agg(F.count("*").alias("n_te")).where(F.col("n_te") >= support), "pii-pairs")
    n_t = found.select(F.explode(_terms()).alias("term")).groupBy("term").agg(F.count("*").alias("n_t"))
    n = found.count()
    # All words are counted before the join: a term then meets its count once, however often it occurs.
    counted = pairs.join(n_t, "term")
    information = F.log(F.lit(float(max(n, 1))) / F.col("n_e"))
    shared = F.log(F.lit(float(max(n, 1))) * F.col("n_te") / (F.col("n_t") * F.col("n_e")))
    disclosed = counted.withColumn("disclosure", F.when(information > 0, shared / information)).where(F.col("disclosure") >= threshold)
    return written(disclosed.select("entity", "term", "disclosure"), "pii-disclosing")


def find(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = DISCLOSURE, support: int = SUPPORT) -> DataFrame:
    """(doc_id, h, email, ip, card, phone, terms) for each row: spans (start, end, value) in code points, end exclusive.

    Null texts count as empty. Rows of equal key and text get equal spans, each row its own result; they count
    as one document. A null key is a key like any other. A term within a span of the patterns is not one.
    """
    found = written(base_spans(docs, key, text), "pii-found")
    pairs = disclosing(found, threshold, support)
    telling = written(pairs.select("term").distinct(), "pii-terms")
    keyed = found.withColumn("k", F.coalesce("doc_id", F.lit(-1))).withColumn("no_key", F.col("doc_id").isNull())
    hits = (
        keyed.select("k", "no_key", "h", F.explode(_terms()).alias("term"))
        .join(telling, "term", "left_semi")
        .groupBy("k", "no_key", "h")
        .agg(F.collect_set("term").alias("hits"))
    )
    joined = keyed.join(written(hits, "pii-hits"), ["k", "no_key", "h"], "left")
    base_of = F.concat(*KINDS)
    # Only texts with such a term are read again for its places.
    places = F.when(F.col("hits").isNotNull(), _matches(F.col("text"), TERM, lambda v: F.array_contains("hits", F.lower(v))))
    terms = F.filter(
        F.coalesce(F.transform(places, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lower(s["value"]).alias("value"))), F.array().cast(_NO_SPANS)),
        lambda t: ~F.exists(base_of, lambda b: (t["start"] < b["end"]) & (b["start"] < t["end"])),
    )
    return joined.select("doc_id", "h", *KINDS, terms.alias("terms"))


def report(found: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, n_term, base_sha256, spans) from the spans of each row."""
    base = F.concat(*(_written(F.col(k), k) for k in KINDS))
    every = F.concat(base, _written(F.col("terms"), "term"))
    return found.select(
        "doc_id",
        *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS),
        F.size("terms").cast("long").alias("n_term"),
        F.sha2(F.array_join(base, ","), 256).alias("base_sha256"),
        F.array_join(every, ",").alias("spans"),
    )


def sanitise(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """(doc_id, text): each text once per key, with values and disclosing terms generalised to the name of their kind.

    Where spans overlap, the one that starts first counts, then the longer.
    """
    found = find(docs, key, text, **options).dropDuplicates(["doc_id", "h"])
    rows = docs.select(F.col(key).cast("long").alias("_k"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).distinct().withColumn("_h", F.xxhash64("text"))
    named = F.concat(*(_named(k) for k in (*KINDS, "terms")))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        more = F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, s["start"] - acc["at"]), s["name"])
        return F.when(s["start"] < acc["at"], acc).otherwise(F.struct((-s["back"]).alias("at"), more.alias("out")))

    made = F.aggregate(
        F.sort_array(named), start, step, lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.length("text")))
    )
    return rows.join(found, rows["_k"].eqNullSafe(found["doc_id"]) & (rows["_h"] == found["h"])).select("doc_id", made.alias("text"))
