"""Secrets in texts, DataFrame functions only: certain spans, and weak ones linked by an interval join.

Some patterns are findings by themselves (`BASE`). Others are weak: an access identifier, a mixed token or an endpoint
alone says little. These are reported only when a complementary part (identifier or endpoint with a secret) lies
within the same scope and apart from it, found by joining parts on scope buckets of the document and comparing their
places. A mixed token inside an endpoint or a login is a piece of that part (a path, a name) and no candidate.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewater.llm.base import materialize, read

#: Code points between the starts of two parts of one credential.
SCOPE = 200
MASK = "[REDACTED]"


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    #: identifier, secret or endpoint
    role: str
    weak: bool = False
    #: least length of a group that a match needs, and further patterns that it must hold
    group: int = 0
    least: int = 1
    holds: tuple[str, ...] = ()


#: In the order that breaks ties of start. A run of 24+ hex digits or 20+ access characters can be asked for in the
#: pattern, as a run starts at the same place; an assignment's short value can hide a later keyword, so it is tested after.
KINDS = (
    Kind("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", "secret", group=2, least=6),
    Kind("access", r"AKIA[A-Z0-9]{16,}", "identifier"),
    Kind("hex", r"[0-9a-f]{24,}", "secret"),
    Kind("login", r"""(?i:user(?:name)?|login|account|client_?id|access_?key_?id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._-]+)""", "identifier", weak=True, group=1, least=3),
    Kind("mixed", r"[A-Za-z0-9+/_-]{20,}={0,2}", "secret", weak=True, holds=("[0-9]", "[A-Z]", "[a-z]")),
    Kind("endpoint", r"""(?:https?|ftp|jdbc:[a-z]+|postgres|mysql|redis|mongodb)://[^\x20\x09-\x0D"'<>]+""", "endpoint", weak=True),
)

#: Kinds whose matches can hold a mixed token that is only a piece of them.
MIXED = [k.name for k in KINDS].index("mixed")
WIDE = [i for i, k in enumerate(KINDS) if k.name in ("login", "endpoint")]


def _found(text: Column, kind: Kind) -> Column:
    """Array of (gap before, length, ok) of the kind's matches from left to right; null without any."""
    ok = lambda m: F.length(F.regexp_extract(m, kind.pattern, kind.group) if kind.group else m) >= kind.least
    holds = lambda m: [F.regexp_like(m, F.lit(p)) for p in kind.holds]

    def row(gap: Column, m: Column) -> Column:
        good = ok(m)
        for h in holds(m):
            good = good & h
        return F.struct(F.length(gap).cast("long").alias("gap"), F.length(m).cast("long").alias("length"), good.alias("ok"))

    found = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    # the pieces between matches; the one after the last match is not needed
    pieces = F.slice(F.split(text, kind.pattern, -1), F.lit(1), F.size(found))
    return F.when(F.regexp_like(text, F.lit(kind.pattern)), F.zip_with(pieces, found, row))


def matches(text_col: str = "text") -> Column:
    """Array of (kind, found) for the kinds that match in the text; a null text is empty."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = [F.struct(F.lit(i).alias("kind"), _found(text, k).alias("found")) for i, k in enumerate(KINDS)]
    return F.filter(F.array(*found), lambda x: x["found"].isNotNull())


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_uid, doc_id, found): the matches of every kind in each row's whole text, without the text; _uid numbers the rows."""
    return docs.select(F.monotonically_increasing_id().alias("_uid"), F.col(id_col).alias("doc_id"), matches(text_col).alias("found"))


def spans(scanned: DataFrame) -> DataFrame:
    """(_uid, kind, start, end) of the certain spans and of the weak ones that a complementary part supports."""
    kinds = scanned.select("_uid", F.explode("found").alias("k")).select("_uid", F.col("k.kind").alias("kind"), F.posexplode("k.found").alias("i", "m"))
    so_far = Window.partitionBy("_uid", "kind").orderBy("i")
    placed = kinds.withColumn("end", F.sum(F.col("m.gap") + F.col("m.length")).over(so_far)).where("m.ok").select("_uid", "kind", (F.col("end") - F.col("m.length")).alias("start"), "end")
    # how far the wide parts that start here or before reach; the wide kinds stand first where starts are equal
    wide = F.col("kind").isin(WIDE)
    reach = F.max(F.when(wide, F.col("end"))).over(Window.partitionBy("_uid").orderBy("start", F.when(wide, 0).otherwise(1)))
    placed = placed.withColumn("inside", F.coalesce((F.col("kind") == MIXED) & (reach >= F.col("end")), F.lit(False))).where("not inside").drop("inside")
    parts = materialize(placed, "parts")
    weak = [i for i, k in enumerate(KINDS) if k.weak]
    role = F.create_map(*(x for i, k in enumerate(KINDS) for x in (F.lit(i), F.lit("secret" if k.role == "secret" else "other"))))[F.col("kind")]
    bucket = F.floor(F.col("start") / SCOPE)
    left = parts.where(F.col("kind").isin(weak)).withColumn("role", role).withColumn("bucket", F.explode(F.sequence(bucket - 1, bucket + 1)))
    right = parts.select(F.col("_uid").alias("u"), F.col("start").alias("at"), F.col("end").alias("to"), role.alias("other"), bucket.alias("b"))
    apart = (left["end"] <= right["at"]) | (right["to"] <= left["start"])
    near = (left["_uid"] == right["u"]) & (left["bucket"] == right["b"]) & (left["role"] != right["other"]) & apart & (F.abs(left["start"] - right["at"]) <= SCOPE)
    linked = left.join(right, near, "left_semi").select("_uid", "kind", "start", "end").distinct()
    return parts.where(~F.col("kind").isin(weak)).union(linked)


def secret_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, counts of the certain kinds, base_sha256, spans (kind:start:end, in code points).

    Null and empty texts have no spans, counts of zero and the hash of the empty string; rows that repeat, also by
    doc_id, are reported each by themselves; a null doc_id is kept; spans that start together stand in the order of
    KINDS. An empty table gives no rows. Whole texts are searched, however long: a text's matches are one array of
    offsets, its parts meet by scope bucket. Other columns of docs are not looked at, whatever their names.
    """
    scanned = materialize(scan(docs, id_col, text_col), "scanned")
    each = spans(scanned).groupBy("_uid").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end"))).alias("spans"))
    name = F.array(*(F.lit(k.name) for k in KINDS))
    said = lambda a: F.concat_ws(",", F.transform(a, lambda s: F.concat_ws(":", name[s["kind"]], s["start"], s["end"])))
    all_spans = F.coalesce("spans", F.expr("array()").cast("array<struct<start:bigint,kind:int,end:bigint>>"))
    base = F.filter(all_spans, lambda s: s["kind"].isin([i for i, k in enumerate(KINDS) if not k.weak]))
    count = lambda i: F.size(F.filter(all_spans, lambda s: s["kind"] == i)).cast("long").alias(f"n_{KINDS[i].name}")
    rows = scanned.select("_uid", "doc_id").join(each, "_uid", "left")
    return rows.select("doc_id", count(0), count(1), count(2), F.sha2(said(base), 256).alias("base_sha256"), said(all_spans).alias("spans"))


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with every reported secret and access identifier masked in the text; endpoints and logins stay readable.

    All rows and columns are kept, repeated rows each by themselves; null and empty texts stay as they are, and an empty
    table stays empty. Overlapping spans become one mask. Columns may have any names.
    """
    hidden = [i for i, k in enumerate(KINDS) if not k.weak or k.role == "secret"]
    # written with row numbers and matches, so that only rows with a match are shuffled with their text
    rows = materialize(docs.select(F.struct(*docs.columns).alias("row"), F.monotonically_increasing_id().alias("_uid"), matches(text_col).alias("found")), "scanned")
    before = Window.partitionBy("_uid").orderBy("start", "end", "kind").rowsBetween(Window.unboundedPreceding, -1)
    cuts = spans(rows.select("_uid", "found")).where(F.col("kind").isin(hidden)).withColumn("from", F.coalesce(F.max("end").over(before), F.lit(0)))
    cuts = cuts.groupBy("_uid").agg(F.array_sort(F.collect_list(F.struct("start", "from", "end"))).alias("cuts"))
    some = rows.where(F.size("found") > 0).select("row", "_uid").join(cuts, "_uid", "left")
    text = F.col("row")[text_col]
    # where a cut starts before the last one ended, it adds nothing but what it reaches beyond
    piece = lambda c: F.when(c["start"] >= c["from"], F.concat(F.substring(text, c["from"].cast("int") + 1, (c["start"] - c["from"]).cast("int")), F.lit(MASK))).otherwise(F.lit(""))
    rest = F.substring(text, F.array_max(F.transform("cuts", lambda c: c["end"])).cast("int") + 1, F.length(text))
    masked = F.when(F.col("cuts").isNull(), text).otherwise(F.concat(F.concat_ws("", F.transform("cuts", piece)), rest))
    some = some.select(F.col("row").withField(text_col, masked).alias("row"))
    return rows.where(F.size("found") == 0).select("row").union(some).select("row.*")


def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_report(read(spark, sf_dir, "documents"))
