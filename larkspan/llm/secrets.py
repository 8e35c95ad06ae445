"""Operator 6, secret scans with multipart credential linking, in DataFrame functions only.

Strong patterns stand alone. A weak candidate (a long token that is no secret for sure) is reported only where complementary parts occur near it: an access
identifier of a known form, or a named identifier together with an endpoint, found by an interval join of the parts within a scope of SCOPE characters.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspan.llm.shared import cut

# Patterns of the kinds, in the order in which equal starts are listed.
ASSIGN = r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"  # 18 characters or more
HEX = r"[0-9a-f]{16,}"
# Runs are possessive and start where no such character stands before, so that a match takes time and stack that don't grow faster than the text.
WEAK = r"(?<![A-Za-z0-9+/_-])(?:(?=[A-Za-z+/_-]*+[0-9])(?=[0-9+/_-]*+[A-Za-z])[A-Za-z0-9+/_-]{20,}+|[A-Za-z]{32,}+)={0,2}+(?![A-Za-z0-9+/=_-])"
ENDPOINT = r"(?:https?|ftp|s3|jdbc:[a-z]++|postgres(?:ql)?|mysql|mongodb(?:\+srv)?|redis|amqp)://[^\s\"'<>]++|(?<![A-Za-z0-9.-])[A-Za-z0-9.-]++(?<=[A-Za-z0-9-]\.amazonaws\.com)"
IDENT = r"""(?i)(?:client_?id|access_?key_?id|user(?:name)?|login|account)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]{3,}+"""

LEAST_ASSIGN = 12
CHUNK = 256
SCOPE = 512  # code points between the starts of linked parts, at most
ORDER = {"assign": 0, "access": 1, "hex": 2, "linked": 3}


def found(text: Column, pattern: str) -> Column:
    """Array of (start, stop) of the leftmost non-overlapping matches, in code points.

    What stands between the matches (split) and the matches themselves give each match's place by running sums. The sums run over CHUNK matches at a time, for
    appending to an array copies it: time grows with the number of matches, not with its square.
    """
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    sizes = F.arrays_zip(F.transform(F.split(text, pattern, -1), F.length).alias("gap"), F.transform(matches, F.length).alias("own"))
    spans = "array<struct<start:int,stop:int>>"

    def one(a: Column, x: Column) -> Column:
        start = a["at"] + x["gap"]
        return F.struct((start + x["own"]).alias("at"), F.concat(a["out"], F.array(F.struct(start.alias("start"), (start + x["own"]).alias("stop")))).alias("out"))

    def chunk(a: Column, c: Column) -> Column:
        inner = F.aggregate(c, F.struct(a["at"].alias("at"), F.array().cast(spans).alias("out")), one)
        return F.transform(F.array(inner), lambda r: F.struct(r["at"].alias("at"), F.concat(a["all"], F.array(r["out"])).alias("all")))[0]

    def every(rows: Column) -> Column:
        chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(rows) - 1) / CHUNK).cast("int")), lambda i: F.slice(rows, i * CHUNK + 1, F.lit(CHUNK)))
        return F.flatten(F.aggregate(chunks, F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{spans}>").alias("all")), chunk, lambda a: a["all"]))

    own = F.transform(F.array(F.slice(sizes, F.lit(1), F.size(matches))), every)[0]  # within a lambda, so that texts are matched once
    return F.when(F.size(matches) > 0, own).otherwise(F.array().cast(spans))


def _kind(spans: Column, kind: str) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(ORDER[kind]).alias("k"), s["stop"].alias("stop"), F.lit(kind).alias("kind")))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def parts(docs: DataFrame) -> DataFrame:
    """Each row of (__id, text) with its spans by kind; the text itself is left behind."""
    text = F.coalesce("text", F.lit(""))
    rx = F.lit(ASSIGN)
    long = F.transform(F.regexp_extract_all(text, rx, F.lit(2)), lambda v: F.length(v) >= LEAST_ASSIGN)
    assign = F.transform(F.filter(F.arrays_zip(found(text, ASSIGN).alias("s"), long.alias("ok")), lambda x: x["ok"]), lambda x: x["s"])
    none = F.array().cast("array<struct<start:int,stop:int>>")
    some = lambda pattern, given=F.lit(True): F.when(given & text.rlike(pattern), found(text, pattern)).otherwise(none)  # noqa: E731  only texts with a match are split
    complete = text.rlike(ACCESS) | (text.rlike(IDENT) & text.rlike(ENDPOINT))
    held = docs.select("__id", F.xxhash64(text).alias("__text"), F.when(text.rlike(ASSIGN), assign).otherwise(none).alias("assign"), some(ACCESS).alias("access"), some(HEX).alias("hex"), *[some(p, complete).alias(n) for n, p in (("weak", WEAK), ("ident", IDENT), ("endpoint", ENDPOINT))])
    return cut(held)


def linked(held: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Rows (__id, __text, linked): weak candidates with an access identifier, or with a named identifier and an endpoint, that start within
    ``scope`` of them.

    The interval join runs over bins of ``scope`` characters: of each complementary kind a bin needs its first and last start only, so hot texts
    make no pairs.
    """
    key = ["__id", "__text"]
    rows = held.where(F.size("weak") > 0).dropDuplicates(key)
    within = lambda w, kinds: F.exists(F.concat(*kinds), lambda p: (p["start"] <= w["start"]) & (w["stop"] <= p["stop"]))
    apart = F.filter("weak", lambda w: ~within(w, ["endpoint"]))  # a part of an endpoint complements none
    own = F.transform(apart, lambda w: F.struct(w["start"].alias("start"), w["stop"].alias("stop"), within(w, ["ident"]).alias("named")))
    weak = rows.select(*key, F.explode(own).alias("w")).select(*key, "w.*", F.expr(f"start div {scope}").cast("int").alias("bin"))

    def near(candidates: DataFrame, kind: str) -> DataFrame:
        bins = rows.select(*key, F.explode(kind).alias("p")).groupBy(*key, F.expr(f"p.start div {scope}").cast("int").alias("bin")).agg(F.min("p.start").alias("lo"), F.max("p.start").alias("hi"))
        bins = bins.select(*key, F.explode(F.array(F.col("bin") - 1, F.col("bin"), F.col("bin") + 1)).alias("bin"), "lo", "hi")
        # of a bin the first or last start is the nearest, or the candidate lies between them within one bin
        ok = (F.least(F.abs(F.col("start") - F.col("lo")), F.abs(F.col("start") - F.col("hi"))) <= scope) | ((F.col("lo") <= F.col("start")) & (F.col("start") <= F.col("hi")))
        keyed = reduce(lambda a, b: a & b, [candidates[c].eqNullSafe(bins[c]) for c in (*key, "bin")])
        return candidates.join(bins, keyed & ok, "left_semi")

    both = near(weak, "access").union(near(near(weak.where("not named"), "ident"), "endpoint"))  # nor is an identifier's value the secret to it
    return both.groupBy(*key).agg(F.collect_set(F.struct("start", "stop")).alias("linked"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """One row for each input row: id_col, n_assign, n_access, n_hex, base_sha256, spans (kind:start:end, comma-joined, by start), n_linked.

    Places count code points, ends are exclusive. A null or empty text has no spans. A linked span that lies in a base span is left out, as
    its place is reported already. Repeated rows each get their result; rows with equal ids and different texts are kept apart. Other columns are not
    read. An empty table gives an empty one. Whole texts are searched.
    """
    held = parts(docs.select(F.col(f"`{id_col}`").alias("__id"), F.col(f"`{text_col}`").alias("text")))
    extra = linked(held, scope).withColumnsRenamed({"__id": "__i2", "__text": "__t2"})
    out = held.join(extra, F.col("__id").eqNullSafe(F.col("__i2")) & (F.col("__text") == F.col("__t2")), "left")
    base = F.concat(_kind(F.col("assign"), "assign"), _kind(F.col("access"), "access"), _kind(F.col("hex"), "hex"))
    more = F.filter(F.coalesce("linked", F.array().cast("array<struct<start:int,stop:int>>")), lambda w: ~F.exists(F.concat("assign", "access", "hex"), lambda b: (b["start"] <= w["start"]) & (w["stop"] <= b["stop"])))
    counted = [F.size(k).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")]
    return out.select(F.col("__id").alias(id_col), *counted, F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"), _joined(F.concat(base, _kind(more, "linked"))).alias("spans"), F.size(more).cast("long").alias("n_linked"))
