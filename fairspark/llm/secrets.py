"""Operator 5, secret scans with multipart credential linking.

Patterns give spans of certain secrets and of weak candidates (identifiers, keys, endpoints). Where they overlap, one part
remains: certain secrets come before identifiers, these before endpoints, these before keys. An interval join by cells of
the text pairs each weak candidate with the other parts near it; it is reported only if complementary ones stand in its scope.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, table

_ANY_CASE = lambda word: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)
ASSIGN = f"(?:{'|'.join(map(_ANY_CASE, ('password', 'passwd', 'secret', 'token', 'api_?key')))})" + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS, HEX = "AKIA[A-Z0-9]{14,}", "[0-9a-f]{16,}"
#: Weak kinds: shorter or other identifiers, long mixed runs, URLs and addresses.
IDENT, KEY, ENDPOINT = "(?:AKIA|ASIA|AROA|AIDA)[A-Z0-9]{8,}", "[A-Za-z0-9+/_-]{20,}", r"""(?:[a-z][a-z0-9+.-]{0,15}://[^\x20\x09-\x0D"'<>]+|[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?::[0-9]+)?)"""
KINDS = ("assign", "access", "hex", "ident", "key", "endpoint")
#: Of overlapping weak candidates the first kind remains.
PRECEDENCE = ("ident", "endpoint", "key")
_SPAN = "array<struct<start:int,rank:int,end:int>>"
#: A cheap condition without which a pattern cannot match.
_HINT = {IDENT: "AKIA|ASIA|AROA|AIDA", ENDPOINT: r"[a-z0-9+.-]://|[0-9]\.[0-9]"}


def spans(text: Column, pattern: str, rank: int, good=None) -> Column:
    """All leftmost non-overlapping matches as (start, rank, end) in code points, end exclusive; good drops matches by their text.

    What stands between the matches comes from a split by the same pattern; running lengths give the positions.
    """
    found, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    step = F.zip_with(between, found, lambda b, m: F.struct(F.length(b).alias("b"), m.alias("m")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("out"))

    def add(state, x):
        begin = state["at"] + x["b"]
        end = begin + F.length(x["m"])
        span = F.array(F.struct(begin.alias("start"), F.lit(rank).alias("rank"), end.alias("end"))).cast(_SPAN)
        more = span if good is None else F.when(good(x["m"]), span).otherwise(F.array().cast(_SPAN))
        return F.when(x["m"].isNull(), state).otherwise(F.struct(end.alias("at"), F.concat(state["out"], more).alias("out")))

    return F.when(text.rlike(_HINT.get(pattern, pattern)), F.aggregate(step, start, add, lambda s: s["out"])).otherwise(F.array().cast(_SPAN))


def joined(column: Column) -> Column:
    """kind:start:end, comma-joined, by start, then kind as listed."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(column), lambda s: F.concat_ws(":", F.element_at(kinds, s["rank"] + 1), s["start"], s["end"])), ",")


def _apart(parts: DataFrame) -> DataFrame:
    """The parts (th, tl, start, rank, end) without those that overlap a part of higher precedence that stays.

    Two running bounds in the order of the starts settle a kind at a time: how far the parts before reach, and where the
    next one begins. The work is that of sorting the spans of one text.
    """
    before = W.partitionBy("th", "tl").orderBy("start", "order").rowsBetween(W.unboundedPreceding, -1)
    after = W.partitionBy("th", "tl").orderBy(F.desc("start"), F.desc("order")).rowsBetween(W.unboundedPreceding, -1)
    parts = parts.withColumn("order", F.element_at(F.array(*[F.lit(PRECEDENCE.index(k) if k in PRECEDENCE else -1) for k in KINDS]), F.col("rank") + 1))
    for k in range(len(PRECEDENCE)):
        first = F.col("order") < k
        reach, following = F.max(F.when(first, F.col("end"))).over(before), F.min(F.when(first, F.col("start"))).over(after)
        parts = parts.withColumn("reach", reach).withColumn("following", following)
        overlaps = F.coalesce(F.col("reach") > F.col("start"), F.lit(False)) | F.coalesce(F.col("following") < F.col("end"), F.lit(False))
        parts = parts.where((F.col("order") != k) | ~overlaps).drop("reach", "following")
    return parts.drop("order")


def scan(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", scope: int = 200) -> DataFrame:
    """One row per row of docs: doc_id, base and added, both arrays of (start, rank, end) with rank an index into KINDS.

    base holds assignments with a value of 12 characters or more, access identifiers of 18 or more, hex runs of 16 or more.
    added holds weak candidates, none of which overlaps a base span or another, whose complementary parts lie within `scope`
    code points: an identifier needs a secret (assign, hex or key); a key (20 characters or more, with letter and digit) an
    identifier or an endpoint; an endpoint both an identifier and a secret. No part complements itself. A null or empty text
    has none; texts that are equal give equal spans, so repeated rows are linked once; an empty table returns none; other
    columns are neither read nor returned.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text")).select("doc_id", text.alias("text"))
    mixed = lambda m: m.rlike("[0-9]") & m.rlike("[A-Za-z]")
    base = F.concat(spans(F.col("text"), ASSIGN, 0, lambda m: F.length(F.regexp_extract(m, ASSIGN, 1)) >= 12), spans(F.col("text"), ACCESS, 1), spans(F.col("text"), HEX, 2))
    weak = F.concat(spans(F.col("text"), IDENT, 3), spans(F.col("text"), KEY, 4, mixed), spans(F.col("text"), ENDPOINT, 5))
    rows = cut(rows.select("doc_id", F.xxhash64("text").alias("th"), F.length("text").alias("tl"), base.alias("base"), weak.alias("weak")))
    linkable = F.expr("size(weak) > 0 and size(weak) + size(base) > 1")
    parts = rows.where(linkable).select("th", "tl", "base", "weak").dropDuplicates(["th", "tl"])
    parts = _apart(parts.select("th", "tl", F.explode(F.concat("base", "weak")).alias("s")).select("th", "tl", "s.*"))
    cell = lambda c: F.floor(F.col(c) / scope)
    data = parts.select("th", "tl", F.explode(F.sequence(cell("start"), cell("end"))).alias("cell"), F.col("start").alias("s2"), F.col("end").alias("e2"), F.col("rank").alias("r2"))
    asks = parts.where("rank >= 3").select("*", F.explode(F.sequence(cell("start") - 1, cell("end") + 1)).alias("cell"))
    gap = F.greatest(F.col("s2") - F.col("end"), F.col("start") - F.col("e2"))  # negative where two spans overlap, as a span does itself
    near = asks.join(data, ["th", "tl", "cell"]).where((gap >= 0) & (gap <= scope))
    flags = near.groupBy("th", "tl", "start", "rank", "end").agg(F.max(F.col("r2").isin(1, 3)).alias("ident"), F.max(F.col("r2").isin(0, 2, 4)).alias("secret"), F.max(F.col("r2") == 5).alias("endpoint"))
    linked = flags.where((F.col("rank") == 3) & F.col("secret") | (F.col("rank") == 4) & (F.col("ident") | F.col("endpoint")) | (F.col("rank") == 5) & F.col("ident") & F.col("secret"))
    added = linked.groupBy("th", "tl").agg(F.collect_list(F.struct("start", "rank", "end")).alias("added"))
    without = F.array().cast(_SPAN)
    found = rows.where(linkable).join(added, ["th", "tl"], "left").select("doc_id", "base", F.coalesce("added", without).alias("added"))
    return rows.where(~linkable).select("doc_id", "base", without.alias("added")).unionAll(found)


def op5_secrets(spark, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    count = lambda rank: F.size(F.filter("base", lambda s: s["rank"] == rank)).cast("long")
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.concat("base", "added")).alias("spans"))


def _sql_spans(name: str, pattern: str, rank: int, good: str) -> str:
    p = pattern.replace("'", "''")
    return f"""{name} AS (SELECT doc_id, {rank} AS rank, start, start + length(m) AS "end" FROM (
    SELECT doc_id, m, CAST(list_sum(list_transform(b[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(f[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS start
    FROM (SELECT doc_id, b, f, unnest(f) AS m, unnest(range(1, len(f) + 1)) AS i FROM (SELECT doc_id, string_split_regex(text, '{p}') AS b, regexp_extract_all(text, '{p}') AS f FROM d))) WHERE {good})"""


def _sql_apart(name: str, kind: str, first: str) -> str:
    return f"""{name} AS (SELECT * FROM {kind} w WHERE NOT EXISTS (SELECT 1 FROM {first} b WHERE b.doc_id = w.doc_id AND b.start < w."end" AND w.start < b."end"))"""


_TRUE = "true"
_MIXED = "regexp_matches(m, '[0-9]') AND regexp_matches(m, '[A-Za-z]')"
_ASSIGN_SQL = ASSIGN.replace("'", "''")
OP5_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
{_sql_spans('s0', ASSIGN, 0, f"length(regexp_extract(m, '{_ASSIGN_SQL}', 1)) >= 12")},
{_sql_spans('s1', ACCESS, 1, _TRUE)}, {_sql_spans('s2', HEX, 2, _TRUE)}, {_sql_spans('s3', IDENT, 3, _TRUE)}, {_sql_spans('s4', KEY, 4, _MIXED)}, {_sql_spans('s5', ENDPOINT, 5, _TRUE)},
base AS (FROM s0 UNION ALL FROM s1 UNION ALL FROM s2),
{_sql_apart('w3', 's3', 'base')}, f3 AS (FROM base UNION ALL FROM w3),
{_sql_apart('w5', 's5', 'f3')}, f5 AS (FROM f3 UNION ALL FROM w5),
{_sql_apart('w4', 's4', 'f5')}, part AS (FROM f5 UNION ALL FROM w4),
weak AS (FROM part WHERE rank >= 3),
near AS (SELECT w.doc_id, w.rank, w.start, w."end", bool_or(p.rank IN (1, 3)) AS ident, bool_or(p.rank IN (0, 2, 4)) AS secret, bool_or(p.rank = 5) AS endpoint
         FROM weak w JOIN part p ON p.doc_id = w.doc_id AND greatest(p.start - w."end", w.start - p."end") BETWEEN 0 AND 200 GROUP BY ALL),
full_list AS (SELECT doc_id, rank, start, "end" FROM base UNION ALL SELECT doc_id, rank, start, "end" FROM near
         WHERE rank = 3 AND secret OR rank = 4 AND (ident OR endpoint) OR rank = 5 AND ident AND secret),
k AS (SELECT *, ['assign', 'access', 'hex', 'ident', 'key', 'endpoint'][rank + 1] || ':' || start || ':' || "end" AS s FROM full_list),
g AS (SELECT doc_id, count(*) FILTER (WHERE rank = 0) AS n_assign, count(*) FILTER (WHERE rank = 1) AS n_access, count(*) FILTER (WHERE rank = 2) AS n_hex,
             string_agg(s, ',' ORDER BY start, rank) FILTER (WHERE rank < 3) AS base, string_agg(s, ',' ORDER BY start, rank) AS spans FROM k GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (doc_id)
"""
