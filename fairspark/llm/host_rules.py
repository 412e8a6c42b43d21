"""Operator 2, quality rules by host: failures of each rule are counted by host, their rates shrunk towards the rule's beta prior, fitted to all hosts, and the verdicts joined back."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, table, word_array

SYMBOLS = "#*$%&|<>"
#: What a document must not be; over the signals, in integers, so that Spark and SQL agree. The first two are the base rules.
RULES = {
    "short": "n_words < 50",
    "repetitive": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > 3 * n_words",
    "dup_lines": "10 * n_dup_lines > 3 * n_lines",
    "word_length": "n_words > 0 AND (word_chars < 3 * n_words OR word_chars > 10 * n_words)",
}
BASE = ("short", "repetitive")


def signals(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", host_column: str = "source") -> DataFrame:
    """One row per document: id, host, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words; JVM only, no shuffle."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(host_column).cast("string").alias("host"), F.col(text_column).alias("text"))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    rows = rows.select("doc_id", "host", word_array(F.col("text")).alias("w"), lines.alias("l"), F.length(F.translate(text, " \t\n\x0b\x0c\r", "")).alias("word_chars"), (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).alias("n_symbols"))
    last = F.size("w") - 3
    at = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    rows = rows.withColumn("h", F.transform(at, lambda i: F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2))))
    rows = rows.select("doc_id", "host", F.size("w").cast("long").alias("n_words"), F.col("word_chars").cast("long").alias("word_chars"), F.col("n_symbols").cast("long").alias("n_symbols"), F.size("l").cast("long").alias("n_lines"), (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"), "h", F.size(F.array_distinct("h")).alias("different"))
    # Only texts that repeat a window sort (hash, position); windows equal to a neighbour are the repeated ones.
    z = F.when(F.size("h") > F.col("different"), F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))
    rows = rows.withColumn("z", z).drop("h")
    same = F.filter("z", lambda x, i: F.coalesce(F.get("z", i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get("z", i + 1)["h"] == x["h"], F.lit(False)))
    rows = rows.withColumn("p", F.transform(same, lambda x: x["i"])).drop("z")
    covered = F.array_distinct(F.concat("p", F.transform("p", lambda i: i + 1), F.transform("p", lambda i: i + 2)))
    return rows.select("doc_id", "host", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", F.size(covered).cast("long").alias("n_repeat_words"))


def host_verdicts(rows: DataFrame, rules: Sequence[str], lift: float = 1.5, least_rate: float = 0.25, deviations: float = 2.0) -> tuple[DataFrame, int, int]:
    """(host, n_docs, host_rates, host_rules) of rows (host and a boolean for each rule), and the numbers of hosts and of rows.

    host_rates: for each rule (failed + a) / (docs + a + b), where the rule's a and b fit the mean and the variance of the
    hosts' rates beyond what sampling explains (1 to 10**6 pseudo-documents in all). host_rules: the rules that condemn the
    host, comma-joined: those whose rate, less `deviations` of its posterior, is over `lift` times the rate of all documents
    and over least_rate. Hosts that differ no more than chance would have it are shrunk to the mean, and none is condemned.
    """
    counts = [F.sum(F.col(r).cast("long")).alias(r) for r in rules]
    hosts = rows.groupBy("host").agg(F.count(F.lit(1)).alias("n_docs"), *counts)
    each = [x for r in rules for x in (F.avg(F.col(r) / F.col("n_docs")).alias(f"mean_{r}"), F.var_pop(F.col(r) / F.col("n_docs")).alias(f"var_{r}"), F.sum(r).alias(f"all_{r}"))]
    got = hosts.agg(F.count(F.lit(1)).alias("n"), F.sum("n_docs").alias("docs"), F.avg(1 / F.col("n_docs")).alias("each"), *each).first()
    docs = got["docs"] or 0
    rates, condemned = [], []
    for r in rules:
        mean = got[f"mean_{r}"] or 0.0
        noise = mean * (1 - mean)
        beyond = max((got[f"var_{r}"] or 0.0) - noise * (got["each"] or 0.0), 0.0)
        strength = min(max(noise / beyond - 1, 1.0), 1e6) if beyond > 0 else 1e6 if noise > 0 else 1.0
        rate = (F.col(r) + mean * strength) / (F.col("n_docs") + strength)
        low = rate - deviations * F.sqrt(rate * (1 - rate) / (F.col("n_docs") + strength + 1))
        rates.append(rate.alias(r))
        condemned.append(F.when(low > max(least_rate, lift * (got[f"all_{r}"] or 0) / max(docs, 1)), F.lit(r)))
    return hosts.select("host", "n_docs", F.struct(*rates).alias("host_rates"), F.concat_ws(",", *condemned).alias("host_rules")), got["n"], docs


def host_filter(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", host_column: str = "source", lift: float = 1.5, least_rate: float = 0.25, broadcast_hosts: int = 100_000) -> DataFrame:
    """One row per row of docs: doc_id, host, the signals, a boolean for each of RULES, base_failed, host_rates, host_rules and kept.

    kept is false if a base rule fails (under 50 words; over half of the words in repeated 3-word windows) or if a rule
    condemns the host (see host_verdicts). A null or empty text has no words and is short. Null hosts form one host; repeated
    rows count and return each; an empty table returns none; other columns of docs are neither read nor returned.
    Repeated windows are found by 64-bit hashes within a text. The signals are computed once and kept as a narrow table.
    Verdicts are broadcast if there are broadcast_hosts hosts at most. Beyond, only those of hosts with over a thousandth of
    the rows are, under a thousand; the other rows are joined by host.
    """
    rows = signals(docs, id_column, text_column, host_column)
    rows = rows.select("*", *[F.expr(rule).alias(name) for name, rule in RULES.items()])
    rows = cut(rows.withColumn("base_failed", F.greatest(*[F.col(r) for r in BASE])))
    verdicts, n, n_docs = host_verdicts(rows, list(RULES), lift, least_rate)
    joined = lambda some, v: some.join(v.withColumnRenamed("host", "__host"), F.col("host").eqNullSafe(F.col("__host")))
    if n <= broadcast_hosts:
        out = joined(rows, F.broadcast(verdicts))
    else:
        verdicts = cut(verdicts)
        hot = F.broadcast(verdicts.where(F.col("n_docs") * 1000 > n_docs))
        rest = rows.join(hot.select(F.col("host").alias("__host")), F.col("host").eqNullSafe(F.col("__host")), "left_anti")
        out = joined(rows, hot).unionByName(joined(rest, verdicts))
    return out.select(*rows.columns, "host_rates", "host_rules", (~F.col("base_failed") & (F.col("host_rules") == "")).alias("kept"))


def op2_host_rules(spark, sf_dir: str) -> DataFrame:
    out = host_filter(table(spark, sf_dir, "documents"))
    worst = F.round(F.greatest(*[F.col(f"host_rates.{r}") for r in RULES]), 9)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", worst.alias("host_rate"), "host_rules", "kept")


def _sql_each(form: str) -> str:
    return ", ".join(form.replace("RULE", r).replace("TEST", test) for r, test in RULES.items())


OP2_SQL = f"""
WITH t AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, source, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM t),
g AS (SELECT doc_id, i, w[i:i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g) WHERE n > 1),
p AS (SELECT doc_id, count(DISTINCT j) AS n_repeat_words FROM (SELECT doc_id, unnest(range(i, i + 3)) AS j FROM r) GROUP BY doc_id),
s AS (SELECT doc_id, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
             CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols, CAST(len(l) AS BIGINT) AS n_lines,
             CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
      FROM w LEFT JOIN p USING (doc_id)),
b AS (SELECT *, {_sql_each('TEST AS RULE')} FROM s),
h AS (SELECT source, count(*) AS n, {_sql_each('sum(CAST(RULE AS BIGINT)) AS RULE')} FROM b GROUP BY source),
m AS (SELECT sum(n) AS docs, avg(1 / n) AS each, {_sql_each('avg(RULE / n) AS m_RULE, var_pop(RULE / n) AS v_RULE, sum(RULE) AS a_RULE')} FROM h),
k AS (SELECT *, {_sql_each("""CASE WHEN v_RULE - m_RULE * (1 - m_RULE) * each > 0 THEN least(greatest(m_RULE * (1 - m_RULE) / (v_RULE - m_RULE * (1 - m_RULE) * each) - 1, 1), 1e6)
                        WHEN m_RULE * (1 - m_RULE) > 0 THEN 1e6 ELSE 1 END::DOUBLE AS s_RULE""")} FROM m),
u AS (SELECT source, n, k.*, {_sql_each('(RULE + m_RULE * s_RULE) / (n + s_RULE) AS r_RULE')} FROM h, k),
v AS (SELECT source, greatest({_sql_each('r_RULE')}) AS host_rate, concat_ws(',', {_sql_each("CASE WHEN r_RULE - 2 * sqrt(r_RULE * (1 - r_RULE) / (n + s_RULE + 1)) > greatest(0.25, 1.5 * a_RULE / docs) THEN 'RULE' END")}) AS host_rules FROM u)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, {' OR '.join(BASE)} AS base_failed, round(host_rate, 9) AS host_rate, host_rules, NOT ({' OR '.join(BASE)}) AND host_rules = '' AS kept
FROM b JOIN v ON b.source IS NOT DISTINCT FROM v.source
"""
