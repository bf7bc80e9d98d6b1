"""Line dedup by site-relative frequency: a line that more than `ratio` of a host's pages contain is boilerplate.

Lines are what lies between line feeds, compared exactly; blank ones count nothing and stay. Pages are counted by host
and line hash (64 bits, so that lines themselves aren't shuffled; partial sums take in hot hosts and hot lines), and
divided by the host's pages. A host has at most (mean lines per page) / ratio boilerplate lines, so the list by host is
small. If all lists together have at most `max_broadcast` lines they are broadcast; beyond that the lists are joined by host
with a shuffle, in which Spark splits the hot hosts. All of it is DataFrame functions.

A line must be on `min_pages` pages of its host at least, so that small sites keep theirs.

Defined cases: a null text stays null and has no lines; null hosts are one host; repeated rows are pages of their own;
a text whose lines all go becomes the empty text; an empty table gives no rows; further columns stay, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.llm.common import materialize, read


def _host(column):
    return F.coalesce(F.concat(F.lit("="), column.cast("string")), F.lit(""))


def _hashes(text):
    return F.transform(F.filter(F.split(text, "\n"), lambda x: F.trim(x) != ""), lambda x: F.xxhash64(x))


def boilerplate(docs: DataFrame, *, host_col="source", text_col="text", ratio: float = 0.1, min_pages: int = 10) -> DataFrame:
    """(host, lines): for each host with boilerplate the hashes of its lines."""
    pages = docs.select(_host(F.col(host_col)).alias("host"), F.col(text_col).alias("text"))
    totals = pages.groupBy("host").agg(F.count("*").alias("pages"))
    lines = pages.select("host", F.explode(F.array_distinct(_hashes(F.col("text")))).alias("line"))
    counts = lines.groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    common = counts.join(totals, "host").where(F.col("n") > F.lit(ratio) * F.col("pages"))
    return common.groupBy("host").agg(F.sort_array(F.collect_set("line")).alias("lines"))


def _with_kept(docs: DataFrame, host_col: str, text_col: str, ratio: float, min_pages: int, max_broadcast: int) -> DataFrame:
    """(row: all columns of docs; kept: text without boilerplate; n_lines; n_dropped)."""
    known = materialize(boilerplate(docs, host_col=host_col, text_col=text_col, ratio=ratio, min_pages=min_pages), "boilerplate")
    total = known.agg(F.sum(F.size("lines"))).first()[0] or 0
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), _host(F.col(host_col)).alias("host"), F.col(text_col).alias("text"))
    joined = rows.join(F.broadcast(known) if total <= max_broadcast else known.hint("merge"), "host", "left")
    bad = F.coalesce("lines", F.array().cast("array<bigint>"))
    all_lines = F.split("text", "\n")
    kept = F.filter(all_lines, lambda x: ~F.array_contains(bad, F.xxhash64(x)))
    return joined.select("row", F.when(F.size(bad) == 0, F.col("text")).otherwise(F.array_join(kept, "\n")).alias("kept"), F.size(_hashes(F.col("text"))).cast("long").alias("n_lines"), F.size(kept).cast("long").alias("n_left"), F.size(all_lines).cast("long").alias("n_all"))


def line_report(docs: DataFrame, *, id_col="doc_id", host_col="source", text_col="text", ratio: float = 0.1, min_pages: int = 10, max_broadcast: int = 1_000_000) -> DataFrame:
    """A row for each document: doc_id, n_lines, n_dropped, kept_sha256 (null for a null text)."""
    rows = _with_kept(docs, host_col, text_col, ratio, min_pages, max_broadcast)
    count = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    null = F.col("kept").isNull()
    return rows.select(
        F.col(f"row.`{id_col}`").alias("doc_id"),
        F.when(null, 0).otherwise(F.col("n_lines")).cast("long").alias("n_lines"),
        F.when(null, 0).otherwise(count(F.col("n_all") - F.col("n_left"))).cast("long").alias("n_dropped"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def drop_boilerplate(docs: DataFrame, *, host_col="source", text_col="text", length_col: str | None = None, ratio: float = 0.1, min_pages: int = 10, max_broadcast: int = 1_000_000) -> DataFrame:
    """docs with the boilerplate lines taken out of the text, and its length in characters set anew in length_col."""
    rows = _with_kept(docs, host_col, text_col, ratio, min_pages, max_broadcast)
    new = {text_col: F.col("kept")} | ({length_col: F.length("kept").cast(docs.schema[length_col].dataType)} if length_col else {})
    return rows.select(*(new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns))


def op9_line_dedup(spark, sf_dir):
    return line_report(read(spark, sf_dir, "documents"))


SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce('=' || source, '') AS host, text, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT r, doc_id, host, generate_subscripts(ls, 1) AS i, unnest(ls) AS line FROM d WHERE text IS NOT NULL),
t AS (SELECT host, count(*) AS pages FROM d GROUP BY host),
b AS (SELECT host, line FROM l JOIN t USING (host) WHERE trim(line) <> '' GROUP BY host, line, pages HAVING count(DISTINCT r) >= 10 AND count(DISTINCT r) > 0.1 * pages),
k AS (SELECT r, count(*) FILTER (WHERE trim(l.line) <> '') AS n_lines, count(b.line) AS n_dropped, coalesce(string_agg(l.line, chr(10) ORDER BY i) FILTER (WHERE b.line IS NULL), '') AS kept FROM l LEFT JOIN b USING (host, line) GROUP BY r)
SELECT doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_dropped, 0)::BIGINT AS n_dropped, sha256(kept) AS kept_sha256 FROM d LEFT JOIN k USING (r)
"""
