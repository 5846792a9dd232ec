"""Line dedup by site-relative frequency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventide.llm.common import cut, fresh

#: Up to so many boilerplate lines, over all hosts, their hashes are broadcast (8 bytes each).
BROADCAST_LINES = 1_000_000


def _hashes(text: Column) -> Column:
    return F.transform(F.split(text, "\n", -1), lambda x: F.xxhash64(F.trim(x)))


def line_dedup(
    docs: DataFrame, ratio: float = 0.05, min_pages: int = 5, text: str = "text", host: str = "source", n_dropped: str | None = None, broadcast_lines: int = BROADCAST_LINES
) -> DataFrame:
    """Drop from each page the lines that exceed a share of the pages of its host.

    A line is what lies between newlines, compared without leading and trailing spaces and by a 64-bit
    hash. For each host, the pages that contain a line (a page counts once, however often it repeats the
    line) are divided by the host's pages; a line goes from all pages of that host where the quotient is
    greater than ``ratio`` and at least ``min_pages`` pages have it. All columns and rows stay, text is
    replaced, and n_chars, if there is one, follows it; ``n_dropped`` names a count column to add.

    Only hashes and counts are shuffled. A host has at most (lines per page) / ratio boilerplate lines, so
    they travel as one array per host, broadcast while their number over all hosts is within
    ``broadcast_lines`` and joined by shuffle beyond it.

    Null text stays null. Null host: the page belongs to no site and stays as it is, uncounted. Blank
    lines are never dropped. A text of which all lines go becomes ''. Repeated rows count as pages each.
    Empty table: empty result. Other columns, whatever their names, pass through.
    """
    mine = docs.select(F.col(host).alias("h"), F.col(text).alias("t")).where(F.col("h").isNotNull())
    blank = F.xxhash64(F.lit(""))
    lines = mine.select("h", F.explode(F.array_distinct(_hashes(F.col("t")))).alias("x")).where(F.col("x") != blank)
    counts = lines.groupBy("h", "x").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    totals = mine.groupBy("h").agg(F.count("*").alias("pages"))
    often = cut(counts.join(totals, "h").where(F.col("n") / F.col("pages") > ratio).groupBy("h").agg(F.collect_list("x").alias("bad")))
    n = often.agg(F.sum(F.size("bad"))).first()[0] or 0
    h2, bad, kept = fresh(docs, "dedup_host"), fresh(docs, "dedup_bad"), fresh(docs, "dedup_kept")
    side = often.select(F.col("h").alias(h2), F.col("bad").alias(bad))
    joined = docs.join(F.broadcast(side) if n <= broadcast_lines else side, docs[host] == F.col(h2), "left")
    all_lines = F.split(F.col(text), "\n", -1)
    stay = F.filter(all_lines, lambda x: ~F.array_contains(F.col(bad), F.xxhash64(F.trim(x))))
    joined = joined.withColumn(kept, F.when(F.col(bad).isNull() | F.col(text).isNull(), F.lit(None)).otherwise(stay))
    new_text = F.when(F.col(kept).isNull(), F.col(text)).otherwise(F.array_join(F.col(kept), "\n"))
    out = []
    for c in docs.columns:
        if c.lower() == text.lower():
            out.append(new_text.alias(c))
        elif c.lower() == "n_chars":
            out.append(F.when(F.col(kept).isNull(), F.col(c)).otherwise(F.length(new_text)).cast(docs.schema[c].dataType).alias(c))
        else:
            out.append(F.col(f"`{c}`"))
    if n_dropped:
        out.append(F.when(F.col(kept).isNull(), 0).otherwise(F.size(all_lines) - F.size(kept)).cast("long").alias(n_dropped))
    return joined.select(*out)


SQL = """
WITH p AS (SELECT row_number() OVER () AS rid, doc_id, source, text FROM documents),
l AS (SELECT rid, doc_id, source, i, string_split(text, chr(10))[i] AS ln
      FROM (SELECT *, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM p)),
t AS (SELECT source, count(*) AS pages FROM p GROUP BY source),
b AS (SELECT l.source, trim(ln) AS k FROM l JOIN t ON l.source = t.source WHERE trim(ln) <> ''
      GROUP BY l.source, trim(ln), pages HAVING count(DISTINCT rid) >= 5 AND count(DISTINCT rid) / pages > 0.05),
r AS (SELECT rid, coalesce(string_agg(ln, chr(10) ORDER BY i) FILTER (b.k IS NULL), '') AS text, count(b.k) AS n_dropped
      FROM l LEFT JOIN b ON l.source = b.source AND trim(ln) = b.k GROUP BY rid)
SELECT p.doc_id, p.source, r.text, coalesce(r.n_dropped, 0)::BIGINT AS n_dropped FROM p LEFT JOIN r ON p.rid = r.rid
"""
