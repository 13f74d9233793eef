"""Site-relative boilerplate lines.

A line is boilerplate on a host if the share of the host's pages that have it
exceeds a ratio. Line texts are shuffled as 128-bit digests only; a page's
digests are counted once per (host, line) with map-side combine, so a line of
very many pages is no hot key, and the join that tells pages their boilerplate
lines is an equi-join that the skew rule can split. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cabline.llm.common import stored

#: A line goes if over this share of its host's pages has it ...
MAX_RATIO = 0.1
#: ... and as many pages at least: what stands on one page repeats nothing, however few pages the host has.
MIN_PAGES = 2

# FIXED VALUES: markup that isn't shown, and tags that end a line.
HIDDEN = r"(?is)<(?:script|style)[^>]*>.*?</(?:script|style)>|<!--.*?-->"
BREAKS = r"(?i)</?(?:address|article|aside|blockquote|body|br|dd|div|dl|dt|footer|h[1-6]|head|header|hr|html|li|main|nav|ol|p|pre|section|table|td|th|title|tr|ul)(?:\s[^>]*)?/?>"
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)"


def normal(line: Column) -> Column:
    """The line as compared: white space trimmed and collapsed."""
    return F.trim(F.regexp_replace(line, r"[ \t\r\f]+", " "))


def _digest(line: Column) -> Column:
    return F.unhex(F.md5(normal(line)))


def drop_boilerplate(pages: DataFrame, max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES, once: bool = False) -> DataFrame:
    """``pages`` (id, host, lines array<string>, ...) with ``kept``: the lines that aren't boilerplate, in order.

    A line counts once a page; lines that are empty once trimmed are kept and
    never counted. Each row is a page, repeated rows too; rows that share an id
    and host lose the same lines. A null host is a host, null lines are no
    lines, a null id is one id. With ``once``, pages of a host with the same
    lines count as one page, so copies don't make their own lines boilerplate;
    all of them still lose what is. Further columns come along; none may be
    called line, pages, n, dropped, hit_id, hit_host, page or shown.
    """
    pages = pages.withColumns({"host": F.coalesce("host", F.lit("")), "lines": F.coalesce("lines", F.array().cast("array<string>"))})
    shown = F.array_distinct(F.transform(F.filter("lines", lambda x: normal(x) != ""), _digest))
    seen = pages.select("id", "host", F.explode(shown).alias("line"))
    counted, totals = seen, pages
    if once:
        named = pages.select("host", F.unhex(F.md5(F.array_join("lines", "\n", ""))).alias("page"), shown.alias("shown"))
        counted = named.groupBy("host", "page").agg(F.first("shown").alias("shown")).select("host", F.explode("shown").alias("line"))
        totals = named.select("host", "page").distinct()
    totals = totals.groupBy("host").agg(F.count("*").alias("pages"))
    often = counted.groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    common = often.join(totals, "host").where(F.col("n") / F.col("pages") > max_ratio).select("host", "line")
    hits = seen.join(common, ["host", "line"]).groupBy("id", "host").agg(F.collect_set("line").alias("dropped"))
    hits = hits.select(F.col("id").alias("hit_id"), F.col("host").alias("hit_host"), "dropped")
    both = pages.join(hits, F.col("id").eqNullSafe(F.col("hit_id")) & (F.col("host") == F.col("hit_host")), "left")
    keep = lambda x: (normal(x) == "") | ~F.array_contains("dropped", _digest(x))
    return both.select(*pages.columns, F.when(F.col("dropped").isNull(), F.col("lines")).otherwise(F.filter("lines", keep)).alias("kept"))


def page_lines(pages: DataFrame) -> DataFrame:
    """(id, host, lines) of ``pages`` (page_id, url, html): the shown lines of the page, not empty."""
    text = F.regexp_replace(F.coalesce(pages["html"], F.lit("")), HIDDEN, "")
    parts = F.split(F.regexp_replace(text, BREAKS, "\n"), "\n")
    lines = F.filter(F.transform(parts, lambda x: normal(F.regexp_replace(x, "<[^>]*>", ""))), lambda x: x != "")
    host = F.lower(F.regexp_extract(F.coalesce(pages["url"], F.lit("")), HOST, 1))
    return pages.select(pages["page_id"].cast("long").alias("id"), host.alias("host"), lines.alias("lines"))


def clean_pages(pages: DataFrame, max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(page_id, host, n_lines, n_dropped, text) for every row of ``pages`` (page_id, url, html).

    A null or empty html has no lines and an empty text; a null url has the
    empty host. See ``drop_boilerplate`` for repeated rows. An empty table
    gives an empty result; other columns are left out. The lines are stored
    once, so markup is parsed once.
    """
    out = drop_boilerplate(stored(page_lines(pages), "page-lines"), max_ratio, min_pages)
    n = F.size("lines").cast("long")
    return out.select(F.col("id").alias("page_id"), "host", n.alias("n_lines"), (n - F.size("kept")).cast("long").alias("n_dropped"), F.array_join("kept", "\n").alias("text"))


PAGES_SQL = rf"""
WITH l AS (
  SELECT page_id, lower(regexp_extract(coalesce(url, ''), '{HOST}', 1)) AS host,
    list_filter(list_transform(string_split(regexp_replace(regexp_replace(coalesce(html, ''), '{HIDDEN}', '', 'g'), '{BREAKS}', chr(10), 'g'), chr(10)),
      lambda x: trim(regexp_replace(regexp_replace(x, '<[^>]*>', '', 'g'), '[ \t\r\f]+', ' ', 'g'), ' ')), lambda x: x <> '') AS lines
  FROM pages),
f AS (SELECT host, line, count(*) AS n FROM (SELECT host, unnest(list_distinct(lines)) AS line FROM l) GROUP BY ALL),
t AS (SELECT host, count(*) AS pages FROM l GROUP BY host),
c AS (SELECT host, list(line) AS dropped FROM f JOIN t USING (host) WHERE n >= {MIN_PAGES} AND n / pages > {MAX_RATIO} GROUP BY host),
k AS (SELECT page_id, host, lines, list_filter(lines, lambda x: NOT list_contains(coalesce(dropped, []), x)) AS kept FROM l LEFT JOIN c USING (host))
SELECT page_id, host, len(lines) AS n_lines, len(lines) - len(kept) AS n_dropped, coalesce(array_to_string(kept, chr(10)), '') AS text FROM k
"""
