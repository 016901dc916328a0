"""Site-relative line frequency: drop lines that stand on too large a share of a host's pages.

Built-in functions only.  A line is compared as it stands; lines of white space alone are never counted or dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from relish.session import materialize


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _key(line: Column) -> Column:
    """Hash of a line; NULL for a blank one, which matches nothing."""
    return F.when(F.trim(F.regexp_replace(line, r"\s+", "")) != "", F.xxhash64(line))


def boilerplate(pages: DataFrame, text: str, host: str, max_ratio: float, min_pages: int) -> DataFrame:
    """Per host the hashes of its boilerplate lines: ``line_host, line_hashes``.

    A line is counted once a page.  As each boilerplate line is on more than ``max_ratio`` of the host's pages, a host
    has fewer than (mean lines a page / max_ratio) of them, whatever its size.
    """
    narrow = pages.select(F.col(host).alias("line_host"), F.col(text).alias("line_text"))
    totals = narrow.groupBy("line_host").agg(F.count("*").alias("host_pages"))
    keys = F.array_distinct(F.transform(_lines(F.col("line_text")), _key))
    counts = (narrow.select("line_host", F.explode(keys).alias("line_hash")).filter("line_hash is not null")
              .groupBy("line_host", "line_hash").agg(F.count("*").alias("line_pages")).filter(F.col("line_pages") >= min_pages))
    held = counts.join(totals.withColumnRenamed("line_host", "total_host"), F.col("line_host").eqNullSafe(F.col("total_host")))
    return (held.filter(F.col("line_pages") > F.lit(max_ratio) * F.col("host_pages"))
            .groupBy("line_host").agg(F.collect_list("line_hash").alias("line_hashes")))


def drop_site_lines(pages: DataFrame, text: str = "text", host: str = "source", max_ratio: float = 0.1,
                    min_pages: int = 5) -> DataFrame:
    """``pages`` with boilerplate lines cut out of ``text``, plus ``n_lines`` and ``n_dropped``.

    A line goes if more than ``max_ratio`` of the pages of its host hold it, and ``min_pages`` at least.  All other
    columns stay (an own ``n_lines`` or ``n_dropped`` is replaced).  NULL hosts are one host; a NULL text stays NULL
    with no lines; a text whose lines all go becomes empty; repeated rows are pages of their own; no rows, no result.
    """
    lists = materialize(boilerplate(pages, text, host, max_ratio, min_pages), "site_lines")
    row, found = F.struct(*[F.col(f"`{c}`") for c in pages.columns]), F.col("line_hashes")
    joined = (pages.select(row.alias("line_row"), F.col(host).alias("page_host"))
              .join(lists, F.col("page_host").eqNullSafe(F.col("line_host")), "left"))
    before = F.col(f"line_row.`{text}`")
    lines = _lines(before)
    kept = F.when(found.isNull(), lines).otherwise(F.filter(lines, lambda x: ~F.coalesce(F.array_contains(found, _key(x)), F.lit(False))))
    out = joined.select("line_row", lines.alias("line_all"), kept.alias("line_kept"))
    columns = [F.when(F.col(f"line_row.`{c}`").isNotNull(), F.array_join("line_kept", "\n")).alias(c) if c == text
               else F.col(f"line_row.`{c}`").alias(c) for c in pages.columns if c not in ("n_lines", "n_dropped")]
    n = F.coalesce(F.size("line_all"), F.lit(0))
    return out.select(*columns, F.when(before.isNull(), 0).otherwise(n).cast("long").alias("n_lines"),
                      F.when(before.isNull(), 0).otherwise(n - F.size("line_kept")).cast("long").alias("n_dropped"))
