"""Site-relative line dedup: lines that too large a share of a host's pages contain are boilerplate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimforge.llm.urlfilter import host_of
from claimforge.operators.storage import materialize

#: A line goes when more than this share of its host's pages contain it, on hosts of any size; a line that only one
#: page contains is no repeat.
MAX_RATIO = 0.3
MIN_SUPPORT = 2
#: Copies of a host's boilerplate list, so that a hot host's pages are spread over as many tasks.
SALTS = 32

# What ends a line of a page, and what is no text.
BLOCK_TAGS = r"(?i)</?(?:p|div|li|ul|ol|h[1-6]|br|tr|td|th|table|nav|footer|header|article|section|title|head|body|html|blockquote|pre)\b[^>]*>"
NO_TEXT = r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>"


def html_lines(html: Column) -> Column:
    """The visible lines of a page, trimmed, none empty."""
    text = F.regexp_replace(F.regexp_replace(html, NO_TEXT, " "), BLOCK_TAGS, "\n")
    return text_lines(F.regexp_replace(text, "<[^>]*>", ""))


def text_lines(text: Column) -> Column:
    """The lines of a text, trimmed, none empty; null has none."""
    trimmed = F.transform(F.split(F.coalesce(text, F.lit("")), r"\n"), lambda x: F.regexp_replace(x, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", ""))
    return F.filter(trimmed, lambda x: x != "")


def boilerplate(lines: DataFrame, max_ratio: float = MAX_RATIO, min_pages: int = 1) -> DataFrame:
    """(site, marks): the hashes of each site's boilerplate, from rows (site, hashes).

    Pages per site and per line of a site are partial sums before any shuffle. Each listed line is on
    more than ``max_ratio`` of the pages, so a list holds at most the mean lines of a page
    divided by ``max_ratio``: it can be gathered whatever the size of the site.
    """
    pages = lines.groupBy("site").agg(F.count("*").alias("pages")).where(F.col("pages") >= min_pages)
    holding = lines.select("site", F.explode(F.array_distinct("hashes")).alias("mark")).groupBy("site", "mark").agg(F.count("*").alias("n"))
    frequent = materialize(holding.where(F.col("n") >= MIN_SUPPORT), "line-counts").join(materialize(pages, "line-pages"), "site").where(F.col("n") > F.col("pages") * max_ratio)
    return frequent.groupBy("site").agg(F.sort_array(F.collect_list("mark")).alias("marks"))


def site_line_dedup(pages: DataFrame, id_col: str = "page_id", site: Column | None = None, lines: Column | None = None, max_ratio: float = MAX_RATIO, min_pages: int = 1) -> DataFrame:
    """(page_id, site, n_lines, n_dropped, text): every page without its site's boilerplate lines.

    ``site`` and ``lines`` are columns of ``pages`` (by default the host of ``url`` and the lines of
    ``html``). A line counts once a page, and goes when at least two pages and more than ``max_ratio`` of the site's contain it.
    Sites of fewer than ``min_pages`` pages keep all lines; by default there are none such. The kept lines are joined by line feeds; all keep their order and repeats.

    Only hashes of lines are shuffled to be counted. The few lists of boilerplate are copied under salts, so the
    pages of one hot site meet them in many tasks.

    A null url, or one without a host, is the site ''. Null and empty pages have no lines. Repeated
    rows count as pages and are returned each; a null id stays null; ties can't arise; an empty table gives no rows. Further
    columns are ignored.
    """
    site = host_of(F.col("url")) if site is None else F.coalesce(site, F.lit(""))
    lines = html_lines(F.col("html")) if lines is None else lines
    named = pages.select(F.col(id_col).alias("page_id"), site.alias("site"), lines.alias("lines"))
    hashed = named.withColumn("hashes", F.transform("lines", lambda x: F.xxhash64(x)))
    marked = boilerplate(hashed.select("site", "hashes"), max_ratio, min_pages)
    salted = materialize(marked.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), "line-marks")
    spread = hashed.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int"))
    joined = spread.join(salted, ["site", "salt"], "left")
    pairs = F.arrays_zip(F.col("lines").alias("l"), F.col("hashes").alias("h"))
    kept = F.when(F.col("marks").isNull(), F.col("lines")).otherwise(F.transform(F.filter(pairs, lambda x: ~F.array_contains("marks", x["h"])), lambda x: x["l"]))
    out = joined.select("page_id", "site", F.size("lines").cast("long").alias("n_lines"), kept.alias("kept"))
    return out.select("page_id", "site", "n_lines", (F.col("n_lines") - F.size("kept")).alias("n_dropped"), F.array_join("kept", "\n").alias("text"))
