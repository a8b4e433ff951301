"""Documents as extracted page texts: reading lines, blocks with their place, pages without text.

The pages come as a table, from whatever extracts them: pages(document, page_no, text, layout), layout being the text as
it stands on the page, null where there is none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean

# Pages of a document, from which number of lines and share of one-word lines a text layer is broken,
# empty pages that a warning names, and where a block ends (a blank line, or the next clause or lettered item).
MOST_PAGES, MANY_LINES, BROKEN_SHARE, NAMED = 1000, 20, 0.65, 20
BLOCK_END = r"(?iU)\n\s*\n|\n(?=\s*(?:\d+(?:\.\d+)+\.|[а-я]\.)\s+)"


def page_text(text: Column, layout: Column) -> Column:
    """The text, or the layout (if it has any) where most of many lines hold one word only."""
    lines = F.filter(F.split(text, r"\R|[\x1C-\x1E]"), lambda x: clean(x) != "")
    single = F.size(F.filter(lines, lambda x: ~F.contains(clean(x), F.lit(" "))))
    broken = (F.size(lines) > MANY_LINES) & (single / F.size(lines) > BROKEN_SHARE) & (clean(layout) != "")
    return F.when(broken, layout).otherwise(F.coalesce(text, F.lit("")))


def page_errors(pages: DataFrame, most: int = MOST_PAGES) -> DataFrame:
    """document, n_pages of documents over the limit: they fail as a whole, nothing is cut."""
    return pages.groupBy("document").agg(F.count("*").alias("n_pages")).where(F.col("n_pages") > most)


def page_blocks(pages: DataFrame, most: int = MOST_PAGES) -> DataFrame:
    """document, page_no, block, locator, text: the blocks with a text of documents within the limit, blocks counted from 1 a page."""
    rows = pages.join(page_errors(pages, most), "document", "left_anti")
    rows = rows.select("document", "page_no", F.posexplode(F.split(page_text(F.col("text"), F.col("layout")), BLOCK_END)).alias("block", "raw"))
    rows = rows.withColumn("block", F.col("block") + 1).withColumn("text", clean("raw")).where("text <> ''")
    return rows.select("document", "page_no", "block", F.format_string("page %s, block %s", F.col("page_no").cast("string"), F.col("block").cast("string")).alias("locator"), "text")


def page_warnings(pages: DataFrame, most: int = MOST_PAGES) -> DataFrame:
    """document, n_empty, named: pages without text of documents within the limit, the first of them by number, … for more."""
    empty = pages.where(clean(page_text(F.col("text"), F.col("layout"))) == "").select("document", "page_no")
    rows = empty.join(page_errors(pages, most), "document", "left_anti")
    rows = rows.groupBy("document").agg(F.count("*").alias("n_empty"), F.sort_array(F.collect_list("page_no")).alias("at"))
    named = F.array_join(F.slice("at", 1, NAMED).cast("array<string>"), ", ")
    return rows.select("document", "n_empty", F.concat(named, F.when(F.col("n_empty") > NAMED, "…").otherwise("")).alias("named"))
