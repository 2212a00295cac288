"""Sources that arrive as text listings: url lists, package metadata, link indexes, one-file manuals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.arrays import array_rows
from ..functions.text import ws_trim
from ..settings import DOT_RE, LINE_WS_RE


def _lines(df: DataFrame, text: str, *keep: str) -> DataFrame:
    return array_rows(df, list(keep), F.split(text, "\n"), "line", "pos")


def parse_url_list(lists: DataFrame) -> DataFrame:
    """(source_id, text) -> (source_id, pos, url): one trimmed url per line, `#` lines are comments."""
    rows = _lines(lists, "text", "source_id").withColumn("url", ws_trim(F.col("line")))
    return rows.filter((F.col("url") != "") & ~F.col("url").startswith("#")).select("source_id", "pos", "url")


def packages_to_docs(packages: DataFrame) -> DataFrame:
    """(url, json) -> (url, title, text): the readme of a package; rows without one are left out."""
    info = packages.select("url", F.from_json("json", "name STRING, description STRING, readme STRING").alias("p"))
    described = F.coalesce(F.col("p.description"), F.lit("")) != ""
    title = F.when(described, F.concat_ws(": ", "p.name", "p.description")).otherwise(F.col("p.name"))
    return info.filter(F.coalesce(F.col("p.readme"), F.lit("")) != "").select(
        "url", title.alias("title"), F.col("p.readme").alias("text")
    )


def llms_full_to_docs(files: DataFrame) -> DataFrame:
    """(source_id, name, url, text) -> docs titled by the first `# ` line, else by the source name."""
    heading = ws_trim(F.regexp_extract("text", f"(?md)^#[{LINE_WS_RE[1:-1]}\n]+({DOT_RE}+)", 1))
    title = F.when(F.col("text").rlike(f"(?md)^#[{LINE_WS_RE[1:-1]}\n]+{DOT_RE}"), heading).otherwise(F.col("name"))
    return files.select("source_id", "url", title.alias("title"), "text")


def _by_line_start(start: str, line: Column) -> Column:
    return F.when(line.startswith(start), ws_trim(F.substring(line, len(start) + 1, 2**31 - 1)))


def llms_meta(files: DataFrame) -> DataFrame:
    """(source_id, text) -> (source_id, title, description) of link indexes; row by row.

    The last `# ` line is the title, `> ` lines are joined by a blank.
    """
    lines = F.transform(F.split("text", "\n"), lambda ln: F.regexp_replace(ln, f"{LINE_WS_RE}+\\z", ""))

    def starting(start: str) -> Column:
        return F.transform(F.filter(lines, lambda ln: ln.startswith(start)), lambda ln: _by_line_start(start, ln))

    titles, notes = starting("# "), F.filter(starting("> "), lambda s: s != "")
    return files.select(
        "source_id",
        F.coalesce(F.try_element_at(titles, F.lit(-1)), F.lit("")).alias("title"),
        F.array_join(notes, " ").alias("description"),
    )


def llms_links(files: DataFrame, include_optional: bool = True) -> DataFrame:
    """(source_id, text) -> (source_id, pos, label, url, description, optional).

    A link is optional while the last heading line before it is `## Optional`. One window group
    holds the heading and link lines of one file.
    """
    trimmed = _lines(files, "text", "source_id").withColumn("line", F.regexp_replace("line", f"{LINE_WS_RE}+\\z", ""))
    line = F.col("line")
    section = F.when(line.startswith("# "), F.lit("")).when(
        line.startswith("## "), F.lower(_by_line_start("## ", line))
    )
    useful = trimmed.filter(line.startswith("- ") | line.startswith("# ") | line.startswith("## "))
    before = W.partitionBy("source_id").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    placed = useful.withColumn("_section", F.last(section, ignorenulls=True).over(before))
    # label, url, and what follows a colon
    link = f"^- \\[([^\\]]+)\\]\\(([^)]+)\\)(?::{LINE_WS_RE}*({DOT_RE}*))?\\z"
    links = placed.filter(line.rlike(link)).select(
        "source_id",
        "pos",
        F.regexp_extract("line", link, 1).alias("label"),
        F.regexp_extract("line", link, 2).alias("url"),
        ws_trim(F.regexp_extract("line", link, 3)).alias("description"),
        (F.coalesce("_section", F.lit("")) == "optional").alias("optional"),
    )
    return links if include_optional else links.filter("not optional")


def index_links(files: DataFrame) -> DataFrame:
    """(source_id, text) -> (source_id, pos, title, url): links of an index of sources.

    Links count from the first `- ` line on, wherever they stand in a line.
    """
    bullets = F.transform(F.split("text", "\n"), lambda ln: ws_trim(ln).startswith("- "))
    start = F.array_position(bullets, True) - 1
    rows = _lines(files.withColumn("_from", start), "text", "source_id", "_from")
    link = r"-\s*(?:\[optional\]\s*)?\[([^\]]+)\]\s*\(([^)]+)\)"
    found = rows.filter((F.col("_from") >= 0) & (F.col("pos") >= F.col("_from")) & F.col("line").rlike(link))
    return found.select(
        "source_id",
        "pos",
        F.regexp_extract("line", link, 1).alias("title"),
        F.regexp_extract("line", link, 2).alias("url"),
    )


def discover_sources(files: DataFrame, sources: DataFrame) -> DataFrame:
    """New sources (name, url, importer_type) named by source indexes and not registered yet.

    A link is known if its url, or its url with `/llms.txt`, is registered before it; of repeated
    links the first counts.
    """
    first = W.partitionBy("url").orderBy("source_id", "pos")
    fresh = index_links(files).withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")
    fresh = fresh.withColumn("_file", F.concat(F.regexp_replace("url", r"/\z", ""), F.lit("/llms.txt")))
    known = sources.select("url").distinct()
    new = fresh.join(known, "url", "left_anti").join(known.withColumnRenamed("url", "_file"), "_file", "left_anti")
    earlier = new.select(F.col("url").alias("_file"), F.struct("source_id", "pos").alias("_before"))
    by_file = new.join(earlier, "_file").filter(F.col("_before") < F.struct("source_id", "pos")).select("url")
    new = new.join(by_file, "url", "left_anti")
    kind = F.when(F.col("url").rlike(r"\.(json|yaml|yml)\z"), "openapi").otherwise("llmstxt-crawl")
    return new.select(F.col("title").alias("name"), "url", kind.alias("importer_type"))
