"""Source kinds: how the raw rows of a kind become documents.

A kind is a function DataFrame -> docs DataFrame (source_id, url, title, text); users add their own. A kind
whose rows name further sources (an index of sources) also has a function that finds them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from ..functions.html import html_to_markdown, page_title
from ..functions.text import strip_crawler_noise
from ..functions.urls import normalize_url
from .files import select_repo_docs
from .openapi import openapi_chunks
from .listings import discover_sources, llms_full_to_docs, packages_to_docs

SourceKind = Callable[[DataFrame], DataFrame]
SourceFinder = Callable[[DataFrame, DataFrame], DataFrame]
_KINDS: dict[str, SourceKind] = {}
_FINDERS: dict[str, SourceFinder] = {}


def register_source_kind(name: str, to_docs: SourceKind, find_sources: SourceFinder | None = None) -> None:
    _KINDS[name] = to_docs
    _FINDERS.pop(name, None)
    if find_sources is not None:
        _FINDERS[name] = find_sources


def source_kinds() -> list[str]:
    return sorted(_KINDS)


def docs_of_kind(name: str, raw: DataFrame) -> DataFrame:
    """Documents of a kind's raw rows; an unknown kind is an error."""
    if name not in _KINDS:
        raise ValueError(f"unknown source kind: {name}")
    return raw.transform(_KINDS[name])


def sources_of_kind(name: str, raw: DataFrame, sources: DataFrame) -> DataFrame:
    """New sources (name, url, importer_type) that a kind's raw rows name and `sources` (url, …) lacks."""
    if name not in _KINDS:
        raise ValueError(f"unknown source kind: {name}")
    if name not in _FINDERS:
        return raw.sparkSession.createDataFrame([], "name STRING, url STRING, importer_type STRING")
    return _FINDERS[name](raw, sources)


def _with_source(df: DataFrame, raw: DataFrame) -> DataFrame:
    return df if "source_id" in df.columns else df.join(raw.select("url", "source_id").distinct(), "url")


def pages_to_docs(pages: DataFrame) -> DataFrame:
    """Crawled pages (source_id, url, html) as markdown documents."""
    return pages.select(
        "source_id",
        normalize_url(F.col("url")).alias("url"),
        page_title(F.col("html")).alias("title"),
        strip_crawler_noise(html_to_markdown(F.col("html"))).alias("text"),
    )


def _plain_docs(files: DataFrame) -> DataFrame:
    return files.select("source_id", "url", "title", "text")


def _spec_docs(specs: DataFrame) -> DataFrame:
    """Interface descriptions (source_id, url, name, json): one document per chunk, already cut, each with a url of its own."""
    own = F.concat("doc_url", F.lit("#"), F.col("chunk_index").cast("string"))
    return openapi_chunks(specs).select("source_id", own.alias("url"), F.col("doc_title").alias("title"), F.col("content").alias("text"))


def _no_docs(files: DataFrame) -> DataFrame:
    """An index of sources has no documents; its links become sources, whose own imports bring theirs."""
    return files.sparkSession.createDataFrame([], "source_id STRING, url STRING, title STRING, text STRING")


def _url_list_docs(fetched: DataFrame) -> DataFrame:
    return fetched.select("source_id", "url", F.col("url").alias("title"), "text")


def _repo_docs(files: DataFrame) -> DataFrame:
    return select_repo_docs(files).select(F.col("repo").alias("source_id"), "url", "title", "text")


register_source_kind("llmstxt", llms_full_to_docs)
register_source_kind("local", _plain_docs)
register_source_kind("url-list", _url_list_docs)
register_source_kind("npm-readme", lambda raw: _with_source(packages_to_docs(raw), raw))
register_source_kind("github", _repo_docs)
register_source_kind("azuredevops", _repo_docs)
register_source_kind("crawler", pages_to_docs)
register_source_kind("llmstxt-crawl", pages_to_docs)
register_source_kind("llmstxt-meta", _no_docs, discover_sources)
register_source_kind("openapi", _spec_docs)
