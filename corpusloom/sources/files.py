"""Markdown trees, repositories, page tables and the written index."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import reduce
from itertools import batched
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..settings import DIGEST_EXCLUDES, DOC_DIRS, README_NAMES, SKIP_DIRS, materialise
from .summaries import SUMMARY, read_summaries, summarise
from .versions import Entry, commit_version, fresh_folder, read_version

# --- fixed values: wording of a repository digest ----------------------------------------
DIGEST_TITLE = "# Repository Documentation\n\n**Source:** "
DIGEST_OVERVIEW = "## Overview\n\n"
DIGEST_STRUCTURE = "Repository Structure:\n```"
DIGEST_FILES = "## Documentation Files\n"
NO_VALUE = "__HIVE_DEFAULT_PARTITION__"  # folder of rows without a value
DIRECTORY_MARK, FILE_MARK = "📁 ", "📄 "
# -----------------------------------------------------------------------------------------
LISTED = 8192  # names a listing task hands over at once
READ_BYTES = 4 << 20  # texts a reading task hands over at once
TASK_FILES = 4096
LISTING_TASKS = 1024


def read_markdown_tree(spark: SparkSession, root: str, pattern: str = "*.md") -> DataFrame:
    """(url, title, text) of every markdown file below `root`; the title is the path relative to it.

    A folder of a mounted file system is listed and read by tasks, so the driver holds no names and its tasks are of
    `TASK_FILES` files; links to folders are not followed there. Any other root goes through Spark's reader, which
    holds the list of the files on the driver and leaves out names that begin with a dot or an underscore. Files are
    read as bytes: the text reader copies the whole Hadoop configuration for each file.
    """
    base = re.sub("^(file:)?/+", "/", root)
    if base.startswith("/") and os.path.isdir(base):
        base = os.path.normpath(base)
        path = F.col("path").cast("string")
        title = F.substring(path, len(base.rstrip("/")) + 2, 1 << 30)
        files = _listed(spark, base, pattern).mapInArrow(_read, "path BINARY, text BINARY")
        return files.select(F.concat(F.lit("file://"), path).alias("url"), title.alias("title"), F.col("text").cast("string").alias("text"))
    files = (
        spark.read.format("binaryFile").options(recursiveFileLookup=True, pathGlobFilter=pattern).load(root)
        .select(F.col("_metadata.file_path").alias("_path"), F.col("content").cast("string").alias("text"))
    )
    decoded = F.url_decode(F.regexp_replace("_path", r"\+", "%2B"))
    plain = F.regexp_replace(decoded, "^file:/+", "/")
    base = root.removeprefix("file://").rstrip("/")
    relative = F.substring_index(plain, base + "/", -1)
    skipped = F.arrays_overlap(F.split(relative, "/"), F.array(*map(F.lit, SKIP_DIRS)))
    url = F.when(plain.startswith("/"), F.concat(F.lit("file://"), plain)).otherwise(plain)
    return files.filter(~skipped).select(url.alias("url"), relative.alias("title"), "text")


def _listed(spark: SparkSession, base: str, pattern: str) -> DataFrame:
    """(path) of the files below the folder `base` whose names match, dealt to reading tasks.

    Tasks list one level of folders after the other; the lists lie in the shared folder, and only their sizes
    come to the driver.
    """
    wanted = f"(?s)^(?:{spark._jvm.org.apache.hadoop.fs.GlobPattern.compile(pattern).pattern()})\\z"
    named = F.substring_index(F.col("path").cast("string"), "/", -1).rlike(wanted)
    folders, n = spark.createDataFrame([(os.fsencode(base),)], "path BINARY"), 1
    levels = []
    while n:
        dealt = folders.repartition(min(n, LISTING_TASKS), "path")
        found = dealt.mapInArrow(_list, "path BINARY, is_folder BOOLEAN").filter(F.col("is_folder") | named)
        level = materialise(found, "listing")
        levels.append(level.filter("not is_folder").select("path"))
        folders = level.filter("is_folder").select("path")
        n = folders.count()
    files = reduce(DataFrame.unionByName, levels)
    n = files.count()
    tasks = max(spark.sparkContext.defaultParallelism, n // TASK_FILES)
    return files.repartition(max(1, min(n, tasks)), "path")


def _list(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, is_folder) of what lies in the folders (path)."""
    skipped = {name.encode() for name in SKIP_DIRS}

    def entries() -> Iterator[tuple[bytes, bool]]:
        for batch in batches:
            for folder in batch["path"]:
                with os.scandir(folder.as_py()) as inside:
                    for entry in inside:
                        is_folder = entry.is_dir(follow_symlinks=False)
                        if entry.name not in skipped and (is_folder or entry.is_file()):
                            yield entry.path, is_folder

    for some in batched(entries(), LISTED):
        paths, folders = zip(*some)
        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.binary()), pa.array(folders, pa.bool_())], ["path", "is_folder"])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, text) of the files (path), a few megabytes at a time."""

    def rows(paths: list[bytes], texts: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(paths, pa.binary()), pa.array(texts, pa.binary())], ["path", "text"])

    for batch in batches:
        paths, texts, size = [], [], 0
        for path in batch["path"].to_pylist():
            with open(path, "rb") as file:
                texts.append(file.read())
            paths.append(path)
            size += len(texts[-1])
            if size >= READ_BYTES:
                yield rows(paths, texts)
                paths, texts, size = [], [], 0
        yield rows(paths, texts)


def write_tree(files: DataFrame, root: str, *by: str) -> None:
    """`text` of each row as a file of its own, below the new folder `root` in folders of the columns `by`, as Spark names them.

    On a mounted file system tasks write the files themselves: Spark's writer would start processes to
    set the mode of each file, and move them one by one when the job ends. Elsewhere it writes them, and
    each task moves its own.
    """
    if not root.startswith(("/", "file:")):
        own = {"maxRecordsPerFile": 1, "mapreduce.fileoutputcommitter.algorithm.version": 2}
        return files.select(*by, "text").write.options(**own).partitionBy(*by).text(root)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(root)
        task, written, made = TaskContext.get().partitionId(), 0, set()
        for batch in batches:
            values = zip(*(batch[c].to_pylist() for c in by))
            for value, text in zip(values, batch["text"]):
                folder = "/".join([base, *(f"{c}={quote(v, safe='') if v else NO_VALUE}" for c, v in zip(by, value))])
                if folder not in made:
                    store.create_dir(folder)
                    made.add(folder)
                with store.open_output_stream(f"{folder}/part-{task:05d}-{written}.txt") as file:
                    file.write((text.as_py() or "").encode() + b"\n")
                written += 1
        yield pa.RecordBatch.from_pydict({"n": [written]})

    files.select(*(F.col(c).cast("string") for c in by), "text").mapInArrow(write, "n long").agg(F.sum("n")).collect()


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, url, html) of crawled pages."""
    return spark.read.parquet(path).select("page_id", "url", "html")


def _first_in(order: tuple[str, ...], value: Column) -> Column:
    """Position of `value` in `order`, NULL if it is not listed."""
    return F.nullif(F.array_position(F.array(*map(F.lit, order)), value), F.lit(0))


def select_repo_docs(files: DataFrame) -> DataFrame:
    """(repo, path, is_directory, content) -> docs (repo, url, title, path, is_readme, text).

    A repository contributes its README (first of the known names) and the .md files directly in
    the first documentation folder it has. Only paths are aggregated; the choice per repository is
    joined back, so the contents are never gathered.
    """
    plain = files.filter("not is_directory")
    dir_rank = _first_in(DOC_DIRS, F.substring_index("path", "/", 1))
    has_dir = F.when(F.col("path").contains("/") | F.col("is_directory"), dir_rank)
    choice = files.groupBy("repo").agg(
        F.min(F.when(~F.col("is_directory"), _first_in(README_NAMES, F.col("path")))).alias("_readme"),
        F.min(has_dir).alias("_dir"),
    )
    ranked = plain.withColumn("_r", _first_in(README_NAMES, F.col("path"))).withColumn(
        "_d", F.when(F.col("path").rlike(r"^[^/]+/[^/]+\.md\z"), dir_rank)
    )
    picked = ranked.filter("_r is not null or _d is not null").join(choice, "repo")
    readme = F.col("_r") == F.col("_readme")
    chosen = picked.filter(F.coalesce(readme, F.lit(False)) | F.coalesce(F.col("_d") == F.col("_dir"), F.lit(False)))
    # Hosted repositories are named by their second path part and link to the main branch.
    owner = F.regexp_extract("repo", r"github\.com/([^/]+)/([^/#?]+?)(?:/|\.git|\z)", 1)
    hosted = F.regexp_extract("repo", r"github\.com/([^/]+)/([^/#?]+?)(?:/|\.git|\z)", 2)
    last = F.regexp_extract("repo", r"([^/]+)/?\z", 1)
    name = F.coalesce(F.nullif(hosted, F.lit("")), F.nullif(last, F.lit("")), "repo")
    blob = F.concat(F.lit("https://github.com/"), owner, F.lit("/"), hosted, F.lit("/blob/main/"), "path")
    is_readme = F.coalesce(readme, F.lit(False))
    return chosen.select(
        "repo",
        F.when(is_readme, F.col("repo")).when(hosted != "", blob).otherwise(F.concat_ws("/", "repo", "path")).alias("url"),
        F.when(is_readme, F.concat(name, F.lit(" README")))
        .otherwise(F.concat(name, F.regexp_replace("path", "^.*/docs/", "/")))
        .alias("title"),
        "path",
        is_readme.alias("is_readme"),
        F.col("content").alias("text"),
    )


def repo_digest(files: DataFrame, excludes: tuple[str, ...] = DIGEST_EXCLUDES) -> DataFrame:
    """(repo, section, path, line): the digest of each repository as ordered lines.

    Sections: 1 title, 2 overview (README text), 3 structure, 4 documentation files, 5 interface
    note. Lines instead of one text per repository, so that a huge repository stays spread out;
    `write_digest` puts them into one text folder per repository.
    """
    repos = files.select("repo").distinct()
    docs = select_repo_docs(files)
    excluded = reduce(lambda a, b: a | b, [F.col("path").contains(p) for p in excludes])
    depth = F.length(F.regexp_replace("path", "[^/]", "")) * 2
    marker = F.when(F.col("is_directory"), DIRECTORY_MARK).otherwise(FILE_MARK)
    entry = F.concat(F.repeat(F.lit(" "), depth), marker, F.substring_index("path", "/", -1))

    def section(df: DataFrame, n: int, path: Column, line: Column) -> DataFrame:
        return df.select("repo", F.lit(n).alias("section"), path.alias("path"), line.alias("line"))

    none = F.lit("")
    readme, pages = docs.filter("is_readme"), docs.filter("not is_readme")
    page_path = F.col("path")
    parts = [
        section(repos, 1, none, F.concat(F.lit(DIGEST_TITLE), "repo", F.lit("\n"))),
        section(readme, 2, none, F.concat(F.lit(DIGEST_OVERVIEW), "text", F.lit("\n"))),
        section(repos, 3, none, F.lit(DIGEST_STRUCTURE)),
        section(files.filter(~excluded), 3, F.col("path"), entry),
        section(repos, 3, F.lit("\U0010ffff"), F.lit("```\n")),
        section(pages.select("repo").distinct(), 4, none, F.lit(DIGEST_FILES)),
        section(pages, 4, page_path, F.concat(F.lit("- "), page_path)),
    ]
    return reduce(DataFrame.unionByName, parts)


def write_digest(digest: DataFrame, path: str) -> None:
    """Digest lines as text, one folder per repository, in order within each file."""
    spread = digest.repartitionByRange("repo", "section", "path").sortWithinPartitions("repo", "section", "path")
    spread.select(F.url_encode("repo").alias("repo"), "line").write.mode("overwrite").partitionBy("repo").text(path)


# Tables without a source of their own: their key, and the table and column it points to.
OWNERS = {"embeddings": ("chunk_id", "chunks", "id"), "job_logs": ("job_id", "jobs", "id")}


def _with_source(name: str, tables: dict[str, DataFrame]) -> DataFrame:
    """The table with the source its rows belong to."""
    df = tables[name]
    if "source_id" in df.columns:
        return df
    if name == "sources":
        return df.withColumn("source_id", F.col("id"))
    key, parent, parent_key = OWNERS.get(name, (None, None, None))
    if parent not in tables:
        raise ValueError(f"{name} needs a source_id, or its {parent or 'parent'} table beside it")
    owners = tables[parent].select(F.col(parent_key).alias(key), "source_id")
    return df.join(owners, key, "left")


def write_index(tables: dict[str, DataFrame], path: str, sources: DataFrame | None = None) -> int:
    """Write index tables below `path` as one batch and return the new version.

    The batch replaces the rows of its sources in the tables it brings: of `sources` (source_id), or
    else of all sources that occur in its frames. A source of the batch without rows in a table
    loses its rows there; all rows of other sources stay, their embeddings and logs included, which get the
    source of their chunk or job. Every table goes to a folder of its own, partitioned by source; the
    version that names the folders comes last, so readers see the whole batch or nothing of it. Rows
    are clustered by source before the write to avoid many small files; AQE splits a large source.
    """
    spark = next(iter(tables.values())).sparkSession
    number, entries = read_version(spark, path)
    owned = {name: _with_source(name, tables) for name in tables}
    written = []
    for name, df in owned.items():
        folder = fresh_folder(name)
        df.hint("rebalance", "source_id").write.partitionBy("source_id").parquet(f"{path}/{folder}")
        stored = spark.read.schema(df.schema).parquet(f"{path}/{folder}")
        figures = fresh_folder("summary")
        summarise(name, stored).write.parquet(f"{path}/{figures}")
        written.append((name, folder, df.schema, figures))
    covers = fresh_folder("covers")
    if sources is None:
        noted = [spark.read.schema(SUMMARY).parquet(f"{path}/{figures}").select("source_id") for *_, figures in written]
        sources = reduce(DataFrame.unionByName, noted)
    sources.select(F.col("source_id").cast("string").alias("source_id")).distinct().write.parquet(f"{path}/{covers}")
    for name, folder, schema, figures in written:
        entries.append(Entry(name, folder, {"order": number + 1, "covers": covers, "schema": schema.jsonValue(), "summary": figures}))
    commit_version(spark, path, number + 1, entries)
    return number + 1


def _current(spark: SparkSession, path: str, batches: list[Entry]) -> DataFrame:
    """The rows of a table: of each batch those whose source no later batch has replaced."""
    parts, later = [], None
    for batch in sorted(batches, key=lambda e: -e.info["order"]):
        rows = spark.read.schema(T.StructType.fromJson(batch.info["schema"])).parquet(f"{path}/{batch.path}")
        parts.append(rows if later is None else rows.join(later, "source_id", "left_anti").select(*rows.columns))
        covered = spark.read.schema("source_id STRING").parquet(f"{path}/{batch.info['covers']}")
        later = covered if later is None else later.unionByName(covered)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def read_index(spark: SparkSession, path: str, *names: str, version: int | None = None) -> dict[str, DataFrame]:
    """Tables of the newest version of an index, or of an older one; they all belong to the same version."""
    _, entries = read_version(spark, path, version)
    found = {name: [e for e in entries if e.name == name] for name in names}
    if missing := [name for name, batches in found.items() if not batches]:
        raise ValueError(f"no table {', '.join(missing)} in {path}")
    return {name: _current(spark, path, batches) for name, batches in found.items()}


def index_summary(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """(table, source_id, n, tokens, chars, timed, duration, newest, name): figures of a stored index.

    They were noted by the imports, so neither chunks nor documents are read; see `summaries`.
    """
    _, entries = read_version(spark, path, version)
    return read_summaries(spark, path, {name: [e for e in entries if e.name == name] for name in {e.name for e in entries}})


def merge_index(spark: SparkSession, path: str) -> int:
    """One folder for each table in place of one for each batch; older versions stay readable."""
    number, entries = read_version(spark, path)
    names = sorted({e.name for e in entries})
    merged = []
    everything = fresh_folder("covers")
    for name, df in read_index(spark, path, *names).items():
        folder = fresh_folder(name)
        df.hint("rebalance", "source_id").write.partitionBy("source_id").parquet(f"{path}/{folder}")
        figures = fresh_folder("summary")
        summarise(name, spark.read.schema(df.schema).parquet(f"{path}/{folder}")).write.parquet(f"{path}/{figures}")
        merged.append(Entry(name, folder, {"order": number + 1, "covers": everything, "schema": df.schema.jsonValue(), "summary": figures}))
    spark.createDataFrame([], "source_id STRING").write.parquet(f"{path}/{everything}")  # nothing is older
    commit_version(spark, path, number + 1, merged)
    return number + 1
