"""Fixed values shared by the operators, and the session helpers.

Everything in the "fixed values" blocks has to stay exactly as it is for results
to agree with the indexing rules this package implements.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# --- fixed values: character classes -------------------------------------------------
# White space in the sense of the Unicode-aware \s used on web text.
WS = "\t\n\x0b\x0c\r \xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
WIDE_WS = "".join(c for c in WS if ord(c) > 127)
_WIDE = "\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
WS_RE = f"[\t-\r {_WIDE}]"
LINE_WS_RE = f"[\t\x0b-\r {_WIDE}]"
WORD_RE = f"[^\t-\r {_WIDE}]+"
DOT_RE = "[^\n\r\u2028\u2029]"  # one character of a line

# --- fixed values: line patterns -----------------------------------------------------
FENCE_LINE = f"^{LINE_WS_RE}*```[^\n]*"
HTML_TAG_LINE = f"^</?[a-zA-Z][A-Za-z0-9_-]*({WS_RE}+[^<>]*)?/?>\\z"
LINK_LIST_LINE = f"^{LINE_WS_RE}*(?:[-*+]|[0-9]+\\.){LINE_WS_RE}*\\[{DOT_RE}+?\\]\\({DOT_RE}+?\\){DOT_RE}*$"
NON_BLANK_LINE = f"^{LINE_WS_RE}*[^\t-\r {_WIDE}]"
HEADING_LINE = f"^(#{{1,6}}){LINE_WS_RE}+({DOT_RE}+)"
PAGINATION_LINE = f"(?i)^(Next|Previous|Prev){WS_RE}*[:|]{WS_RE}*\\[{DOT_RE}+?\\]\\({DOT_RE}+?\\){WS_RE}*\\z"
_MD_LINK = f"\\[{DOT_RE}+?\\]\\({DOT_RE}+?\\)"
BREADCRUMB_LINE = f"^{_MD_LINK}({WS_RE}*[›/»>]{WS_RE}*{_MD_LINK})+{WS_RE}*\\z"
DISALLOWED_EXTENSIONS = (
    r"(?i)\.(?:css|js|mjs|map|png|jpe?g|gif|svg|webp|ico|pdf|zip|gz|tgz|bz2|xz|7z|rar"
    r"|mp3|mp4|mov|avi|wmv|mkv|docx?|xlsx?|pptx?)\z"
)
SITEMAP_PATH = r"(?i)sitemap(?:[_-]index)?\.xml\z"
SITEMAP_PATHS = ("/sitemap.xml", "/sitemap_index.xml", "/sitemap-index.xml")

# --- fixed values: limits ------------------------------------------------------------
MIN_CHUNK_CHARS = 50
MAX_CHUNK_CHARS = 2000
LINK_LIST_RATIO = 0.7
RRF_K = 60
MMR_LAMBDA = 0.7
OVER_FETCH = 3
DEFAULT_LIMIT = 10
MAX_LIMIT = 50
MAX_DEPTH = 5
MAX_PAGES = 200
FAILURE_LIMIT = 10
FAILURE_BATCH = 3
EMBED_BATCH = 100
LOG_TAIL = 200
RECENT_JOBS = 50
AGENT_PREVIEW = 500
CARD_PREVIEW = 400
SKIP_DIRS = ("node_modules", ".git", "dist", "build", "__pycache__", ".next", ".cache")
README_NAMES = ("README.md", "readme.md", "README", "readme")
DOC_DIRS = ("docs", "doc", "documentation")
DIGEST_EXCLUDES = ("node_modules", "dist", "build", ".git", "test", "__pycache__")

# --- fixed values: the usual English stop words --------------------------------------
STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers "
    "herself it its itself they them their theirs themselves what which who whom this that these those am is are "
    "was were be been being have has had having do does did doing a an the and but if or because as until while "
    "of at by for with about against between into through during before after above below to from up down in out "
    "on off over under again further then once here there when where why how all any both each few more most "
    "other some such no nor not only own same so than too very s t can will just don should now"
).split()

# Rows per block of a running total (operators.running).
RUNNING_BLOCK = 65_536


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it in `spark.checkpoint.dir`.

    Only a session whose executors live in the driver's own process (`local[...]`) may go
    without the setting; it then uses a temporary folder of this machine. The session's
    configuration is never changed.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    context = spark.sparkContext
    if not (context.master == "local" or context.master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{tempfile.gettempdir()}/corpusloom-{context.applicationId}"


_SCRATCH: dict[str, list[str]] = {}


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder; `release_scratch` removes it."""
    path = f"{shared_dir(spark)}/corpusloom/{label}-{uuid.uuid4().hex}"
    _SCRATCH.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def remove_paths(spark: SparkSession, paths: list[str]) -> None:
    """Delete files or folders of any file system Spark reads; missing ones are passed over."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in paths:
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(conf).delete(place, True)


def release_scratch(spark: SparkSession) -> None:
    """Delete what this session wrote below the shared folder; frames that read it are of no use afterwards."""
    remove_paths(spark, _SCRATCH.pop(spark.sparkContext.applicationId, []))


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write `df` to the shared folder and read it back.

    Used where an expensive frame is read several times: it cuts the lineage, survives
    lost executors and keeps column pruning, which an RDD checkpoint would lose.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
