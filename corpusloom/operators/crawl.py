"""The link graph: links of a page, allowed links, robots rules, reach, budgets and failures."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.arrays import array_rows, struct_rows
from ..functions.html import canonical_href, hrefs
from ..functions.text import ws_trim
from ..functions.urls import normalize_url, resolve_url, url_host, url_origin, url_path
from ..settings import (
    DISALLOWED_EXTENSIONS,
    DOT_RE,
    FAILURE_BATCH,
    FAILURE_LIMIT,
    LINE_WS_RE,
    MAX_DEPTH,
    MAX_PAGES,
    SITEMAP_PATH,
    SITEMAP_PATHS,
    materialise,
    scratch_path,
)
from .running import numbered, running


def canonicalize(pages: DataFrame) -> DataFrame:
    """Add `page_url`, `canonical_url` (NULL if absent or equal) and `effective_url`."""
    here = pages.withColumn("page_url", normalize_url(F.col("url")))
    target = resolve_url(canonical_href(F.col("html")), F.col("page_url"))
    return here.withColumn("canonical_url", F.nullif(target, F.col("page_url"))).withColumn(
        "effective_url", F.coalesce("canonical_url", "page_url")
    )


def extract_links(pages: DataFrame) -> DataFrame:
    """(page_url, link): distinct absolute http(s) links per page.

    Repeats within a page are removed before the links are exploded; the final `distinct` merges
    pages that were stored under several spellings of one url.
    """
    here = pages.select(normalize_url(F.col("url")).alias("page_url"), hrefs(F.col("html")).alias("_hrefs"))
    usable = F.filter("_hrefs", lambda h: (h != "") & ~h.rlike(r"^(#|mailto:|tel:|javascript:)"))
    raw = array_rows(here, ["page_url"], F.array_distinct(usable), "_href")
    links = raw.select("page_url", resolve_url(F.col("_href"), F.col("page_url")).alias("link"))
    return links.filter(F.col("link").isNotNull()).distinct()


def filter_links(
    edges: DataFrame,
    same_origin_only: bool = True,
    allowed_hosts: tuple[str, ...] = (),
    allowed_prefixes: tuple[str, ...] = (),
    excluded_prefixes: tuple[str, ...] = (),
) -> DataFrame:
    """Links a crawl of `page_url` may follow."""
    path, host = url_path(F.col("link")), url_host(F.col("link"))

    def starts(prefixes: tuple[str, ...]) -> Column:
        test = F.lit(False)
        for prefix in prefixes:
            test = test | path.startswith(prefix)
        return test

    kept = edges.filter(~path.rlike(DISALLOWED_EXTENSIONS))
    if same_origin_only:
        same = url_origin(F.col("link")) == url_origin(F.col("page_url"))
        kept = kept.filter(same | host.isin(*allowed_hosts) if allowed_hosts else same)
    if allowed_hosts:
        kept = kept.filter(host.isin(*allowed_hosts))
    if allowed_prefixes:
        kept = kept.filter(starts(allowed_prefixes))
    if excluded_prefixes:
        kept = kept.filter(~starts(excluded_prefixes))
    return kept


def robots_rules(files: DataFrame, agent: str) -> DataFrame:
    """robots.txt files (origin, txt) -> (origin, kind, value); kind is allow, disallow, delay or sitemap.

    A file is cut at its user-agent lines within the row. The first group naming the agent counts;
    without one, all `*` groups do.
    """
    blank = LINE_WS_RE
    header = f"(?mid)^{blank}*user-agent:{blank}*(?=[^\\n{blank[1:]})"
    groups = F.transform(
        F.slice(F.split("txt", header), 2, 1_000_000_000),
        lambda g: F.struct(
            F.lower(ws_trim(F.regexp_extract(g, f"^({DOT_RE}*)", 1))).alias("agent"),
            F.regexp_replace(g, "^[^\n]*", "").alias("body"),
        ),
    )
    named = F.filter("_groups", lambda g: g["agent"] == agent.lower())
    anyone = F.filter("_groups", lambda g: g["agent"] == "*")
    chosen = F.when(F.size(named) > 0, F.slice(named, 1, 1)).otherwise(anyone)
    body = F.array_join(F.transform(chosen, lambda g: g["body"]), "\n")

    def values(name: str, source: Column, value: str = f"{DOT_RE}*") -> Column:
        found = F.regexp_extract_all(source, F.lit(f"(?mid)^{blank}*{name}:{blank}*({value}){blank}*$"), F.lit(1))
        return F.filter(F.transform(found, ws_trim), lambda v: v != "")

    def tagged(kind: str, items: Column) -> Column:
        return F.transform(items, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))

    delays = F.filter(values("crawl-delay", F.col("_body"), r"[0-9]+\.?[0-9]*"), lambda v: v.cast("double") > 0)
    delay = F.transform(F.slice(delays, 1, 1), lambda v: F.ceil(v.cast("double")).cast("string"))
    sitemaps = F.transform(values("sitemap", F.col("txt")), normalize_url)
    picked = files.withColumn("_groups", groups).withColumn("_body", body)
    rules = F.concat(
        tagged("allow", values("allow", F.col("_body"))),
        tagged("disallow", values("disallow", F.col("_body"))),
        tagged("delay", delay),
        tagged("sitemap", F.filter(sitemaps, lambda v: v.isNotNull())),
    )
    return struct_rows(picked, ["origin"], rules)


def robots_filter(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Add `allowed` to urls (…, url): the longest matching prefix decides, disallow wins ties.

    A path is cut to the lengths that rules of its origin have; the prefixes are then joined with the
    rules by value, so a url meets only rules that match it, however many its origin has.
    """
    kinds = rules.filter(F.col("kind").isin("allow", "disallow")).select("origin", F.col("value").alias("_prefix"), (F.col("kind") == "disallow").alias("_deny"))
    named = kinds.groupBy("origin", "_prefix").agg(F.max("_deny").alias("_deny"))
    lengths = named.groupBy("origin").agg(F.collect_set(F.length("_prefix")).alias("_lengths"))  # as many as the longest rule has characters
    located = urls.withColumn("origin", url_origin(F.col("url"))).withColumn("_path", url_path(F.col("url")))
    paths = located.select("origin", "_path").distinct().join(lengths, "origin")
    fitting = F.filter("_lengths", lambda n: n <= F.length("_path"))
    cut = array_rows(paths, ["origin", "_path"], fitting, "_n").withColumn("_prefix", F.expr("substring(_path, 1, _n)"))
    best = cut.join(named, ["origin", "_prefix"]).groupBy("origin", "_path").agg(F.max_by("_deny", "_n").alias("_deny"))
    judged = located.join(best, ["origin", "_path"], "left")
    return judged.withColumn("allowed", ~F.coalesce("_deny", F.lit(False))).drop("_path", "_deny", "origin")


def sitemap_locs(maps: DataFrame) -> DataFrame:
    """(sitemap_url, xml[, origin]) -> (sitemap_url, loc, nested[, origin]): distinct normalised <loc> values.

    Entries that are sitemaps themselves are flagged `nested`. With `origin`, the origin a crawl
    starts from, other entries have to lie there; without it they are all kept.
    """
    keys = ["sitemap_url", *[c for c in maps.columns if c == "origin"]]
    raw = F.regexp_extract_all("xml", F.lit(r"(?i)<loc>\s*([^<]+)\s*</loc>"), F.lit(1))
    locs = array_rows(maps, keys, F.array_distinct(F.transform(raw, ws_trim)), "_loc")
    urls = locs.select(*keys, resolve_url(F.col("_loc"), F.col("sitemap_url")).alias("loc")).filter("loc is not null")
    marked = urls.withColumn("nested", url_path(F.col("loc")).rlike(SITEMAP_PATH))
    if "origin" in keys:
        marked = marked.filter(F.col("nested") | (url_origin(F.col("loc")) == F.col("origin")))
    return marked.distinct()


def expand_sitemaps(maps: DataFrame, roots: DataFrame) -> DataFrame:
    """(origin, url): pages that the roots (origin, sitemap_url) and the sitemaps nested below them list.

    `origin` is where a crawl starts: nested sitemaps may lie elsewhere, pages may not. What lies below
    a root is walked once for all origins that name it, and a page meets the roots of its own origin only.
    Rounds go on until no further sitemap is found; each is written to the shared folder.
    """
    entries = materialise(sitemap_locs(maps.select("sitemap_url", "xml")), "sitemaps")
    named = materialise(roots.select("origin", F.col("sitemap_url").alias("root")).distinct(), "sitemaps")
    known = fresh = materialise(named.select("root", F.col("root").alias("sitemap_url")).distinct(), "sitemaps")
    nested = entries.filter("nested").select("sitemap_url", F.col("loc").alias("_next"))
    while not fresh.isEmpty():
        found = fresh.join(nested, "sitemap_url").select("root", F.col("_next").alias("sitemap_url")).distinct()
        fresh = materialise(found.join(known, ["root", "sitemap_url"], "left_anti"), "sitemaps")
        known = known.unionByName(fresh)
    pages = entries.filter(~F.col("nested")).select("sitemap_url", "loc", url_origin(F.col("loc")).alias("origin"))
    listed = pages.join(named, "origin").join(known, ["root", "sitemap_url"], "left_semi")
    return listed.select("origin", F.col("loc").alias("url")).distinct()


def crawl_seeds(starts: DataFrame, maps: DataFrame, rules: DataFrame) -> DataFrame:
    """(origin, url, depth): start urls (url) at depth 0 and what their sitemaps list at depth 1.

    Sitemaps are those named in the robots rules of the origin and the three usual addresses.
    """
    begun = starts.select(normalize_url(F.col("url")).alias("url")).distinct().withColumn("origin", url_origin(F.col("url")))
    guessed = begun.select("origin", F.explode(F.array(*[F.concat("origin", F.lit(p)) for p in SITEMAP_PATHS])).alias("sitemap_url"))
    named = rules.filter("kind = 'sitemap'").select("origin", normalize_url(F.col("value")).alias("sitemap_url"))
    roots = guessed.unionByName(named.join(begun.select("origin").distinct(), "origin", "left_semi"))
    listed = expand_sitemaps(maps, roots).withColumn("depth", F.lit(1))
    both = begun.select("origin", "url", F.lit(0).alias("depth")).unionByName(listed)
    return both.groupBy("origin", "url").agg(F.min("depth").alias("depth"))


def reachable(edges: DataFrame, seeds: DataFrame, max_depth: int | None = MAX_DEPTH) -> DataFrame:
    """(url, depth): every url reachable from the seeds (url[, depth]), at its smallest depth.

    Seeds without a depth are starts, at depth 0. Edges are stored once, bucketed by their source, so
    a level moves its frontier only; each level is written to the shared folder, so neither the plan
    nor a recovery grows with the depth.
    """
    spark = edges.sparkSession
    depth_of = F.col("depth").cast("int") if "depth" in seeds.columns else F.lit(0)
    begun = materialise(seeds.groupBy("url").agg(F.min(depth_of).alias("depth")), "reach")
    if max_depth is not None:
        begun = begun.filter(F.col("depth") <= max_depth)
    last = begun.agg(F.max("depth").alias("d")).first().d
    name = f"edges_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    stored = edges.select("src", "dst").filter("src <> dst").write.bucketBy(buckets, "src").option("path", scratch_path(spark, "edges"))
    stored.saveAsTable(name)
    links = spark.table(name)
    visited = frontier = materialise(begun.filter("depth = 0"), "reach")
    depth = 0
    try:
        while last is not None and (max_depth is None or depth < max_depth):
            depth += 1
            found = frontier.select(F.col("url").alias("src")).join(links, "src").select(F.col("dst").alias("url"))
            found = found.unionByName(begun.filter(F.col("depth") == depth).select("url")).distinct()
            frontier = materialise(found.join(visited, "url", "left_anti").withColumn("depth", F.lit(depth)), "reach")
            if frontier.isEmpty() and depth >= last:
                break
            visited = visited.unionByName(frontier)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    return visited


def crawl_plan(
    links: DataFrame,
    pages: DataFrame,
    seeds: DataFrame,
    rules: DataFrame | None = None,
    max_depth: int = MAX_DEPTH,
    max_pages: int = MAX_PAGES,
    max_chunks: int | None = None,
    max_bytes: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """The pages a crawl of each source visits, in the order of its queue, and why it stopped.

    links (src, dst, link_pos), pages (url, chunk_count, byte_count), seeds (source_id, url, depth,
    seq), rules as `robots_rules` gives them ->
    (source_id, url, depth, pos, chunk_count, byte_count), (source_id, stop_reason, visited, chunks, bytes).

    The queue is first in, first out: a level holds the seeds of its depth, by `seq`, then the links of
    the level before by the place of their page and their place on it; the first mention of a url counts.
    Robots rules are tested on what a level reaches, and budgets act inside the walk: pages beyond
    `max_pages` are not visited, and a page that reaches a chunk or byte cap is the last one. Links are
    followed only from pages that have chunks; a url without a page is a failed visit and takes its place
    in the budget. Places come from ranges of the order, so no source is ordered in one task. The links
    that a level follows are written before they are judged, or the tests of the rules would run on every
    stored link, and so is each level.
    """
    stored = materialise(links.select("src", "dst", "link_pos").filter("src <> dst"), "links")
    known = materialise(pages.groupBy("url").agg(F.max("chunk_count").alias("chunk_count"), F.max("byte_count").alias("byte_count")), "pages")
    begun = materialise(seeds.select("source_id", "url", F.col("depth").cast("int").alias("depth"), F.col("seq").cast("long").alias("seq")), "seeds")
    columns = ["source_id", "url", "depth", "pos", "chunk_count", "byte_count"]
    seen = frontier = None
    state = materialise(
        begun.select("source_id").distinct().select(
            "source_id", F.lit(None).cast("string").alias("stop_reason"), *(F.lit(0).cast("long").alias(c) for c in ("visited", "chunks", "bytes"))
        ),
        "crawls",
    )
    last = begun.agg(F.max("depth").alias("d")).first().d
    for depth in range(max_depth + 1):
        mentions = begun.filter(F.col("depth") == depth).select("source_id", "url", F.lit(-1).cast("long").alias("_page"), F.col("seq").alias("_link"))
        if frontier is not None:
            reached = frontier.join(stored, F.col("url") == F.col("src")).select(
                "source_id", F.col("dst").alias("url"), F.col("pos").alias("_page"), F.col("link_pos").cast("long").alias("_link")
            )
            if rules is not None:
                reached = robots_filter(materialise(reached, "reached"), rules).filter("allowed").drop("allowed")
            mentions = mentions.unionByName(reached)
        fresh = mentions.groupBy("source_id", "url").agg(F.min(F.struct("_page", "_link")).alias("_at"))
        if seen is not None:
            fresh = fresh.join(seen.select("source_id", "url"), ["source_id", "url"], "left_anti")
        fresh = fresh.join(state.filter("stop_reason IS NULL").select("source_id"), "source_id")
        placed = numbered(fresh.select("source_id", "url", "_at._page", "_at._link"), "source_id", ["_page", "_link", "url"], "_nth")
        before = state.select("source_id", *(F.col(c).alias(f"_{c}") for c in ("visited", "chunks", "bytes")))
        sizes = known.join(placed.select("url").distinct(), "url", "left_semi")
        level = placed.join(sizes, "url", "left").join(before, "source_id").select(
            "source_id", "url", F.lit(depth).alias("depth"), (F.col("_visited") + F.col("_nth")).alias("pos"),
            F.col("chunk_count").cast("long").alias("chunk_count"), F.col("byte_count").cast("long").alias("byte_count"), "_chunks", "_bytes",
        )
        sized = {
            f"_sum_{c}": ("sum", F.when(F.col("chunk_count") > 0, F.col(f"{c}_count")).otherwise(0)) for c in ("chunk", "byte")
        }
        totals = running(level, "source_id", "pos", sized)
        totals = materialise(
            totals.withColumn("_sum_chunk", F.col("_sum_chunk") + F.col("_chunks")).withColumn("_sum_byte", F.col("_sum_byte") + F.col("_bytes")), "level"
        )

        def crossing(total: str, cap: int | None) -> Column:
            if cap is None:
                return F.lit(None).cast("long")
            return F.min(F.when((F.col("chunk_count") > 0) & (F.col(total) >= cap), F.col("pos")))

        never = F.lit(2**62)
        cuts = totals.groupBy("source_id").agg(
            F.coalesce(crossing("_sum_chunk", max_chunks), never).alias("_c"), F.coalesce(crossing("_sum_byte", max_bytes), never).alias("_b"),
            F.when(F.max("pos") > max_pages, F.lit(max_pages)).otherwise(never).alias("_p"),
        )
        cut = F.least("_c", "_b", "_p")
        reason = F.when(F.col("_c") == cut, "maxChunks").when(F.col("_b") == cut, "maxBytes").otherwise("maxPages")
        cuts = materialise(cuts.select("source_id", cut.alias("_cut"), F.when(cut < never, reason).alias("_reason")), "cuts")
        visited = materialise(totals.join(cuts, "source_id").filter(F.col("pos") <= F.col("_cut")).drop("_cut"), "visited")
        told = visited.groupBy("source_id").agg(
            F.max("pos").alias("_pos"), F.max("_sum_chunk").alias("_chunk"), F.max("_sum_byte").alias("_byte")
        )
        state = state.join(told, "source_id", "left").join(cuts.select("source_id", "_reason"), "source_id", "left")
        state = materialise(
            state.select(
                "source_id", F.coalesce("stop_reason", "_reason").alias("stop_reason"), F.coalesce("_pos", "visited").alias("visited"),
                F.coalesce("_chunk", "chunks").alias("chunks"), F.coalesce("_byte", "bytes").alias("bytes"),
            ),
            "crawls",
        )
        found = visited.select(*columns)
        seen = found if seen is None else seen.unionByName(found)
        frontier = visited.filter("_reason IS NULL AND chunk_count > 0").select(*columns)
        if frontier.isEmpty() and (last is None or depth >= last):
            break
    return seen, state


def apply_budget(
    pages: DataFrame,
    max_pages: int = MAX_PAGES,
    max_chunks: int | None = None,
    max_bytes: int | None = None,
    source: str = "source_id",
) -> tuple[DataFrame, DataFrame]:
    """(kept pages, (source, stop_reason, kept, total)) for pages (source, seq, chunk_count, byte_count).

    The page that reaches a chunk or byte cap is still kept; empty pages never trigger one.
    """
    totals = running(
        pages,
        source,
        "seq",
        {
            "_pos": ("sum", F.lit(1).cast("long")),
            "_chunks": ("sum", F.col("chunk_count").cast("long")),
            "_bytes": ("sum", F.col("byte_count").cast("long")),
        },
    )

    def first_crossing(total: str, cap: int | None) -> Column:
        if cap is None:
            return F.lit(None).cast("long")
        return F.min(F.when((F.col("chunk_count") > 0) & (F.col(total) >= cap), F.col("_pos")))

    stops = totals.groupBy(source).agg(
        F.count(F.lit(1)).alias("total"),
        first_crossing("_chunks", max_chunks).alias("_c"),
        first_crossing("_bytes", max_bytes).alias("_b"),
    )
    never = F.lit(2**62)
    chunk_at, byte_at = F.coalesce("_c", never), F.coalesce("_b", never)
    page_at = F.when(F.col("total") > max_pages, F.lit(max_pages)).otherwise(never)
    cut = F.least(chunk_at, byte_at, page_at)
    reason = (
        F.when(cut == never, F.lit(None).cast("string"))
        .when(chunk_at == cut, "maxChunks")
        .when(byte_at == cut, "maxBytes")
        .otherwise("maxPages")
    )
    stops = stops.select(
        source, reason.alias("stop_reason"), F.least(cut, F.col("total")).alias("kept"), "total"
    )
    kept = totals.join(stops.select(source, F.col("kept").alias("_cut")), source).filter("_pos <= _cut")
    return kept.drop("_pos", "_chunks", "_bytes", "_cut"), stops


def cut_on_failures(
    results: DataFrame, limit: int = FAILURE_LIMIT, batch: int = FAILURE_BATCH, source: str = "source_id"
) -> DataFrame:
    """Add `pos` and `kept` to page results (source, seq, ok).

    The streak of failures is looked at before each batch; once it has reached `limit`, that batch
    and everything after it is dropped.
    """
    placed = running(results, source, "seq", {"pos": ("sum", F.lit(1).cast("long"))})
    last = running(placed, source, "seq", {"_ok": ("max", F.when(F.col("ok"), F.col("pos")))})
    streak = F.col("pos") - F.coalesce("_ok", F.lit(0))
    stops = last.groupBy(source).agg(
        F.min(F.when((streak >= limit) & (F.col("pos") % batch == 0), F.col("pos"))).alias("_stop")
    )
    return (
        last.join(stops, source)
        .withColumn("kept", F.col("_stop").isNull() | (F.col("pos") <= F.col("_stop")))
        .drop("_ok", "_stop")
    )


def failure_drops(cut: DataFrame, batch: int = FAILURE_BATCH, source: str = "source_id") -> DataFrame:
    """(source, reason, count): wholly failed batches and what the failure limit cut off."""
    batches = cut.groupBy(source, F.floor((F.col("pos") - 1) / batch).alias("_batch")).agg(
        F.count(F.lit(1)).alias("_n"), F.bool_or("ok").alias("_any"), F.bool_and("kept").alias("_kept")
    )
    reason = F.when(~F.col("_kept"), "too_many_consecutive_failures").when(~F.col("_any"), "crawl_error")
    tagged = batches.withColumn("reason", reason).filter("reason IS NOT NULL")
    return tagged.groupBy(source, "reason").agg(F.sum("_n").alias("count"))
