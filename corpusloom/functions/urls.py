"""URL column functions: resolution against a base and normalisation."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .arrays import let

# Characters that a URL path or query must carry percent-encoded (besides non-ASCII ones).
_ENCODE = r"\x00-\x20\"<>^`{}\x7f-\x{10ffff}"


def percent_encode(c: Column) -> Column:
    """Encode what must not appear raw in a path; leave everything else untouched."""
    runs = F.regexp_extract_all(c, F.lit(f"([^{_ENCODE}]+|[{_ENCODE}]+)"), F.lit(1))
    raw = f"^[{_ENCODE}]"
    coded = F.transform(
        runs, lambda r: F.when(r.rlike(raw), F.regexp_replace(F.url_encode(r), r"\+", "%20")).otherwise(r)
    )
    return F.when(c.rlike(f"[{_ENCODE}]"), F.array_join(coded, "")).otherwise(c)


def _remove_dots(path: Column) -> Column:
    """Resolve `.` and `..` segments of an absolute path."""

    def step(done: Column, part: Column) -> Column:
        up = F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))
        return F.when(part == "..", up).when(part == ".", done).otherwise(F.concat(done, F.array(part)))

    parts = F.filter(F.split(path, "/"), lambda _, i: i > 0)
    walked = F.concat(F.lit("/"), F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/"))
    closing = F.when(path.rlike(r"/\.\.?\z"), F.lit("/")).otherwise(F.lit(""))
    tidy = F.regexp_replace(F.concat(walked, closing), r"//\z", "/")
    return F.when(path.rlike(r"/\.\.?(/|\z)"), tidy).otherwise(path)


def url_origin(c: Column) -> Column:
    """scheme://host[:port] in lower case without the scheme's default port; NULL if not http(s)."""
    raw = F.lower(F.regexp_extract(c, r"(?i)^(https?://[^/?#]+)", 1))
    no_user = F.regexp_replace(raw, "//[^/]*@", "//")
    bare = F.regexp_replace(F.regexp_replace(no_user, r"^(http://[^/]*):80\z", "$1"), r"^(https://[^/]*):443\z", "$1")
    return F.nullif(bare, F.lit(""))


def url_host(c: Column) -> Column:
    return F.regexp_replace(url_origin(c), "^https?://", "")


def url_path(c: Column) -> Column:
    """Path of an absolute URL; `/` when it is empty."""
    return F.regexp_replace(F.regexp_extract(c, r"(?i)^https?://[^/?#]+([^?#]*)", 1), r"^\z", "/")


def url_query(c: Column) -> Column:
    """`?query` of a URL, or an empty string."""
    return F.regexp_extract(c, r"^[^?#]*(\?[^#]+)", 1)


def normalize_url(c: Column) -> Column:
    """Canonical spelling: no fragment, no /index.htm(l), no trailing slash; NULL if not http(s)."""

    def tidy(path: Column) -> Column:
        no_index = F.regexp_replace(percent_encode(path), r"/index\.html?\z", "")
        return F.regexp_replace(F.regexp_replace(no_index, r"(.)/\z", "$1"), r"^\z", "/")

    path = let(let(url_path(c), _remove_dots), tidy)
    return F.concat(url_origin(c), path, let(url_query(c), percent_encode))


def resolve_url(href: Column, base: Column) -> Column:
    """Absolute http(s) URL of `href` found on the page `base`, normalised; NULL for other schemes."""
    return let(F.translate(href, "\\\t\n\r", "/"), lambda ref: let(_absolute(ref, base), normalize_url))


def _absolute(ref: Column, base: Column) -> Column:
    scheme = F.regexp_extract(base, r"(?i)^(https?:)", 1)
    folder = F.regexp_replace(url_path(base), r"[^/]*\z", "")
    return (
        F.when(ref.rlike(r"(?i)^https?://"), ref)
        .when(ref.rlike(r"(?i)^[a-z][a-z0-9+.-]*:"), F.lit(None).cast("string"))
        .when(ref.startswith("//"), F.concat(scheme, ref))
        .when(ref.startswith("/"), F.concat(url_origin(base), ref))
        .when(ref.startswith("?"), F.concat(url_origin(base), url_path(base), ref))
        .when((ref == "") | ref.startswith("#"), F.regexp_replace(base, "#.*", ""))
        .otherwise(F.concat(url_origin(base), folder, ref))
    )
