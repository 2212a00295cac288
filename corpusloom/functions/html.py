"""HTML column functions. The regular cases stay in the JVM; the DOM walk runs on Arrow batches."""

from __future__ import annotations

import re
from html.entities import name2codepoint
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, functions as F, types as T

from .text import ws_trim

# --- fixed values: what counts as boilerplate and as the main part of a page ----------
REMOVED_TAGS = ("nav", "footer", "script", "style", "noscript", "aside")
MAIN_TAGS = ("main", "article")
MAIN_CLASSES = {"content", "docs-content", "documentation", "docs"}
# --------------------------------------------------------------------------------------
_VOID = set("area base br col embed hr img input link meta source track wbr".split())
_BLOCK = set(
    "address article blockquote body center dd div dl dt fieldset figcaption figure form header hr html li main ol p "
    "pre section table tbody td tfoot th thead tr ul h1 h2 h3 h4 h5 h6".split()
)
# Elements whose end tag may be left out, and the start tags that end them.
_ENDED_BY = {
    "p": _BLOCK, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"},
    "td": {"td", "th", "tr", "tbody", "tfoot"}, "th": {"td", "th", "tr", "tbody", "tfoot"}, "option": {"option"},
}
_MARKS = re.compile(r"([\\*_`\[\]])")
_LINE_START = re.compile(r"^(\s*)(#{1,6}(?=\s)|[-+](?=\s)|>|~~~|=+)")
_NUMBERED = re.compile(r"^(\s*\d+)\.(?=\s)")


def _named_entities() -> Column:
    pairs = [(F.lit(name), F.lit(chr(code))) for name, code in {**name2codepoint, "apos": 39}.items()]
    return F.create_map(*[part for pair in pairs for part in pair])


def _entity(name: Column) -> Column:
    """The character of `amp`, `#8217` or `#x2019`; NULL if there is none."""
    numeric = F.when(name.rlike("^#[0-9]"), F.substring(name, 2, 9).try_cast("bigint")).when(
        name.rlike("^#[xX]"), F.conv(F.substring(name, 3, 8), 16, 10).try_cast("bigint")
    )
    valid = ((numeric > 0) & (numeric < 0xD800)) | ((numeric > 0xDFFF) & (numeric <= 0x10FFFF))
    char = F.decode(F.unhex(F.lpad(F.hex(F.when(valid, numeric)), 8, "0")), "UTF-32")
    return F.when(name.startswith("#"), char).otherwise(F.try_element_at(_named_entities(), name))


def decode_entities(c: Column) -> Column:
    """Character references, each decoded once; what is none stays as it is."""

    def decoded(piece: Column) -> Column:
        name = F.regexp_extract(piece, "^(#[0-9]{1,8}|#[xX][0-9a-fA-F]{1,7}|[A-Za-z][A-Za-z0-9]*);", 1)
        char = F.when(name != "", _entity(name))
        rest = F.concat(char, F.substr(piece, F.length(name) + 2))
        return F.coalesce(rest, F.concat(F.lit("&"), piece))

    parts = F.split(c, "&")
    whole = F.concat(F.get(parts, F.lit(0)), F.array_join(F.transform(F.slice(parts, 2, 1 << 30), decoded), ""))
    return F.when(F.contains(c, F.lit("&")), whole).otherwise(c)


def strip_tags(c: Column) -> Column:
    return F.regexp_replace(c, "<[^>]*>", "")


def _element_text(html: Column, tag: str) -> Column:
    inner = F.regexp_extract(html, rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}\s*>", 1)
    return F.nullif(ws_trim(decode_entities(strip_tags(inner))), F.lit(""))


def page_title(html: Column) -> Column:
    """Text of <title>, else of the first <h1>."""
    return F.coalesce(_element_text(html, "title"), _element_text(html, "h1"), F.lit(""))


def canonical_href(html: Column) -> Column:
    """href of the first <link rel="canonical">, NULL if there is none."""
    link = F.regexp_extract(html, r"(?is)(<link\b[^>]*?[\s\"'/]rel\s*=\s*[\"']?canonical\b[^>]*>)", 1)
    return F.nullif(decode_entities(_attribute(link, "href")), F.lit(""))


def _attribute(tag: Column, name: str) -> Column:
    value = F.regexp_extract(tag, rf"(?is)[\s\"'/]{name}\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", 1)
    return F.regexp_replace(value, r"^[\"']|[\"']\z", "")


def hrefs(html: Column) -> Column:
    """href values of all <a> elements, in order."""
    tags = F.regexp_extract_all(html, F.lit(r"(?is)(<a(?=\s)[^>]*?[\s\"'/]href\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>]+))"), F.lit(1))
    return F.transform(tags, lambda t: ws_trim(decode_entities(_attribute(t, "href"))))


def _needs_dom(html: Column) -> Column:
    """Pages whose boilerplate is marked by attributes or nested, which no pattern can cut out."""
    by_attribute = html.rlike(
        r"(?is)<[a-z][^>]*\b(?:role\s*=\s*[\"']?(?:navigation|main)|aria-hidden\s*=\s*[\"']?true"
        r"|(?:class|id)\s*=\s*[\"']?[^\"'>]*(?:toc|sidebar|cookie|content|docs|documentation))"
    )
    names = "|".join((*REMOVED_TAGS, *MAIN_TAGS))
    tags = F.array_join(F.regexp_extract_all(F.lower(html), F.lit(rf"(</?(?:{names})\b)"), F.lit(1)), "")
    nested = F.regexp_replace(tags, r"<([a-z]+)</\1(?=<|\z)", "") != ""
    return by_attribute | nested


def main_html_simple(html: Column) -> Column:
    """Pattern form of the main-content rule for pages without attribute-marked boilerplate."""
    out = html
    for tag in REMOVED_TAGS:
        out = F.regexp_replace(out, rf"(?is)<{tag}\b.*?</{tag}\s*>", "")
    main = F.regexp_extract(out, r"(?is)<(?:main|article)\b[^>]*>(.*?)</(?:main|article)\s*>", 1)
    body = F.regexp_extract(out, r"(?is)<body\b[^>]*>(.*?)(?:</body\s*>|\z)", 1)
    has_main = out.rlike(r"(?is)<(?:main|article)\b[^>]*>.*?</(?:main|article)\s*>")
    return F.when(has_main, main).otherwise(F.coalesce(F.nullif(body, F.lit("")), out))


def main_html(html: Column) -> Column:
    """Main content of a page. Only pages that need a DOM walk cross to Python; the rest send NULL."""
    complex_page = F.when(_needs_dom(html), html)
    return F.when(complex_page.isNull(), main_html_simple(html)).otherwise(_main_html_dom(complex_page))


def _boilerplate(tag: str, attrs: dict[str, str]) -> bool:
    css = attrs.get("class", "")
    return (
        tag in REMOVED_TAGS
        or attrs.get("role") == "navigation"
        or attrs.get("aria-hidden") == "true"
        or any(word in css for word in ("sidebar", "toc", "cookie"))
        or "toc" in attrs.get("id", "")
    )


def _main_part(tag: str, attrs: dict[str, str]) -> bool:
    return (
        tag in MAIN_TAGS
        or attrs.get("role") == "main"
        or attrs.get("id") == "content"
        or not MAIN_CLASSES.isdisjoint(attrs.get("class", "").split())
    )


class _MainWalk(HTMLParser):
    """Follows a page tag by tag, skips boilerplate and reports what lies in its main part.

    `whole` collects the body, `main` the first main container; `result` picks one of them.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.skip: list[str] = []
        self.depth = 0
        self.main_tag = ""
        self.span: list[int] = []
        self.out: list[str] = []

    def handle_starttag(self, tag, attrs):
        values = {k: v or "" for k, v in attrs}
        while self.skip and tag in _ENDED_BY.get(self.skip[-1], ()):
            self.skip.pop()
        if self.skip:
            if tag not in _VOID:
                self.skip.append(tag)
        elif _boilerplate(tag, values):
            if tag not in _VOID:
                self.skip.append(tag)
        else:
            if not self.span and _main_part(tag, values):
                self.flush()
                self.main_tag, self.depth, self.span = tag, 1, [len(self.out)]
                return
            if len(self.span) == 1 and tag == self.main_tag:
                self.depth += 1
            self.open(tag, values)

    def handle_endtag(self, tag):
        if self.skip and tag not in self.skip and self.skip[0] in _ENDED_BY and tag in _BLOCK:
            self.skip.clear()  # the end of an element around the skipped one
        if self.skip:
            while tag in self.skip:
                if self.skip.pop() == tag:
                    break
            return
        if len(self.span) == 1 and tag == self.main_tag:
            self.depth -= 1
            if self.depth == 0:
                self.flush()
                self.span.append(len(self.out))
        self.shut(tag)

    def handle_data(self, data):
        if not self.skip:
            self.text(data)

    def parse(self, page: str) -> list[str]:
        body = re.search(r"(?is)<body\b[^>]*>", page)
        self.feed(page[body.end() :] if body else page)
        self.close()
        self.flush()
        lo, hi = (*self.span, len(self.out))[:2] if self.span else (0, len(self.out))
        return self.out[lo:hi]

    def flush(self):
        pass


class _HtmlOut(_MainWalk):
    """Re-emits the main part as HTML."""

    def open(self, tag, attrs):
        self.out.append(self.get_starttag_text() or "")

    def shut(self, tag):
        self.out.append(f"</{tag}>")

    def text(self, data):
        self.out.append(data.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;"))


class _MarkdownOut(_MainWalk):
    """Writes the main part as markdown: # headings, fenced code, list items and links."""

    _INLINE = {"b": "**", "strong": "**", "em": "_", "i": "_", "code": "`"}

    def __init__(self) -> None:
        super().__init__()
        self.line: list[str] = []
        self.lists: list[int | None] = []
        self.links: list[str] = []
        self.prefix = ""
        self.quotes = self.code = 0
        self.fenced = False
        self.language = ""

    def open(self, tag, attrs):
        if self.fenced:
            found = re.search(r"lang(?:uage)?-([\w+#-]+)", attrs.get("class", "")) if tag == "code" else None
            self.language = found[1] if found else self.language
            if tag == "br" or (tag in _BLOCK and self.line and not self.line[-1].endswith("\n")):
                self.line.append("\n")
            return
        if tag in _BLOCK:
            self.flush()
        if tag in ("ul", "ol"):
            self.lists.append(0 if tag == "ol" else None)
        elif tag == "li":
            self.prefix = self._bullet()
        elif tag == "pre":
            self.fenced, self.language = True, ""
        elif tag == "br":
            self.line.append("  \n")
        elif tag == "hr":
            self.out.append("* * *")
        elif tag == "img" and attrs.get("src"):
            self.line.append(f"![{attrs.get('alt', '')}]({attrs['src']}{self._title(attrs)})")
        elif tag == "a":
            self.links.append(attrs.get("href", "") and attrs["href"] + self._title(attrs))
            self.line.append("[" if self.links[-1] else "")
        elif re.fullmatch("h[1-6]", tag):
            self.prefix = "#" * int(tag[1]) + " "
        elif tag == "blockquote":
            self.quotes += 1
        elif tag in self._INLINE:
            self.code += tag == "code"
            self.line.append(self._INLINE[tag])

    def shut(self, tag):
        if self.fenced:
            if tag == "pre":
                self.flush()
            elif tag in _BLOCK and self.line and not self.line[-1].endswith("\n"):
                self.line.append("\n")
        elif tag == "a" and self.links:
            href = self.links.pop()
            self.line.append(f"]({href})" if href else "")
        elif tag in self._INLINE:
            self.code -= tag == "code"
            self.line.append(self._INLINE[tag])
        elif tag in _BLOCK:
            self.flush()
            if tag in ("ul", "ol") and self.lists:
                self.lists.pop()
            elif tag == "blockquote":
                self.quotes = max(self.quotes - 1, 0)

    def text(self, data):
        if self.fenced:
            self.line.append(data)
            return
        data = re.sub(r"\s+", " ", data)
        if not self.code:
            data = _MARKS.sub(r"\\\1", data)
            if not "".join(self.line).strip():
                data = _NUMBERED.sub(r"\1\\.", _LINE_START.sub(r"\1\\\2", data))
        self.line.append(data)

    @staticmethod
    def _title(attrs: dict[str, str]) -> str:
        return f' "{attrs["title"]}"' if attrs.get("title") else ""

    def _bullet(self) -> str:
        indent = "    " * max(len(self.lists) - 1, 0)
        if self.lists and self.lists[-1] is not None:
            self.lists[-1] += 1
            return f"{indent}{self.lists[-1]}.  "
        return f"{indent}*   "

    def flush(self):
        raw = "".join(self.line)
        self.line = []
        if self.fenced:
            self.fenced = False
            block = f"```{self.language}\n" + raw.strip("\n") + "\n```" if raw.strip() else ""
        else:
            block = re.sub(r"[ \t]*\n[ \t]*", "  \n", raw).strip()
            block = self.prefix + block if block else ""
            self.prefix = "" if block else self.prefix
        if block:
            marks = "> " * self.quotes
            self.out.append(marks + block.replace("\n", "\n" + marks) if marks else block)


def _join_blocks(blocks: list[str]) -> str:
    text = ""
    for block in blocks:
        tight = text and block.lstrip().startswith("*   ") and text.rpartition("\n")[2].lstrip().startswith("*   ")
        text += ("\n" if tight else "\n\n" if text else "") + block
    return text


def _batch(pages: pa.Array, render) -> pa.Array:
    return pa.array([render(p.as_py()) if p.is_valid else None for p in pages], pa.string())


@F.arrow_udf(T.StringType())
def _main_html_dom(pages: pa.Array) -> pa.Array:
    return _batch(pages, lambda page: "".join(_HtmlOut().parse(page)))


@F.arrow_udf(T.StringType())
def html_to_markdown(pages: pa.Array) -> pa.Array:
    """Main part of each page as markdown."""
    return _batch(pages, lambda page: _join_blocks(_MarkdownOut().parse(page)))
