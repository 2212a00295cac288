import os

import pytest
import json

from pyspark.sql import functions as F

from corpusloom.plans import text_plans
from corpusloom.operators.lifecycle import upsert_docs
from corpusloom.operators.stats import chunks_by_source, platform_stats, source_stats
from corpusloom.sources.summaries import stored_chunks_by_source, stored_platform_stats, stored_source_stats
from corpusloom.sources.registry import docs_of_kind, source_kinds, sources_of_kind
from corpusloom.sources import files as index_files
from corpusloom.sources.files import index_summary, merge_index, read_index, read_markdown_tree, repo_digest, select_repo_docs, write_digest, write_index, write_tree
from corpusloom.sources.listings import (
    discover_sources,
    llms_full_to_docs,
    llms_links,
    llms_meta,
    packages_to_docs,
    parse_url_list,
)
from corpusloom.sources.openapi import openapi_chunks, openapi_operations


def test_markdown_tree(spark, tmp_path):
    for name, text in {"a.md": "# A\nx", "sub dir/b+c.md": "b", "node_modules/x.md": "no", "sub dir/dist/y.md": "no", "z.txt": "no"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    rows = {r.title: r for r in read_markdown_tree(spark, str(tmp_path)).collect()}
    assert rows.keys() == {"a.md", "sub dir/b+c.md"}
    assert rows["a.md"].text == "# A\nx" and rows["a.md"].url == f"file://{tmp_path}/a.md"


def test_driver_holds_no_list_of_a_tree(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(index_files, "TASK_FILES", 10)
    for i in range(120):
        (tmp_path / f"f{i % 40}/deep").mkdir(parents=True, exist_ok=True)
        (tmp_path / f"f{i % 40}/deep/{i}.md").write_text("x" * i)
    (tmp_path / "empty").mkdir()
    tree = read_markdown_tree(spark, str(tmp_path))
    assert not [f for f in tree.inputFiles() if f.endswith(".md")] and tree.rdd.getNumPartitions() == 12
    assert {(r.title, len(r.text)) for r in tree.collect()} == {(f"f{i % 40}/deep/{i}.md", i) for i in range(120)}
    (tmp_path / "f0/deep/0.md").rename(tmp_path / "f0/deep/0.mdx")
    assert read_markdown_tree(spark, str(tmp_path), "*.{mdx,txt}").first().title == "f0/deep/0.mdx"
    assert read_markdown_tree(spark, str(tmp_path / "empty")).collect() == []


def test_names_and_links_of_a_tree(spark, tmp_path):
    """As the reference: hidden names count, links to folders don't, and a title is cut at the root alone."""
    root = tmp_path / "docs"
    again = f"sub{root}/a.md"
    for name in (again, ".github/b.md", "_c.md", "dist", "é\n.md"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(name)
    (root / "loop").symlink_to(root)
    (root / "l.md").symlink_to(root / "_c.md")
    (root / "gone.md").symlink_to(root / "nothing.md")
    (root / "d.md").mkdir()
    with open(os.fsencode(root) + b"/\xff.md", "wb") as file:
        file.write(b"\xff")
    rows = read_markdown_tree(spark, f"file:{root}/").selectExpr("title", "url", "cast(text as binary) t", "hex(title) h").collect()
    assert {r.h: bytes(r.t) for r in rows} == {
        name.encode().hex().upper(): text.encode() for name, text in {again: again, ".github/b.md": ".github/b.md", "_c.md": "_c.md", "é\n.md": "é\n.md", "l.md": "_c.md"}.items()
    } | {"FF2E6D64": b"\xff"}
    assert f"file://{root}/{again}" in {r.url for r in rows}


def test_documents_are_files_of_their_own(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(text_plans, "scratch_path", lambda *_: str(tmp_path / "tree"))
    docs = spark.createDataFrame([(f"s{i % 3 // 2}", "x" * i) for i in range(40)], "source STRING, text STRING").repartition(3)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    sums = {r.source: r.n_chars for r in text_plans.src_markdown_tree(spark, str(tmp_path)).collect()}
    assert sums == {s: sum(i + 1 for i in range(40) if i % 3 // 2 == n) for n, s in enumerate(("s0", "s1"))}
    assert len(list((tmp_path / "tree").rglob("*.txt"))) == 40


def test_tree_is_written_by_tasks(spark, tmp_path):
    rows = [("a/b +%", "é\n"), ("a/b +%", "é\n"), (None, "x"), ("s", None), ("s", "")]
    files = spark.createDataFrame(rows, "source STRING, text STRING").repartition(3)
    write_tree(files, str(tmp_path / "tree"), "source")
    found = [p for p in (tmp_path / "tree").rglob("*") if p.is_file()]
    assert len(found) == 5 and {p.suffix for p in found} == {".txt"}  # no checksums, no mark: Spark's writer moved no file
    names = {r.title.split("/")[0] for r in read_markdown_tree(spark, str(tmp_path / "tree"), "*.txt").collect()}
    assert names == {"source=a%2Fb%20%2B%25", "source=__HIVE_DEFAULT_PARTITION__", "source=s"}
    assert sorted(r.text for r in read_markdown_tree(spark, f"file:{tmp_path}/tree", "*.txt").collect()) == ["\n", "\n", "x\n", "é\n\n", "é\n\n"]


def test_names_of_sources_come_back(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(text_plans, "scratch_path", lambda *_: str(tmp_path / "tree"))
    docs = spark.createDataFrame([("a/b +%", "xx"), ("s=1", "y"), ("s=1", "y")], "source STRING, text STRING")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert {tuple(r) for r in text_plans.src_markdown_tree(spark, str(tmp_path)).collect()} == {("a/b +%", 3), ("s=1", 4)}
    monkeypatch.setattr(text_plans, "scratch_path", lambda *_: os.path.relpath(tmp_path / "spark"))  # not taken for mounted
    assert {tuple(r) for r in text_plans.src_markdown_tree(spark, str(tmp_path)).collect()} == {("a/b +%", 3), ("s=1", 4)}
    assert len(list((tmp_path / "spark").rglob("*.txt"))) == 3


def test_url_list(spark):
    df = spark.createDataFrame([("s", "# head\n https://a \n\n#x\r\nhttps://b\r\n")], "source_id STRING, text STRING")
    assert [tuple(r) for r in parse_url_list(df).collect()] == [("s", 1, "https://a"), ("s", 4, "https://b")]


def test_packages(spark):
    rows = [("u1", {"name": "p", "description": "d", "readme": "r"}), ("u2", {"name": "p"}), ("u3", {"name": "q", "readme": "x", "description": ""}), ("u4", {"name": "e", "readme": ""})]
    df = spark.createDataFrame([(u, json.dumps(v)) for u, v in rows], "url STRING, json STRING")
    assert {tuple(r) for r in packages_to_docs(df).collect()} == {("u1", "p: d", "r"), ("u3", "q", "x")}


def files(spark, rows):
    return spark.createDataFrame(rows, "repo STRING, path STRING, is_directory BOOLEAN, content STRING")


def test_repo_docs(spark):
    df = files(spark, [
        ("https://github.com/o/r.git", "readme.md", False, "low"), ("https://github.com/o/r.git", "README.md", False, "top"),
        ("https://github.com/o/r.git", "docs", True, None), ("https://github.com/o/r.git", "docs/a.md", False, "a"),
        ("https://github.com/o/r.git", "docs/sub/b.md", False, "b"), ("https://github.com/o/r.git", "documentation/c.md", False, "c"),
        ("https://dev.example/x", "doc/n.txt", False, "t"), ("https://dev.example/x", "documentation/c.md", False, "c"),
        ("https://dev.example/y", "src/m.md", False, "m"), ("https://dev.example/z", "README", False, "z"),
    ])
    assert {(r.url, r.title, r.text) for r in select_repo_docs(df).collect()} == {
        ("https://github.com/o/r.git", "r README", "top"),
        ("https://github.com/o/r/blob/main/docs/a.md", "rdocs/a.md", "a"),
        ("https://dev.example/z", "z README", "z"),
    }


def test_repo_digest(spark, tmp_path):
    df = files(spark, [("repo", "README.md", False, "Hello"), ("repo", "docs", True, None), ("repo", "docs/a.md", False, "a"),
                       ("repo", "node_modules/x.js", False, ""), ("repo", "test/t.py", False, "")])
    digest = repo_digest(df)
    write_digest(digest, f"{tmp_path}/digest")
    lines = [r.line for r in digest.orderBy("section", "path").collect()]
    text = "\n".join(lines)
    assert text == (
        "# Repository Documentation\n\n**Source:** repo\n\n## Overview\n\nHello\n\nRepository Structure:\n```\n"
        "📄 README.md\n📁 docs\n  📄 a.md\n```\n\n## Documentation Files\n\n- docs/a.md"
    )
    assert "📄 README.md" in "\n".join(r.value for r in spark.read.text(f"{tmp_path}/digest").collect())


def test_llms_full(spark):
    df = spark.createDataFrame([("s", "n", "u1", "intro\n#  The title \nx"), ("s", "n", "u2", "## no"), ("s", "n", "u3", "")], "source_id STRING, name STRING, url STRING, text STRING")
    assert {r.url: r.title for r in llms_full_to_docs(df).collect()} == {"u1": "The title", "u2": "n", "u3": "n"}


LLMS = """# Project

> First line
> second line

## Docs
- [Guide](https://x/guide): How to start
- [API](https://x/api)
- not a link
## Optional
- [Old](https://x/old): Legacy
# Again
- [More](https://x/more)"""


def test_llms_links(spark):
    df = spark.createDataFrame([("a", LLMS), ("b", ""), ("c", "# Only title"), ("d", "- [L](u)")], "source_id STRING, text STRING")
    meta = {r.source_id: (r.title, r.description) for r in llms_meta(df).collect()}
    assert meta == {"a": ("Again", "First line second line"), "b": ("", ""), "c": ("Only title", ""), "d": ("", "")}
    links = {(r.source_id, r.label): (r.url, r.description, r.optional) for r in llms_links(df).collect()}
    assert links == {
        ("a", "Guide"): ("https://x/guide", "How to start", False), ("a", "API"): ("https://x/api", "", False),
        ("a", "Old"): ("https://x/old", "Legacy", True), ("a", "More"): ("https://x/more", "", False), ("d", "L"): ("u", "", False),
    }
    assert llms_links(df, include_optional=False).count() == 4


def test_discover_sources(spark):
    text = "Index\n> about\n[early](https://no/1)\n- [A](https://a)\n- [optional] [B](https://b/spec.json)\n* - [C](https://c/)\n- [A again](https://a)\n- [F](https://f)\n- [F file](https://f/llms.txt)\n- [G file](https://g/llms.txt)\n- [G](https://g)"
    df = spark.createDataFrame([("s", text), ("t", "no links")], "source_id STRING, text STRING")
    known = spark.createDataFrame([("https://c/llms.txt",)], "url STRING")
    new = discover_sources(df, known)
    assert {tuple(r) for r in new.collect()} == {
        ("A", "https://a", "llmstxt-crawl"), ("B", "https://b/spec.json", "openapi"), ("F", "https://f", "llmstxt-crawl"),
        ("F file", "https://f/llms.txt", "llmstxt-crawl"), ("G file", "https://g/llms.txt", "llmstxt-crawl"),
    }
    assert discover_sources(df, known.unionByName(new.select("url"))).count() == 0


SPEC = {
    "info": {"title": "Shop", "description": "The shop."},
    "components": {"schemas": {
        "Order": {"type": "object", "description": "An order", "required": ["id"],
                  "properties": {"id": {"type": "integer"}, "item": {"$ref": "#/components/schemas/Item"},
                                 "tags": {"type": "array", "items": {"type": "string", "enum": ["a", "b"]}}}},
    }},
    "paths": {"/orders": {
        "get": {"summary": "List", "operationId": "list", "tags": ["orders"],
                "parameters": [{"name": "q", "in": "query", "required": True, "description": "text", "schema": {"type": "string"}}],
                "responses": {"404": {"description": "none"}, "200": {"description": "ok", "content": {"application/json": {"schema": {"type": "array"}}}}}},
        "post": {"description": "Create", "deprecated": True,
                 "requestBody": {"description": "body", "required": True, "content": {"application/json": {"schema": {"$ref": "#/x"}}}}},
    }},
}


def test_openapi(spark):
    df = spark.createDataFrame(
        [("s", "u", "n", json.dumps(SPEC)), ("t", "v", "m", '{"info":{}}')], "source_id STRING, url STRING, name STRING, json STRING")
    rows = openapi_chunks(df).orderBy("chunk_index").collect()
    assert [(r.source_id, r.chunk_index, r.doc_title, r.heading, r.heading_path) for r in rows] == [
        ("s", 0, "Shop", "Description", ["Description"]),
        ("s", 1, "Shop", "Schema: Order", ["Schemas", "Order"]),
        ("s", 2, "GET /orders", "List", ["orders", "List"]),
        ("s", 3, "POST /orders", "POST /orders", ["POST /orders"]),
    ]
    assert rows[1].content == (
        "Schema: Order\ntype: object\ndescription: An order\nrequired: [id]\nproperties:\n  id: type: integer\n"
        "  item:     $ref: #/components/schemas/Item\n  tags: type: array\n    items: type: string\n      enum: [a, b]"
    )
    assert rows[2].content == (
        "List\n\nOperation ID: list\n\nTags: orders\n\nParameters:\n- q (query) [required] : text \n    schema: type: string\n\n"
        "Responses:\n- 200: ok\n  application/json\n  schema: type: array\n- 404: none"
    )
    assert rows[3].content == (
        "Create\n\nOperation ID: N/A\n\nTags: N/A\n\nDeprecated: true\n\n"
        "Request Body:\nDescription: body\nRequired: true\nContent-Type: application/json\n  schema:   $ref: #/x"
    )
    ops = openapi_operations(df).orderBy("pos").collect()
    assert [(r.path, r.method, r.n_params, r.deprecated) for r in ops] == [("/orders", "GET", 1, False), ("/orders", "POST", 0, True)]


def test_openapi_odd_shapes(spark):
    """References for parameters, boolean schemas, lists beside methods and missing parts never end the job."""
    spec = {
        "components": {"schemas": {"Any": True, "Odd": {"properties": {"x": False}, "items": {"$ref": "#/y"}}}},
        "paths": {"/a": {
            "parameters": [{"name": "shared"}],
            "get": {"parameters": [{"$ref": "#/p"}, {"name": "q", "schema": True}], "responses": {"default": {}, "200": {"content": {
                "text/plain": {}, "application/json": {"schema": {"type": "string"}}}}}},
            "put": {},
        }},
    }
    df = spark.createDataFrame([("s", "u", "n", json.dumps(spec)), ("t", "v", "m", "[1]")], "source_id STRING, url STRING, name STRING, json STRING")
    rows = {(r.doc_title, r.heading): r.content for r in openapi_chunks(df).collect()}
    assert rows[("n", "Schema: Any")] == "Schema: Any\n"
    assert rows[("n", "Schema: Odd")] == "Schema: Odd\nproperties:\n  x: \nitems:   $ref: #/y"
    assert rows[("GET /a", "GET /a")] == (
        "Operation ID: N/A\n\nTags: N/A\n\nParameters:\n- #/p\n- q \n    schema: \n\n"
        "Responses:\n- 200: \n  text/plain\n  application/json\n  schema: type: string\n- default: "
    )
    assert rows[("PUT /a", "PUT /a")] == "Operation ID: N/A\n\nTags: N/A" and len(rows) == 5
    assert docs_of_kind("openapi", df).count() == 5 and "llmstxt-meta" in source_kinds()


def test_index_round_trip_keeps_other_sources(spark, tmp_path):
    def tables(*rows):
        docs = spark.createDataFrame([(s, u) for s, u in rows], "source_id STRING, url STRING")
        chunks = docs.selectExpr("url AS id", "source_id")
        vectors = docs.selectExpr("url AS chunk_id", "'m' AS model")
        return {"docs": docs, "chunks": chunks, "embeddings": vectors, "sources": docs.selectExpr("source_id AS id").distinct()}

    path = f"{tmp_path}/index"
    write_index(tables(("s", "a"), ("s", "z"), ("t", "b")), path)
    write_index(tables(("s", "c")), path)
    found = read_index(spark, path, "docs", "chunks", "embeddings", "sources")
    assert sorted((r.source_id, r.url) for r in found["docs"].collect()) == [("s", "c"), ("t", "b")]
    assert sorted((r.source_id, r.chunk_id) for r in found["embeddings"].collect()) == [("s", "c"), ("t", "b")]
    assert sorted(r.id for r in found["sources"].collect()) == ["s", "t"]
    with pytest.raises(ValueError):
        write_index({"embeddings": tables(("s", "c"))["embeddings"]}, path)


def small_tables(spark, *rows, schema="source_id STRING, url STRING"):
    docs = spark.createDataFrame(list(rows), schema)
    return {"docs": docs, "chunks": docs.selectExpr("url AS id", "source_id"), "embeddings": docs.selectExpr("url AS chunk_id", "'m' AS model")}


def shown(spark, path, version=None):
    found = read_index(spark, path, "docs", "chunks", "embeddings", version=version)
    return {name: sorted(r[c] for r in df.collect()) for (name, df), c in zip(found.items(), ("url", "id", "chunk_id"))}


def test_a_batch_is_seen_whole_or_not_at_all(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/index"
    write_index(small_tables(spark, ("1", "a"), ("1", "b"), ("2", "c")), path)
    before = shown(spark, path)
    broken = small_tables(spark, ("1", "x"))
    broken["embeddings"] = broken["embeddings"].selectExpr("chunk_id", "raise_error('lost') AS model")
    with pytest.raises(Exception, match="lost"):  # docs and chunks were written, embeddings were not
        write_index(broken, path)
    assert shown(spark, path) == before

    def fail(*_):
        raise OSError("driver lost")

    with monkeypatch.context() as m:
        m.setattr(index_files, "commit_version", fail)
        with pytest.raises(OSError):
            write_index(small_tables(spark, ("1", "x")), path)
    assert shown(spark, path) == before
    write_index(small_tables(spark, ("1", "x")), path)
    assert shown(spark, path) == {name: ["c", "x"] for name in before}
    assert shown(spark, path, version=1) == before  # a reader that holds the older version


def test_sources_that_are_empty_now_vanish(spark, tmp_path):
    path = f"{tmp_path}/index"
    write_index(small_tables(spark, ("1", "a"), ("2", "b"), ("3", "c")), path)
    covered = spark.createDataFrame([("1",), ("2",)], "source_id STRING")
    write_index(small_tables(spark, ("1", "d")), path, covered)
    assert shown(spark, path)["chunks"] == ["c", "d"] and shown(spark, path)["embeddings"] == ["c", "d"]
    nothing = {name: df.limit(0) for name, df in small_tables(spark, ("1", "a")).items()}
    write_index(nothing, path, covered)
    assert shown(spark, path)["docs"] == ["c"]
    write_index({"docs": small_tables(spark, ("3", "z"))["docs"]}, path)  # other tables are left alone
    assert shown(spark, path) == {"docs": ["z"], "chunks": ["c"], "embeddings": ["c"]}
    version = merge_index(spark, path)
    assert shown(spark, path) == {"docs": ["z"], "chunks": ["c"], "embeddings": ["c"]} and version == 5
    write_index(small_tables(spark, ("3", "y"), ("4", "v")), path)
    assert shown(spark, path)["docs"] == ["v", "y"]
    with pytest.raises(ValueError, match="jobs"):
        read_index(spark, path, "jobs")


def test_specification_documents_survive_an_upsert(spark):
    spec = {"info": {"title": "n", "description": "what it does"}, "components": {"schemas": {"A": {"type": "object"}, "B": {"type": "string"}}},
            "paths": {"/a": {"get": {}, "put": {}}, "/b": {"get": {}}}}
    df = spark.createDataFrame([(s, "u", "n", json.dumps(spec)) for s in "st"], "source_id STRING, url STRING, name STRING, json STRING")
    docs = docs_of_kind("openapi", df)
    assert docs.count() == docs.select("source_id", "url").distinct().count() == 12
    stored = spark.createDataFrame([], "id STRING, source_id STRING, url STRING, title STRING, content_md STRING, content_hash STRING")
    incoming = docs.select("source_id", "url", "title", F.col("text").alias("content_md"), F.lit(1).alias("seq"))
    assert upsert_docs(stored, incoming).count() == 12


def test_index_of_sources_finds_sources(spark):
    text = "# Index\n> all of them\n- [One](https://one.example)\n- [Two](https://two.example/spec.json)\n- [Three](https://three.example/)\n"
    raw = spark.createDataFrame([("m", "https://index.example/llms.txt", "index", text)], "source_id STRING, url STRING, title STRING, text STRING")
    known = spark.createDataFrame([("https://three.example/llms.txt",)], "url STRING")
    found = {tuple(r) for r in sources_of_kind("llmstxt-meta", raw, known).collect()}
    assert found == {("One", "https://one.example", "llmstxt-crawl"), ("Two", "https://two.example/spec.json", "openapi")}
    assert docs_of_kind("llmstxt-meta", raw).count() == 0
    assert sources_of_kind("local", raw, known).count() == 0
    with pytest.raises(ValueError):
        sources_of_kind("nothing", raw, known)


def test_figures_of_a_stored_index_read_no_chunk(spark, tmp_path):
    """After each import the noted figures are those of the tables; no file of a table is read."""
    path = f"{tmp_path}/index"

    def tables(*sources):
        rows = [(s, f"{s}{i}", f"text {i} of {s}", i + 1) for s, n in sources for i in range(n)]
        docs = spark.createDataFrame([(s, u) for s, u, _, _ in rows], "source_id STRING, id STRING")
        chunks = spark.createDataFrame(rows, "source_id STRING, id STRING, content STRING, token_count INT")
        jobs = [(s, f"j{s}{i}", ("done", "failed")[i % 2], 100 * i if i else None, f"2024-01-0{i + 1}") for s, n in sources for i in range(n)]
        return {
            "sources": spark.createDataFrame([(s, f"name {s}") for s, _ in sources], "id STRING, name STRING"), "docs": docs, "chunks": chunks,
            "embeddings": chunks.selectExpr("id AS chunk_id", "'m' AS model"),
            "jobs": spark.createDataFrame(jobs, "source_id STRING, id STRING, status STRING, duration_ms INT, created_at STRING"),
        }

    def equal():
        index, summary = read_index(spark, path, "sources", "docs", "chunks", "embeddings", "jobs"), index_summary(spark, path)
        for stored, plain in ((stored_source_stats, source_stats), (stored_platform_stats, platform_stats), (stored_chunks_by_source, chunks_by_source)):
            a, b = stored(summary), plain(index)
            assert a.columns == b.columns and sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
        assert all("/summary-" in file or "/covers-" in file for file in summary.inputFiles())

    write_index(tables(("1", 3), ("2", 2), ("3", 1)), path)
    equal()
    write_index(tables(("2", 5), ("4", 2)), path)
    equal()
    nothing = {name: df for name, df in tables(("9", 1)).items() if name in ("docs", "chunks", "embeddings")}
    write_index({name: df.limit(0) for name, df in nothing.items()}, path, spark.createDataFrame([("1",)], "source_id STRING"))
    equal()
    merge_index(spark, path)
    equal()
