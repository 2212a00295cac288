from hypothesis import HealthCheck, given, settings, strategies as st
import pyarrow as pa
from pyspark.sql import functions as F

from corpusloom.functions import markdown
from corpusloom.functions.markdown import passages
from corpusloom.operators.chunking import chunk_drops, chunk_markdown, chunk_sets, heading_outline

PROSE = "This is a sentence that is long enough to survive the minimum length of a passage."
LIST = "\n".join(f"- [Entry {i}](https://docs.example/{i})" for i in range(6))


def chunk(spark, text):
    df = spark.createDataFrame([("d", text)], "doc_id STRING, text STRING")
    return chunk_markdown(df).orderBy("chunk_index").collect()


def test_long_text_without_headings(spark):
    rows = chunk(spark, "\n".join([PROSE] * 100))
    assert len(rows) > 1
    assert [r.chunk_index for r in rows] == list(range(len(rows)))
    assert rows[0].heading is None and rows[0].heading_path == []
    assert all(len(r.content) >= 1990 for r in rows[:-1])


def test_sections(spark):
    first, second = chunk(spark, f"# Title\n\n{PROSE}\n\n## Section 1\n\n{PROSE}\n\n## Section 2\n\n{PROSE}")
    assert first.heading == "Section 1" and first.content.startswith("# Title")
    assert second.heading == "Section 2" and second.token_count == 3 + len(PROSE.split())


def test_heading_paths(spark):
    rows = chunk(spark, f"# H1\n\n## H2\n\n### H3\n{PROSE}\n## H2b\n{PROSE}")
    assert [r.heading_path for r in rows] == [["H1", "H2", "H3"], ["H1", "H2b"]]


def test_short_and_empty(spark):
    assert chunk(spark, "Too short.") == [] and chunk(spark, "") == []
    assert chunk(spark, "x" * 50) == [] and len(chunk(spark, "x" * 51)) == 1


def test_first_heading_of_level_two_leaves_a_hole(spark):
    assert chunk(spark, f"## Start\n{PROSE}")[0].heading_path == [None, "Start"]


def test_heading_inside_fence_counts(spark):
    rows = chunk(spark, f"# A\n{PROSE}\n```\n# comment\n{PROSE}\n```")
    assert [r.heading for r in rows] == ["A", "comment"]


def test_html_lines_and_fences(spark):
    text = f'<div class="x">\n{PROSE}\n</div>\n```html\n<div>\n```'
    assert chunk(spark, text)[0].content == f"{PROSE}\n```html\n<div>\n```"


def test_link_lists_are_counted_and_take_no_index(spark):
    docs = [
        ("a", f"# A\n{PROSE}\n# See also\n{LIST}\n# B\n{PROSE}"),
        ("b", f"# A\n{PROSE}"),
        ("c", f"# A\n{PROSE}\n- [x](y)"),
        ("d", f"# A\n{LIST}\n# B\n{LIST}\n# C\n{PROSE}"),
    ]
    df = spark.createDataFrame([("s", *d) for d in docs], "source_id STRING, doc_id STRING, text STRING")
    sets = chunk_sets(df)
    assert {r.doc_id: r.dropped for r in sets.collect()} == {"a": 1, "b": 0, "c": 0, "d": 2}
    assert [r["count"] for r in chunk_drops(sets).collect()] == [3]
    rows = chunk_markdown(df).filter("doc_id = 'a'").orderBy("chunk_index").collect()
    assert [(r.chunk_index, r.heading) for r in rows] == [(0, "A"), (1, "B")]


def test_outline(spark):
    df = spark.createDataFrame([("d", "## A\ntext\n### B\n# C\n### D\n## E\n####### no\n#no")], "doc_id STRING, text STRING")
    rows = heading_outline(df).orderBy("pos").collect()
    assert [(r.level, r.heading, r.path) for r in rows] == [
        (2, "A", [None, "A"]),
        (3, "B", [None, "A", "B"]),
        (1, "C", ["C"]),
        (3, "D", ["C", None, "D"]),
        (2, "E", ["C", "E"]),
    ]


@settings(max_examples=200, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.sampled_from(["# A", "## B", "### C", "", PROSE, "word", "x" * 700, "y" * 2100]), max_size=25))
def test_passages_keep_order_and_lines(lines):
    found = list(passages("\n".join(lines)))
    kept = [line for content, _, _ in found for line in content.split("\n") if line]
    rest = iter(line for line in lines if line)
    assert all(line in rest for line in kept)  # a subsequence: nothing invented, moved or split
    assert all(len(content) > 50 for content, _, _ in found)
    assert {x for x in lines if len(x) > 50} <= set(kept)


def test_one_scan_and_one_python_step(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", F.col("text"))
    plan = chunk_markdown(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "Exchange" not in plan


def test_passages_leave_a_task_in_pieces():
    texts = [None, "", *("# h\n" + f"line {i} " * 20 for i in range(700))]
    pieces = list(markdown.split_passages.func(iter([pa.array(texts), pa.array([], pa.string())])))
    assert [len(p) for p in pieces] == [256, 256, 190]
    found = [x["content"].split()[3] if x else None for p in pieces for x in (rows[0] if rows else None for rows in p.to_pylist())]
    assert found == [None, None, *map(str, range(700))]
