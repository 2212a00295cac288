import pytest
from pyspark.sql import functions as F

from corpusloom.functions.display import card_preview, format_duration
from corpusloom.functions.text import (
    analyse,
    is_link_list,
    norm_key,
    strip_crawler_noise,
    strip_html_lines,
    word_count,
    ws_trim,
)

LINKS = "- [One](https://a/1)\n* [Two](https://a/2) — with a description\n3. [Three](/3)\n+ [Four](/4)"


@pytest.mark.parametrize(
    "text, expected",
    [
        (LINKS, True),
        ("1. [A](/a)\n2. [B](/b)\n3. [C](/c)", True),
        ("- [A](/a)\nprose one\nprose two", False),
        ("plain prose about links like [this](x)", False),
        ("```\n- [A](/a)\n- [B](/b)\n```", False),
        ("```\ncode\n```\n- [A](/a)\n- [B](/b)", True),
        ("- [A](/a)\n" * 7 + "prose\n" * 3, False),  # exactly 0.7 is not more than 0.7
        ("- [A](/a)\n" * 8 + "prose\n" * 3, True),
        ("- [A](/a)\n```\nunclosed", True),
        ("", False),
    ],
)
def test_link_list(one, text, expected):
    assert one(is_link_list(F.col("t")), t=text) is expected


@pytest.mark.parametrize(
    "text, expected",
    [
        ('<div style="a">\nkept\n  </div>  \n<br/>\nend', "kept\nend"),
        ("Array<string> stays <b>inline</b>", "Array<string> stays <b>inline</b>"),
        ("<p>\n```html\n<div>\n```\n</p>\nx", "```html\n<div>\n```\nx"),
        ("<a>\n```\n<b>", "```\n<b>"),
        ("no tags", "no tags"),
    ],
)
def test_html_lines(one, text, expected):
    assert one(strip_html_lines(F.col("t")), t=text) == expected


@pytest.mark.parametrize(
    "text, expected",
    [
        ("Next: [Guide](/g)\nkept\nPREV | [Intro](/i)", "kept"),
        ("[Home](/) › [Docs](/d) › [Guide](/g)\nbody", "body"),
        ("[Home](/) / [Docs](/d)\nbody [Home](/) / [Docs](/d) in prose", "body [Home](/) / [Docs](/d) in prose"),
        ("```\nNext: [Guide](/g)\n```\nPrevious: [X](/x)\nend", "```\nNext: [Guide](/g)\n```\nend"),
        ("[Only](/one)", "[Only](/one)"),
    ],
)
def test_crawler_noise(one, text, expected):
    assert one(strip_crawler_noise(F.col("t")), t=text) == expected


def test_small_functions(one):
    assert one(norm_key(F.col("t")), t="  Hello\n\tWORLD\xa0 x ") == "hello world x"
    assert one(word_count(F.col("t")), t=" a  b\xa0c\n d﻿") == 4
    assert one(ws_trim(F.col("t")), t="\xa0\t x \n") == "x"
    assert one(analyse(F.col("t")), t="The Über-fast index, and 42 more words!") == ["über", "fast", "index", "42", "words"]


@pytest.mark.parametrize(
    "ms, text",
    [(None, "—"), (0, "< 1s"), (999, "< 1s"), (1000, "1s"), (59_000, "59s"), (60_000, "1m"), (154_000, "2m 34s"),
     (3_600_000, "1h"), (3_720_000, "1h 2m"), (3_601_000, "1h")],
)
def test_format_duration(spark, ms, text):
    df = spark.createDataFrame([(ms,)], "ms BIGINT")
    assert df.select(format_duration(F.col("ms"))).first()[0] == text


def test_card_preview(one):
    assert one(card_preview(F.col("t")), t="x" * 400) == "x" * 400
    assert one(card_preview(F.col("t")), t="x" * 401) == "x" * 400 + "..."
