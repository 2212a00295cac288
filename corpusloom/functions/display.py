"""Column functions for the report side: durations, previews, percentages."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..settings import AGENT_PREVIEW, CARD_PREVIEW


def format_duration(ms: Column) -> Column:
    """`—`, `< 1s`, `5s`, `2m 34s`, `1h 2m`; a zero second part is left out."""
    total = F.floor(ms / 1000)
    hours, minutes, seconds = F.floor(total / 3600), F.floor(total / 60) % 60, total % 60

    def part(n: Column, unit: str) -> Column:
        return F.when(n > 0, F.concat(n.cast("string"), F.lit(unit)))

    return (
        F.when(ms.isNull(), F.lit("—"))
        .when(ms < 1000, F.lit("< 1s"))
        .when(hours > 0, F.concat_ws(" ", part(hours, "h"), part(minutes, "m")))
        .when(minutes > 0, F.concat_ws(" ", part(minutes, "m"), part(seconds, "s")))
        .otherwise(part(seconds, "s"))
    )


def card_preview(content: Column) -> Column:
    return F.when(
        F.length(content) > CARD_PREVIEW, F.concat(F.substring(content, 1, CARD_PREVIEW), F.lit("..."))
    ).otherwise(content)


def agent_text(source: Column, title: Column, url: Column, heading: Column, content: Column, score: Column, chunk: Column):
    """The result block an agent reads; empty lines are left out."""
    percent = F.format_string("%.1f", F.round(score * 100, 1))
    return F.concat_ws(
        "\n",
        F.concat(F.lit("["), source, F.lit("] "), F.coalesce(title, url)),
        F.when(heading != "", F.concat(F.lit("## "), heading)),
        F.nullif(F.substring(content, 1, AGENT_PREVIEW), F.lit("")),
        F.concat(F.lit("Score: "), percent, F.lit("%")),
        F.concat(F.lit("Chunk: "), chunk),
    )


def token_estimate(chars: Column) -> Column:
    return F.floor(chars / 4 + 0.5)
