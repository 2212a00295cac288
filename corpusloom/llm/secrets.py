"""Secret scans through a trigram inverted index.

Each rule's expression gives a Boolean trigram query. The index lists the texts (by hash) that
contain each trigram the rules ask for; a text's postings are intersected by the query, and only
texts that pass are searched with the expression itself. Rules without mandatory trigrams search
every text. Spans are code points, end exclusive; matches of a rule are leftmost and do not
overlap, and those whose secret part is too short are dropped after matching.

Candidates are written before they are joined, so their size is known: a short list is shipped to
the texts, a long one is shuffled with them. Equal texts share their postings.

Defined cases: a null or empty text has no spans; repeated rows get equal spans; an empty table
gives no rows; other columns are kept as they are.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.arrays import array_rows, let
from ..settings import materialise
from .names import spare_names
from .trigrams import trigram_query

_CHUNK = 256  # elements summed in one go


@dataclass(frozen=True)
class Rule:
    """`group` of a match must have `least` characters; `mask` finds what to hide."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    mask: str = ""

    def query(self):
        return trigram_query(self.pattern)


def _either(word: str) -> str:
    """ASCII letters in either case, in the same words for every engine."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


# --- fixed values: what the base rules look for ---------------------------------------
_NAMES = "|".join(map(_either, ("password", "passwd", "secret", "token"))) + "|" + _either("api") + "_?" + _either("key")
_ASSIGN = rf"""({_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]"""
BASE_RULES = (
    Rule("assign", _ASSIGN + "+)", 2, 12, _ASSIGN + "{12,})"),
    Rule("access", "AKIA[A-Z0-9]+", 0, 18, "AKIA[A-Z0-9]{14,}"),
    Rule("hex", "[0-9a-f]{16,}", 0, 16, "[0-9a-f]{16,}"),
)
# --- fixed values: public formats of further tokens ------------------------------------
MORE_RULES = tuple(
    Rule(kind, pattern, mask=pattern)
    for kind, pattern in (
        ("host_token", "gh[pousr]_[A-Za-z0-9]{36,}"),
        ("chat_token", "xox[abprs]-[A-Za-z0-9-]{10,}"),
        ("cloud_key", "AIza[0-9A-Za-z_-]{35}"),
        ("private_key", "-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
        ("web_token", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]+"),
    )
)
RULES = BASE_RULES + MORE_RULES


def vocabulary(rules: Iterable[Rule]) -> list[str]:
    """The trigrams the queries of the rules ask for."""
    return sorted({t for rule in rules for part in rule.query() or () for t in part})


def text_key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def build_index(docs: DataFrame, trigrams: Sequence[str], text: str = "text") -> DataFrame:
    """Postings (trigram, key), written ordered by trigram inside each file, so that searches skip others."""
    vocab = F.array(*map(F.lit, trigrams)) if trigrams else F.array().cast("array<string>")
    held = let(F.lower(F.coalesce(F.col(text), F.lit(""))), lambda low: F.filter(vocab, lambda t: F.contains(low, t)))
    keyed = docs.select(text_key(F.col(text)).alias("key"), F.col(text))
    return materialise(array_rows(keyed, ["key"], held, "trigram").sortWithinPartitions("trigram", "key"), "trigrams")


def candidates(index: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """(key, kinds): the rules whose trigram query the postings of a text meet."""
    asked = [rule for rule in rules if rule.query() is not None]
    postings = index.filter(F.col("trigram").isin(vocabulary(asked)))
    held = postings.groupBy("key").agg(F.collect_set("trigram").alias("held"))

    def met(rule: Rule) -> Column:
        parts = [F.array_except(F.array(*map(F.lit, sorted(part))), F.col("held")) for part in rule.query()]
        some = F.lit(False)
        for part in parts:
            some = some | (F.size(part) == 0)
        return F.when(some, F.lit(rule.kind))

    kinds = F.array_compact(F.array(*map(met, asked))) if asked else F.array().cast("array<string>")
    return materialise(held.select("key", kinds.alias("kinds")).filter(F.size("kinds") > 0), "candidates")


def _sums(values: Column) -> Column:
    """Running totals of a short array."""
    start = F.array().cast("array<bigint>")
    return F.aggregate(values, start, lambda acc, v: F.array_append(acc, F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0).cast("long")) + v))


def _raised(values: Column, by: Column) -> Column:
    return F.transform(values, lambda v: v + by)


def running_totals(values: Column) -> Column:
    """Running totals of an array of longs: inside chunks first, then of the chunks."""

    def by_chunk(chunks: Column) -> Column:
        inner = F.transform(chunks, _sums)
        before = F.transform(chunks, lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, b: a + b))
        return F.flatten(F.zip_with(inner, _sums(F.concat(F.array(F.lit(0).cast("long")), F.slice(before, F.lit(1), F.size(before) - 1))), _raised))

    parts = F.sequence(F.lit(0), F.floor((F.size(values) - 1) / _CHUNK).cast("int"))
    cut = let(values, lambda v: F.transform(parts, lambda c: F.slice(v, c * _CHUNK + 1, F.lit(_CHUNK))))
    return let(cut, by_chunk)


def rule_spans(text: Column, rule: Rule, order: int) -> Column:
    """array<struct<start, order, end, kind>> of one rule in a text."""
    pattern = F.lit(rule.pattern)
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    secret = F.regexp_extract_all(text, pattern, F.lit(rule.group))
    gaps = F.split(text, rule.pattern, -1)
    rows = F.arrays_zip(found.alias("match"), secret.alias("secret"), F.slice(gaps, F.lit(1), F.size(gaps) - 1).alias("gap"))

    def placed(matches: Column) -> Column:
        ends = running_totals(F.transform(matches, lambda m: (F.length(m["gap"]) + F.length(m["match"])).cast("long")))
        spans = F.zip_with(
            matches,
            ends,
            lambda m, end: F.struct(
                (end - F.length(m["match"])).alias("start"), F.lit(order).alias("order"), end.alias("end"), F.lit(rule.kind).alias("kind"),
                F.length(m["secret"]).alias("n"),
            ),
        )
        kept = F.filter(spans, lambda s: s["n"] >= rule.least)
        return F.transform(kept, lambda s: F.struct(s["start"], s["order"], s["end"], s["kind"]))

    none = F.array().cast("array<struct<start:bigint,order:int,end:bigint,kind:string>>")
    return F.when(text.rlike(rule.pattern), let(rows, placed)).otherwise(none)


def with_spans(docs: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text", name: str = "spans") -> DataFrame:
    """`docs` with the secrets of every text: array of (start, order, end, kind), by start, then rule.

    A column called `name` is replaced; all others are kept.
    """
    index = build_index(docs, vocabulary(rules), text)
    key, kinds = spare_names(docs, "_key", "_kinds")
    found = candidates(index, rules).withColumnsRenamed({"key": key, "kinds": kinds})
    joined = docs.withColumn(key, text_key(F.col(text))).join(found, key, "left").drop(key)
    content = F.coalesce(F.col(text), F.lit(""))
    none = F.array().cast("array<struct<start:bigint,order:int,end:bigint,kind:string>>")
    parts = []
    for order, rule in enumerate(rules):
        spans = rule_spans(content, rule, order)
        asked = F.coalesce(F.array_contains(kinds, rule.kind), F.lit(False))
        parts.append(spans if rule.query() is None else F.when(asked, spans).otherwise(none))
    return joined.withColumn(name, F.sort_array(F.concat(*parts))).drop(kinds)


def told(spans: Column) -> Column:
    """Spans as text: kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def masked(
    docs: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text", cover: str = "[secret]", length: str | None = None
) -> DataFrame:
    """`docs` with every found secret covered; texts without one stay as they are.

    `length` names a column that holds the number of characters of the text.
    """
    hidden = F.col(text)
    for rule in rules:
        hidden = F.regexp_replace(hidden, rule.mask, F.lit(cover))
    (spans,) = spare_names(docs, "_spans")
    found = with_spans(docs, rules, text, spans)
    some = F.size(spans) > 0
    done = found.withColumn(text, F.when(some, hidden).otherwise(F.col(text)))
    if length:
        done = done.withColumn(length, F.when(some, F.length(text).cast("long")).otherwise(F.col(length)))
    return done.drop(spans)
