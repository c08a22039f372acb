"""Ranked retrieval: phrase matching, weighted BM25 over fields, coverage, filters and pages.

One aggregate over the index gives the collection's figures: its size, and how many rows hold each phrase. A second pass keeps
the rows that match, counts the phrases in those, and scores them; nothing is persisted. Collection figures come from the whole index, before any
filter; under a field restriction a phrase's document frequency is counted within those fields."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from florilege.functions.text import base_ref
from florilege.plans.query import TRIAGE_CHARS, TRIAGE_SIZE, Parsed, Phrase, Unit

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6


def needle(phrase: Phrase) -> str:
    return " " + "  ".join(phrase.words) + ("" if phrase.prefix else " ")


def occurrences(pad: Column, phrase: Phrase) -> Column:
    """Places of a phrase, overlapping ones too."""
    text = needle(phrase)
    if any(phrase.words[:k] == phrase.words[-k:] for k in range(1, len(phrase.words))) or phrase.prefix and len(phrase.words) > 1:
        return F.regexp_count(pad, F.lit(f"(?={re.escape(text)})"))
    return ((F.length(pad) - F.length(F.replace(pad, F.lit(text), F.lit("")))) / len(text)).cast("int")


def has(pad: Column, phrase: Phrase) -> Column:
    return F.contains(pad, F.lit(needle(phrase)))


def any_of(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, columns) if columns else F.lit(False)


def all_of(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, columns) if columns else F.lit(True)


def unit_matches(unit: Unit, fields: tuple[str, ...]) -> Column:
    """A phrase never runs from one field into another."""
    return any_of([has(F.col(f"pad_{f}"), p) for p in unit.phrases for f in fields])


def matches(query: Parsed, fields: tuple[str, ...]) -> Column:
    parts = [unit_matches(u, fields) for u in query.required]
    return all_of(parts + ([any_of([unit_matches(u, fields) for u in query.optional])] if query.optional else []))


@dataclass(frozen=True)
class Scoring:
    """Weights by field; fields of weight 0 are not searched."""

    weights: dict[str, float]

    @property
    def fields(self) -> tuple[str, ...]:
        return tuple(f for f, w in self.weights.items() if w > 0)


def scored(index: DataFrame, query: Parsed, scoring: Scoring) -> DataFrame:
    """The rows that match, with `coverage` (optional units matched) and `score` (lower is better)."""
    fields, phrases = scoring.fields, query.phrases()
    distinct = list(dict.fromkeys(phrases))
    slim = [c for c in index.columns if not c.startswith("pad_")]
    holds = lambda p: any_of([has(F.col(f"pad_{f}"), p) for f in fields])
    found = lambda u: any_of(list(map(holds, u.phrases)))
    # which rows hold a phrase is a plain search; how often it stands there is counted in the rows that match alone
    figures = index.agg(F.count("*"), F.avg("n_tokens"), *map(F.count_if, map(holds, distinct))).first()
    n, mean = figures[0], figures[1] or 1.0
    wanted = all_of([found(u) for u in query.required] + ([any_of([found(u) for u in query.optional])] if query.optional else []))
    coverage = sum((found(u).cast("int") for u in query.optional), F.lit(0))
    weight = lambda p: sum((F.lit(scoring.weights[f]) * occurrences(F.col(f"pad_{f}"), p) for f in fields), F.lit(0.0))
    hits = index.filter(wanted).select(*slim, coverage.alias("coverage"), F.array(*map(weight, distinct)).alias("_f"))
    score = F.lit(0.0)
    for p in phrases:  # a phrase that stands in two units counts twice
        i = distinct.index(p)
        idf = math.log((n - figures[2 + i] + 0.5) / (figures[2 + i] + 0.5))
        idf = idf if idf > 0 else LEAST_IDF
        f = F.col("_f")[i]
        score = score - idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("n_tokens") / mean))
    return hits.select(*slim, "coverage", score.alias("score"))


def ranked(rows: DataFrame, query: Parsed, newest: str, id_col: str) -> list[Column]:
    """Order of relevance: coverage if more than one unit is optional, score, then the newest."""
    first = [F.desc("coverage")] if len(query.optional) > 1 else []
    return [*first, F.asc("score"), F.desc(newest), F.desc(F.col(id_col).cast("string"))]


def page(rows: DataFrame, order: list[Column], size: int, number: int = 1) -> DataFrame:
    return rows.orderBy(*order).offset((number - 1) * size).limit(size)


def in_dates(column: Column, first=None, last=None) -> Column:
    if first and last and first > last:
        raise ValueError("the first date is after the last")
    return all_of(([column >= F.lit(first)] if first else []) + ([column <= F.lit(last)] if last else []))


def snippet(text: Column, norm: Column, terms: list[str], before: int = 200, size: int = 900) -> Column:
    """`size` characters from `before` the first term, by its place in the comparison form."""
    places = [F.nullif(F.instr(norm, F.lit(re.sub(r"[$*]+$", "", t))), F.lit(0)) for t in terms]
    at = places[0] if len(places) == 1 else F.least(*places)
    return F.substring(text, F.greatest(F.coalesce(at, F.lit(1)) - before, F.lit(1)), F.lit(size))


def triage(rows: DataFrame, text_col: str, order: list[Column], number: int = 1) -> DataFrame:
    """A long page for a reader to rank: 30 rows, their texts cut."""
    cut = F.when(F.length(text_col) > TRIAGE_CHARS, F.concat(F.substring(text_col, 1, TRIAGE_CHARS), F.lit("…"))).otherwise(F.col(text_col))
    return page(rows, order, TRIAGE_SIZE, number).withColumn(text_col, cut)


def field_scoring(asked: tuple[str, ...], weights: dict[str, float], header: str, header_weight: float = 0.5) -> Scoring:
    """Weights under a restriction to fields: a header that is not asked for stays in with little weight, so texts without parts are found."""
    return Scoring({f: w if f in asked else header_weight if f == header else 0.0 for f, w in weights.items()})


def citing_filter(rows: DataFrame, id_col: str, edges: DataFrame, kind: str, ref: str) -> DataFrame:
    """`rows` that cite a reference, under any court's name."""
    base = ref.split("/")[0].strip()
    sources = edges.filter((F.col("kind") == kind) & (base_ref(F.col("ref")) == base)).select(F.col("source").alias(id_col)).distinct()
    return rows.join(sources, id_col, "left_semi")


@dataclass(frozen=True)
class Outcome:
    """What a search came to: `rows` of a page, `beyond` the last page, `empty`; refusals raise."""

    kind: str
    total: int
    rows: DataFrame | None = None
    last_page: int = 0
    without_filters: int = 0
    by_unit: tuple[tuple[str, int, int], ...] = ()


def zero_diagnosis(index: DataFrame, query: Parsed, fields: tuple[str, ...], most: int = 8) -> DataFrame:
    """unit, alone, rest: rows that have the unit, and rows that match without it."""
    units = query.units[:most]
    if len(query.units) < 2:
        return index.sparkSession.createDataFrame([], "unit string, alone long, rest long")
    rest = [query.without(k) for k in range(len(units))]
    counted = index.agg(*(F.count_if(unit_matches(u, fields)).alias(f"a{k}") for k, u in enumerate(units)), *(F.count_if(matches(r, fields)).alias(f"r{k}") for k, r in enumerate(rest)))
    each = F.array(*(F.struct(F.lit(u.label).alias("unit"), F.col(f"a{k}").alias("alone"), F.col(f"r{k}").alias("rest")) for k, u in enumerate(units)))
    return counted.select(F.inline(each))


def search(index: DataFrame, query: Parsed, scoring: Scoring, id_col: str, newest: str, where: Column | None = None, order: str = "relevant", size: int = 10, number: int = 1) -> Outcome:
    if order not in ("relevant", "newest", "oldest"):
        raise ValueError(f"unknown order {order!r}")
    if not query.units and order == "relevant":
        order = "newest"  # without words there is no relevance
    rows = scored(index, query, scoring)
    kept = rows.filter(where) if where is not None else rows
    total = kept.count()
    last = -(-total // size)
    if not total:
        unfiltered = rows.count() if where is not None else 0
        why = tuple(tuple(r) for r in zero_diagnosis(index, query, scoring.fields).collect())
        return Outcome("empty", 0, None, 0, unfiltered, why)
    if number > last:
        return Outcome("beyond", total, None, last)
    way = F.asc if order == "oldest" else F.desc
    by = ranked(kept, query, newest, id_col) if order == "relevant" else [way(newest), way(F.col(id_col).cast("string"))]
    return Outcome("rows", total, page(kept, by, size, number), last)
