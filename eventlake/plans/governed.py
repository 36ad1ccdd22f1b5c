"""Bounded reads for callers that are not trusted to be careful.

A request is a structure, not text: writing, reading files, unknown functions, renaming columns or
packing many rows into one value cannot be expressed in it. What can be expressed is checked before
anything runs, priced from row-group statistics, limited, and measured before it is handed out."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from datetime import date, datetime
from decimal import Decimal
from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventlake.fixed_values import MAX_PAIRS, MAX_RESULT_KB, MAX_ROWS, MAX_WINDOW_DAYS, SCAN_BUDGET_MB
from eventlake.functions import json_text
from eventlake.operators.scan_estimate import estimate_scan
from eventlake.operators.zone_map import ZoneMap
from eventlake.session import compute_once

EVENTS = "events"
APPROVED = ("error_codes", EVENTS, "rollup_daily_errors", "rollup_daily_health")
CHEAPER = "rollup_daily_health and rollup_daily_errors hold daily totals and rates"

AGGREGATES = {
    "count": lambda c: F.count(c),
    "sum": lambda c: F.sum(c),
    "min": lambda c: F.min(c),
    "max": lambda c: F.max(c),
    "avg": lambda c: F.avg(c),
    "count_distinct": lambda c: F.countDistinct(c),
    "approx_count_distinct": lambda c: F.approx_count_distinct(c),
}
COMPARISONS = {
    "=": lambda c, v: c == v,
    "<>": lambda c, v: c != v,
    "<": lambda c, v: c < v,
    "<=": lambda c, v: c <= v,
    ">": lambda c, v: c > v,
    ">=": lambda c, v: c >= v,
    "in": lambda c, v: c.isin(*v),
    "is null": lambda c, v: c.isNull(),
    "is not null": lambda c, v: c.isNotNull(),
}

PLAIN = (bool, int, float, str, Decimal, date, datetime)


class Refused(Exception):
    """Why a request is not run, worded so that the caller can mend it."""


@dataclass(frozen=True)
class JsonField:
    """A field inside a JSON text column."""

    column: str
    key: str


Ref = str | JsonField


@dataclass(frozen=True)
class Filter:
    column: Ref
    op: str
    value: object = None


@dataclass(frozen=True)
class Aggregate:
    function: str
    column: Ref | None          # None only for count: all rows
    alias: str


@dataclass(frozen=True)
class Source:
    """One table of a request. Every copy of the events carries a closed window of its own."""

    table: str
    first: date | None = None
    last: date | None = None
    filters: Sequence[Filter] = ()


@dataclass(frozen=True)
class Request:
    source: Source
    columns: Mapping[str, Ref] = field(default_factory=dict)     # output name -> column; or keys
    aggregates: Sequence[Aggregate] = ()
    join: Source | None = None
    join_on: Sequence[tuple[str, str]] = ()
    order_by: Sequence[tuple[str, bool]] = ()                      # output name, descending?
    limit: object = None
    every_column: bool = False
    label: str = ""


@dataclass
class Answer:
    status: str                  # ok or refused
    note: str = ""
    df: DataFrame | None = None
    mb_scanned: float = 0.0

    @property
    def rows(self) -> list:
        """The rows; their number and size were checked before."""
        return self.df.collect() if self.df is not None else []


def check(request: Request, max_rows: int = MAX_ROWS, max_window_days: int = MAX_WINDOW_DAYS) -> tuple[int, bool]:
    """All rules that need no data. Returns the limit to use, and whether the caller asked for it."""
    for source in _sources(request):
        if source.table not in APPROVED:
            raise Refused(f"{source.table!r} is no approved table, there are: {', '.join(APPROVED)}")
        for f in source.filters:
            if f.op not in COMPARISONS:
                raise Refused(f"unknown comparison {f.op!r}")
            values = f.value if f.op == "in" and isinstance(f.value, (list, tuple)) else [f.value]
            if not all(v is None or isinstance(v, PLAIN) for v in values):
                raise Refused("filters compare with plain values only")
        if source.table == EVENTS:
            _check_window(source, max_window_days)
    for a in request.aggregates:
        if a.function not in AGGREGATES:
            raise Refused(f"function {a.function!r} is not offered, there are: {', '.join(AGGREGATES)}")
    if any(s.table == EVENTS for s in _sources(request)) and (
            request.every_column or not (request.columns or request.aggregates)):
        raise Refused(f"whole rows of {EVENTS} are not given out, name the columns needed")
    outputs = {*request.columns, *(a.alias for a in request.aggregates)}
    if not request.every_column and not outputs.issuperset(c for c, _ in request.order_by):
        raise Refused("order by columns that are given out")
    limit = request.limit
    if type(limit) is not int or not 0 <= limit <= max_rows:
        return max_rows, False
    return limit, True


def _sources(request: Request) -> list[Source]:
    return [s for s in (request.source, request.join) if s is not None]


def _check_window(source: Source, max_window_days: int) -> None:
    for day in (source.first, source.last):
        if day is None:
            raise Refused(f"each copy of {EVENTS} needs a first and a last day; {CHEAPER}")
        if type(day) is not date:
            raise Refused(f"the window has to be plain dates, not {day!r}")
    if (source.last - source.first).days + 1 > max_window_days:
        raise Refused(f"the window on {EVENTS} spans more than {max_window_days} days; {CHEAPER}")


class GovernedReader:
    """Runs requests against approved tables.

    `stats` are the row-group statistics of the events layout: a zone map, of which an estimate opens the asked days only, or a table.
    Only the events are priced: the other tables are small. Nothing is cut off unasked: a result of more than max_rows
    rows, without a smaller limit in the request, is refused, and so is a join without aggregates that forms more
    than max_pairs pairs."""

    def __init__(self, spark: SparkSession, tables: Mapping[str, DataFrame], stats: DataFrame | ZoneMap,
                 budget_mb: float = SCAN_BUDGET_MB, max_result_kb: float = MAX_RESULT_KB,
                 max_rows: int = MAX_ROWS, max_window_days: int = MAX_WINDOW_DAYS, max_pairs: int = MAX_PAIRS):
        self.spark = spark
        self.tables = {name: tables[name] for name in APPROVED if name in tables}
        self.stats = stats
        self.budget_mb = budget_mb
        self.max_result_kb = max_result_kb
        self.max_rows = max_rows
        self.max_window_days = max_window_days
        self.max_pairs = max_pairs

    def run(self, request: Request) -> Answer:
        return self._run([request])

    def run_union(self, *requests: Request) -> Answer:
        """Distinct rows of several requests. Each has to pass on its own, and all together have one scan budget and one
        result cap."""
        return self._run(list(requests))

    def _run(self, requests: list[Request]) -> Answer:
        try:
            limits = [check(r, self.max_rows, self.max_window_days) for r in requests]
            for r in requests:
                self._check_columns(r)
            mb = sum(self.scan_mb(r) for r in requests)
            if mb > self.budget_mb:
                raise Refused(f"it would read about {mb:,.2f} MB and the budget is {self.budget_mb} MB, "
                              f"ask for fewer days or columns; {CHEAPER}")
            for r in requests:
                self._check_pairs(r)
            arms = []
            for r, (limit, own) in zip(requests, limits, strict=True):
                arm = self.frame(r)
                if len(requests) > 1 and not own:
                    arm = arm.distinct()
                # one row more than may be given out tells whether there are more
                arms.append(arm.limit(limit if own else limit + 1))
            merged = reduce(DataFrame.unionByName, arms)
            if len(arms) > 1:
                merged = merged.distinct().limit(self.max_rows + 1)
            result = compute_once(merged)
            self._check_result(result)
        except Refused as why:
            return Answer("refused", str(why))
        except PySparkException as why:
            return Answer("refused", f"Spark could not run it: {str(why).splitlines()[0]}")
        return Answer("ok", "", result, mb)

    def _check_result(self, result: DataFrame) -> None:
        if (rows := result.count()) > self.max_rows:
            raise Refused(f"the result has more than {rows - 1} rows, which is the most that is given out; "
                          "aggregate more, or ask for a limit")
        kb = result_kb(result)
        if kb > self.max_result_kb:
            raise Refused(f"the result has about {kb:,.0f} KB and the cap is {self.max_result_kb} KB, "
                          "ask for fewer columns or aggregate more")

    def _check_pairs(self, request: Request) -> None:
        """Counts the pairs of a join without aggregates from counts per key, before any is formed."""
        if request.join is None or request.aggregates:
            return
        keys = self._join_keys(request)
        left = self._bounded(request.source).groupBy(*[F.col(a).alias(f"k{i}") for i, (a, _) in enumerate(keys)]).agg(F.count("*").alias("n"))
        right = self._bounded(request.join).groupBy(*[F.col(b).alias(f"k{i}") for i, (_, b) in enumerate(keys)]).agg(F.count("*").alias("m"))
        pairs = left.join(right, [f"k{i}" for i in range(len(keys))]).agg(F.sum(F.col("n") * F.col("m")).alias("pairs")).first()["pairs"] or 0
        if pairs > self.max_pairs:
            raise Refused(f"the join forms {pairs:,} pairs and the cap is {self.max_pairs:,}; filter more, or ask for aggregates")

    @staticmethod
    def _join_keys(request: Request) -> list[tuple[str, str]]:
        if not request.join_on:
            raise Refused("a join needs columns to join on")
        return list(request.join_on)

    def scan_mb(self, request: Request) -> float:
        """Estimated MB of the event columns mentioned; 0 for requests on small tables."""
        mb = 0.0
        for source in _sources(request):
            if source.table == EVENTS:
                wanted = {"day": (source.first, source.last)}
                wanted |= {f.column: (f.value, f.value) for f in source.filters
                           if f.op == "=" and isinstance(f.column, str) and f.column != "day"}
                columns = sorted(_mentioned(request))
                estimate = self.stats.estimate(columns, wanted) if isinstance(self.stats, ZoneMap) else estimate_scan(self.stats, columns, wanted)
                mb += estimate.first()["bytes"] / 1e6
        return mb

    def frame(self, request: Request) -> DataFrame:
        """The request as a DataFrame, still without its limit."""
        if request.join is not None:
            joined, weight = self._joined(request)
        else:
            joined, weight = self._bounded(request.source), None
        outputs = [_column(ref).alias(name) for name, ref in request.columns.items()]
        if request.aggregates:
            measures = [_aggregate(a, weight) for a in request.aggregates]
            out = joined.groupBy(*outputs).agg(*measures) if outputs else joined.agg(*measures)
        else:
            out = joined.select(*outputs) if outputs else joined
        if request.order_by:
            out = out.orderBy(*[F.desc(c) if down else F.asc(c) for c, down in request.order_by])
        return out

    def _joined(self, request: Request) -> tuple[DataFrame, Column | None]:
        """Join two bounded tables. Where only aggregates are asked for, equal rows of a side are
        first counted together, so that a device with very many events on both sides meets itself
        once and not once per pair of events; the counts then weigh the aggregates."""
        keys = self._join_keys(request)
        left, right = self._bounded(request.source), self._bounded(request.join)
        if request.aggregates:
            # filters have been applied, so their columns need not tell rows apart
            used = _given_out(request)
            left, right = (
                df.groupBy(*[c for c in df.columns if c in used]).agg(F.count("*").alias(n))
                for df, n in ((left, "_copies_l"), (right, "_copies_r"))
            )
        left, right = left.alias("l"), right.alias("r")
        on = F.lit(True)
        for a, b in keys:
            on = on & (F.col(f"l.{a}") == F.col(f"r.{b}"))
        weight = F.col("_copies_l") * F.col("_copies_r") if request.aggregates else None
        return left.join(right, on), weight

    def _table(self, source: Source) -> DataFrame:
        if source.table not in self.tables:
            raise Refused(f"{source.table} has not been built yet")
        return self.tables[source.table]

    def _check_columns(self, request: Request) -> None:
        known = {c for s in _sources(request) for c in self._table(s).columns}
        if unknown := sorted(_mentioned(request) - known):
            raise Refused(f"Spark could not run it: there is no column {', '.join(unknown)}")

    def _bounded(self, source: Source) -> DataFrame:
        df = self._table(source)
        if source.first is not None and source.last is not None:
            df = df.where(F.col("day").between(F.lit(source.first), F.lit(source.last)))
        for f in source.filters:
            df = df.where(COMPARISONS[f.op](_column(f.column), f.value))
        return df


def _column(ref: Ref) -> Column:
    return json_text(ref.column, ref.key) if isinstance(ref, JsonField) else F.col(ref)


def _aggregate(a: Aggregate, weight: Column | None) -> Column:
    if a.column is None and a.function != "count":
        raise Refused(f"{a.function} needs a column")
    column = F.lit(1) if a.column is None else _column(a.column)
    if weight is None or a.function in ("min", "max", "count_distinct", "approx_count_distinct"):
        out = AGGREGATES[a.function](column)
    else:
        present = F.sum(F.when(column.isNotNull(), weight))
        out = {
            "count": F.coalesce(present, F.lit(0)),
            "sum": F.sum(column * weight),
            "avg": F.sum(column * weight) / present,
        }[a.function]
    return out.alias(a.alias)


def _names(refs: Sequence[Ref]) -> set[str]:
    names = [r.column if isinstance(r, JsonField) else r for r in refs]
    return {n.removeprefix("l.").removeprefix("r.") for n in names}


def _given_out(request: Request) -> set[str]:
    """Columns that outputs, aggregates and the join look at."""
    return _names([*request.columns.values(), *(a.column for a in request.aggregates if a.column is not None),
                   *(c for pair in request.join_on for c in pair)])


def _mentioned(request: Request) -> set[str]:
    """All columns that have to be read."""
    own = _names([f.column for source in _sources(request) for f in source.filters])
    days = {"day"} if any(s.first is not None for s in _sources(request)) else set()
    return _given_out(request) | own | days


def result_kb(result: DataFrame) -> float:
    """Size of a limited result as text, added up by Spark and not on the driver."""
    # NULL fields are written out, so a wide result of NULLs has a size too
    as_json = F.to_json(F.struct("*"), {"ignoreNullFields": "false"})
    return (result.agg(F.sum(F.length(as_json)).alias("n")).first()["n"] or 0) / 1000


def audit(reader: GovernedReader, requests: Sequence[Request]) -> DataFrame:
    """What became of each request: tried, verdict, note, mb and the number of rows given."""
    outcome = []
    for r in requests:
        answer = reader.run(r)
        rows = answer.df.count() if answer.df is not None else 0
        outcome.append((r.label, answer.status, answer.note, round(answer.mb_scanned, 2), rows))
    return reader.spark.createDataFrame(
        outcome, "tried string, verdict string, note string, mb double, row_count bigint")
