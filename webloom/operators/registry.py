"""Fetchers and their registry: the first fetcher whose predicate holds takes the row."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce
from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.functions import errors
from webloom.functions import url as U
from webloom.operators import fetch as respond
from webloom.operators import guard, repository
from webloom.options import FetchOptions


class Fetcher(Protocol):
    """A plug-in: a predicate on the URL, and rows of captures to rows of results (keeping all other columns).

    One that also has ``fields(captures, options, active, known)``, which gives the captures with helper columns and a
    column for each result field, shares a single pass over the captures with all others that have it. ``known`` are the
    parts of the row's URL (see ``functions.url.parts``); ``matches`` of such a one gets them too.

    One that has ``answer(captures, options)`` instead, Arrow rows of captures to as many rows of result fields in the same
    order, shares that pass as well: all of them are called, each with its own rows, by one function over the batches.
    """

    name: str

    def matches(self, url: Column) -> Column: ...

    def fetch(self, captures: DataFrame, options: FetchOptions) -> DataFrame: ...


class DefaultFetcher:
    name = "default"

    def matches(self, url: Column, known: Column | None = None) -> Column:
        return F.lit(True)

    def fetch(self, captures: DataFrame, options: FetchOptions) -> DataFrame:
        return respond.default_response(captures, options)

    def fields(self, captures: DataFrame, options: FetchOptions, active: Column, known: Column | None = None) -> respond.Fields:
        return respond.default_fields(captures, options, active, known)


class RepositoryFetcher:
    """Pages of repositories: the capture holds repo_status, repo_json, readme_status and readme_json."""

    name = "github_repo"

    def matches(self, url: Column, known: Column | None = None) -> Column:
        return U.repository(url, known).isNotNull()

    def fetch(self, captures: DataFrame, options: FetchOptions) -> DataFrame:
        return repository.repository_response(captures)

    def fields(self, captures: DataFrame, options: FetchOptions, active: Column, known: Column | None = None) -> respond.Fields:
        return repository.repository_fields(captures, active, known)


def _answers(called: dict[str, Fetcher], options: FetchOptions, capture: str, by: str):
    """Fills in the results of the plug-ins in ``called``: of each batch every plug-in gets its own rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(by)
            made = pa.table([c for n, c in zip(batch.schema.names, batch.columns) if n not in (capture, by)], names=[n for n in batch.schema.names if n not in (capture, by)])
            for name, plugin in called.items():
                at = pc.indices_nonzero(pc.fill_null(pc.equal(names, name), False)).to_numpy()
                if len(at):
                    found = plugin.answer(pa.RecordBatch.from_struct_array(batch.column(capture).take(pa.array(at))), options)
                    place = np.full(batch.num_rows, -1, np.int64)
                    place[at] = np.arange(len(at))
                    where = pa.array(place, mask=place < 0)
                    for field in respond.RESULT_FIELDS:
                        if field in found.schema.names:
                            k = made.schema.get_field_index(field)
                            given = pc.take(found.column(field).cast(made.schema.field(k).type), where)
                            made = made.set_column(k, made.schema.field(k), pc.if_else(pa.array(place >= 0), given, made.column(k).combine_chunks()))
            yield from made.to_batches()

    return run


@dataclass
class FetcherRegistry:
    fetchers: list[Fetcher] = field(default_factory=list)

    @staticmethod
    def with_defaults() -> FetcherRegistry:
        return FetcherRegistry([RepositoryFetcher(), DefaultFetcher()])

    def register(self, fetcher: Fetcher) -> FetcherRegistry:
        self.fetchers.append(fetcher)
        return self

    def route(self, url: Column, known: Column | None = None) -> Column:
        """Name of the first fetcher that matches, else null."""
        holds = lambda f: f.matches(url, known) if known is not None and hasattr(f, "fields") else f.matches(url)
        return reduce(lambda c, f: c.when(holds(f), f.name), self.fetchers, F.when(F.lit(False), ""))

    def fetch(self, captures: DataFrame, options: FetchOptions = FetchOptions(), missing: bool = False) -> DataFrame:
        """Results of captures, with error_kind and error_message beside the fields of RESPONSE_SCHEMA.

        Rows that fail a check, or that no fetcher takes, have an error and nothing else but their URL. A fetcher's
        failure doesn't fall back to another fetcher.
        """
        url, p = F.col("url"), respond.spare(captures.columns)
        known = F.col(f"{p}parts")
        checked = captures.withColumn(f"{p}parts", U.parts(url))
        checked = checked.withColumn(f"{p}check", F.coalesce(guard.error_kind(url, options, missing, known), errors.method_kind(F.col("method"))))
        checked = checked.withColumn(f"{p}route", F.when(F.col(f"{p}check").isNull(), self.route(url, known)))
        route = F.coalesce(F.col(f"{p}route"), F.lit(""))
        apart = [f for f in self.fetchers if not hasattr(f, "fields") and not hasattr(f, "answer")]
        called = {f.name: f for f in self.fetchers if hasattr(f, "answer")}
        step = checked.where(~route.isin(*[f.name for f in apart])) if apart else checked
        made = [(F.lit(True), respond.failure_fields(F.coalesce(F.col(f"{p}check"), F.when(route == "", "FetcherError")), F.lit("No fetcher available for URL")))]
        for f in self.fetchers:
            if f not in apart and f.name not in called:
                step, fields = f.fields(step, options, route == f.name, known)
                made.append((route == f.name, fields))
        fields = {}
        for name in respond.RESULT_FIELDS:
            cases = [(active, given[name]) for active, given in reversed(made) if name in given]
            fields[name] = reduce(lambda c, x: c.when(*x), cases[1:], F.when(*cases[0])) if cases else F.lit(None)
        if called:
            rows = F.when(route.isin(*called), F.struct(*[F.col(c) for c in captures.columns]))
            step = step.withColumns({f"{p}capture": rows, f"{p}by": F.when(route.isin(*called), route)})
            told = respond.result(step, fields, [*captures.columns, f"{p}capture", f"{p}by"])
            out = told.mapInArrow(_answers(called, options, f"{p}capture", f"{p}by"), told.drop(f"{p}capture", f"{p}by").schema)
        else:
            out = respond.result(step, fields, captures.columns)
        parts = [f.fetch(checked.where(route == f.name).drop(f"{p}check", f"{p}route", f"{p}parts"), options) for f in apart]
        return reduce(lambda a, b: a.unionByName(b), parts, out)
