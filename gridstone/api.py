"""The calls that users make: threshold and range queries over a store or its folder, answered as one row."""

from __future__ import annotations

import asyncio
from collections.abc import Callable

from pyspark.sql import DataFrame, Row, SparkSession

from gridstone.functions.bounds import range_bounds
from gridstone.operators import query
from gridstone.plans.options import QueryOptions
from gridstone.sources.store import Store, open_store

Source = str | Store


def _opened(source: Source, array_path: str, storage_options: dict[str, str] | None) -> Store:
    return open_store(SparkSession.active(), source, array_path, storage_options)


def _between(lo: float, hi: float, lo_inclusive: bool, hi_inclusive: bool) -> tuple[float, float]:
    if lo is None or hi is None:
        raise TypeError("a range needs both bounds")
    return range_bounds(lo, hi, lo_inclusive, hi_inclusive)


def _answer(store: Store, lo: float, hi: float, options: QueryOptions | None) -> Row:
    """The count with its accounting; see operators/query.py."""
    options = options or QueryOptions()
    return query.count(store, lo, hi, options).crossJoin(query.accounting(store, lo, hi, options)).first()  # one row each


def _aggregated(store: Store, lo: float, hi: float, options: QueryOptions | None, return_blocks: bool) -> Row | tuple[Row, DataFrame]:
    options = options or QueryOptions()
    found = query.aggregate(store, lo, hi, options, return_blocks)
    row = (found[0] if return_blocks else found).crossJoin(query.accounting(store, lo, hi, options, inside=True)).first()  # one row each
    return (row, found[1]) if return_blocks else row


def query_gt(source: Source, threshold: float, *, inclusive: bool = False, array_path: str = "", storage_options: dict[str, str] | None = None, options: QueryOptions | None = None) -> Row:
    """How many decoded values are above (or at) a threshold."""
    return _answer(_opened(source, array_path, storage_options), *range_bounds(threshold, None, inclusive), options)


def query_lt(source: Source, threshold: float, *, inclusive: bool = False, array_path: str = "", storage_options: dict[str, str] | None = None, options: QueryOptions | None = None) -> Row:
    """How many decoded values are below (or at) a threshold."""
    return _answer(_opened(source, array_path, storage_options), *range_bounds(None, threshold, hi_inclusive=inclusive), options)


def query_range(source: Source, lo: float, hi: float, *, lo_inclusive: bool = False, hi_inclusive: bool = True, array_path: str = "", storage_options: dict[str, str] | None = None, options: QueryOptions | None = None) -> Row:
    """How many decoded values lie between two bounds."""
    bounds = _between(lo, hi, lo_inclusive, hi_inclusive)
    return _answer(_opened(source, array_path, storage_options), *bounds, options)


def aggregate_gt(source: Source, threshold: float, *, inclusive: bool = False, array_path: str = "", storage_options: dict[str, str] | None = None, options: QueryOptions | None = None, return_blocks: bool = False) -> Row | tuple[Row, DataFrame]:
    """COUNT, SUM and AVG of decoded values above (or at) a threshold, and intervals of the originals'; with return_blocks also the blocks read."""
    return _aggregated(_opened(source, array_path, storage_options), *range_bounds(threshold, None, inclusive), options, return_blocks)


def aggregate_lt(source: Source, threshold: float, *, inclusive: bool = False, array_path: str = "", storage_options: dict[str, str] | None = None, options: QueryOptions | None = None, return_blocks: bool = False) -> Row | tuple[Row, DataFrame]:
    """The same of values below (or at) a threshold."""
    return _aggregated(_opened(source, array_path, storage_options), *range_bounds(None, threshold, hi_inclusive=inclusive), options, return_blocks)


def aggregate_range(source: Source, lo: float, hi: float, *, lo_inclusive: bool = False, hi_inclusive: bool = True, array_path: str = "", storage_options: dict[str, str] | None = None, options: QueryOptions | None = None, return_blocks: bool = False) -> Row | tuple[Row, DataFrame]:
    """The same of values between two bounds."""
    bounds = _between(lo, hi, lo_inclusive, hi_inclusive)
    return _aggregated(_opened(source, array_path, storage_options), *bounds, options, return_blocks)


async def _later(run: Callable[..., Row], source: Store, *args: float, **more: object) -> Row:
    if not isinstance(source, Store):
        raise TypeError("an asynchronous query needs an opened array")
    return await asyncio.to_thread(run, source, *args, **more)


async def query_gt_async(source: Store, threshold: float, *, inclusive: bool = False, options: QueryOptions | None = None) -> Row:
    """query_gt() of an opened array, beside other work of the event loop."""
    return await _later(query_gt, source, threshold, inclusive=inclusive, options=options)


async def query_lt_async(source: Store, threshold: float, *, inclusive: bool = False, options: QueryOptions | None = None) -> Row:
    """query_lt() of an opened array, beside other work of the event loop."""
    return await _later(query_lt, source, threshold, inclusive=inclusive, options=options)


async def query_range_async(source: Store, lo: float, hi: float, *, lo_inclusive: bool = False, hi_inclusive: bool = True, options: QueryOptions | None = None) -> Row:
    """query_range() of an opened array, beside other work of the event loop."""
    return await _later(query_range, source, lo, hi, lo_inclusive=lo_inclusive, hi_inclusive=hi_inclusive, options=options)
