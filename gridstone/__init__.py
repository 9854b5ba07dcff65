"""Block-skipping analytics over dense numeric arrays, on Spark DataFrames, and operators for training data."""

#: Where each public name lives; modules are imported when a name is asked for, so that workers load what they need.
_HOMES = {
    "gridstone.api": ("aggregate_gt", "aggregate_lt", "aggregate_range", "query_gt", "query_gt_async", "query_lt", "query_lt_async", "query_range", "query_range_async"),
    "gridstone.plans.options": ("QueryOptions",),
    "gridstone.plans.spec": ("ArraySpec",),
    "gridstone.sources.store": ("Store", "check_meta", "create", "open_store"),
}
__all__ = sorted(name for names in _HOMES.values() for name in names)


def __getattr__(name: str):
    from importlib import import_module

    for home, names in _HOMES.items():
        if name in names:
            return getattr(import_module(home), name)
    raise AttributeError(name)
