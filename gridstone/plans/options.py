"""Knobs that queries take; most have no meaning beyond their checks, since Spark schedules reads itself."""

from __future__ import annotations

from dataclasses import dataclass, fields

#: The least value of each number.
LEAST = {"threads": 0, "request_concurrency": 1, "request_batch_size": 1, "merge_gap_blocks": 0, "max_chunk_requests": 1, "max_inflight_bytes": 1}


@dataclass(frozen=True)
class QueryOptions:
    """How a query reads; none of them changes its answer, but for layer.

    layer: the precision to read, None for the full rate. merge_gap_blocks and
    max_chunk_requests: how reads are merged in the accounting. max_inflight_bytes: payload
    bytes that a task decodes at once. trace: adds planning_seconds. threads,
    request_concurrency, request_batch_size, pipeline, zero_copy and meta_by_key are checked
    and have no further effect: Spark's task slots and Parquet's reader do this.
    """

    threads: int = 0
    request_concurrency: int = 32
    request_batch_size: int | None = None
    merge_gap_blocks: int | None = None
    layer: int | None = None
    max_chunk_requests: int = 1
    pipeline: bool = True
    zero_copy: bool = True
    max_inflight_bytes: int | None = None
    meta_by_key: bool = True
    trace: bool = False

    def __post_init__(self) -> None:
        for f in fields(self):
            value, least = getattr(self, f.name), LEAST.get(f.name)
            if least is not None and value is not None and value < least:
                raise ValueError(f"{f.name} must be " + ("greater than 0" if least else "non-negative"))

    def layer_of(self, spec) -> int:
        """The layer to read of an array."""
        layer = spec.top if self.layer is None else self.layer
        if not 0 <= layer <= spec.top:
            raise ValueError(f"layer must be between 0 and {spec.top}")
        if self.max_inflight_bytes is not None and layer:
            raise ValueError("max_inflight_bytes needs layer 0")
        return layer
