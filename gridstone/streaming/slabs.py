"""Append slabs of new time steps to a store, from a stream of cells."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gridstone.plans.spec import ArraySpec
from gridstone.sources import store as st


def append(store_folder: str, spec: ArraySpec, cells: DataFrame) -> ArraySpec:
    """Write whole slabs of chunks behind (or over) those that a store has, and return its new layout.

    spec: the layout so far; its folder_chunks must be the chunks of whole slabs, so that a slab
    has its folders for itself: writing it again replaces it, and no other slab is touched.
    Cells of a slab that lacks some raise, and the layout stays.
    """
    across = spec.grid[1] * spec.grid[2]
    if not spec.folder_chunks or spec.folder_chunks != across:
        raise ValueError("folder_chunks must be the chunks of one slab")
    spark, step = cells.sparkSession, spec.chunk[0]
    slabs = sorted(r[0] for r in cells.select(F.floor(F.col("t") / step).cast("int")).distinct().collect())  # a row for each slab of the batch
    if not slabs:
        return spec
    steps = max(spec.shape[0] if st.exists(spark, f"{store_folder}/array") else 0, (slabs[-1] + 1) * step)
    grown = replace(spec, shape=(steps, *spec.shape[1:]))
    st._write(st.payload_rows(cells, grown), f"{store_folder}/payload", **st.FILE_OPTIONS)
    st.write_zone_map(spark, grown, store_folder, F.col("part").isin(slabs))
    spark.createDataFrame([(grown.to_json(),)], "spec string").coalesce(1).write.mode("overwrite").text(f"{store_folder}/array")
    return grown


def follow(cells: DataFrame, store_folder: str, spec: ArraySpec, checkpoint: str) -> StreamingQuery:
    """A running query that appends each micro-batch of a stream of cells (t, y, x, v), which must hold whole slabs.

    A batch that is run again after a failure writes the same folders once more.
    """

    def write(batch: DataFrame, _: int) -> None:
        kept = batch.persist()
        try:
            now = st.open_store(batch.sparkSession, store_folder).spec if st.exists(batch.sparkSession, f"{store_folder}/array") else spec
            append(store_folder, now, kept)
        finally:
            kept.unpersist()

    return cells.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
