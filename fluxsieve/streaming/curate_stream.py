"""Row-wise curation on a streaming DataFrame.

The reference has no streaming runtime.  Every row-local step of the curation
(ratio targets, sanity chain without stored filters, regime, stability and
ratio-bound masks) has no batch-only part, so the same functions apply to a
``readStream`` source unchanged: new point files dropped into a folder are
curated incrementally and appended to a Parquet sink, with the checkpoint in the
shared checkpoint folder (exactly-once file sink).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import derive, filters, masks
from ..plans.jobs import PRESET_9D, JobPreset


def curate_rows(points: DataFrame, preset: JobPreset = PRESET_9D) -> DataFrame:
    """The row-local part of the curation (works on batch and streaming DataFrames)."""
    d = derive.divsum(points, list(preset.divnames), skip_missing=True)
    s = preset.sanity
    d = filters.sanity_chain(s.septot_factor, s.ambi_bound, s.femto_bound, cke_bound=s.cke_bound,
                             cki_bound=s.cki_bound, ambipolar_version=s.ambipolar_version).apply(d)
    if preset.regime is not None:
        d = filters.regime_filter(d, *preset.regime)
    return masks.div_bounds_mask(masks.stability_mask(d), preset.div_bounds)


def start(spark: SparkSession, source_dir: str, sink_dir: str, checkpoint_dir: str, schema,
          preset: JobPreset = PRESET_9D, available_now: bool = False, max_files_per_trigger: int = 64):
    """Curate point files arriving in ``source_dir`` into ``sink_dir`` (Parquet, append)."""
    src = (spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger)
           .parquet(source_dir))
    out = curate_rows(src, preset)
    w = out.writeStream.format("parquet").option("path", sink_dir).option("checkpointLocation", checkpoint_dir) \
        .outputMode("append")
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()
