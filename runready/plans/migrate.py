"""Take over from an existing deployment: seed state version 0 from its files.

The previous system kept its state as a CSV with a header (pipeline, source, lock, status,
times) and its high-water mark as one integer in a text file.  Importing both as version 0
lets the first pass continue incrementally instead of starting with a full load.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..operators import state
from ..sources import readers


def import_previous_state(spark: SparkSession, state_csv: str, checkpoint_txt: str | None, state_root: str) -> int | None:
    """Write the imported state (and high-water mark, when readable) as version 0; returns the mark."""
    hwm = readers.read_checkpoint_text(spark, checkpoint_txt) if checkpoint_txt else None
    state.write_state(state.import_state_csv(spark, state_csv), state_root, 0, hwm_ms=hwm)
    return hwm
