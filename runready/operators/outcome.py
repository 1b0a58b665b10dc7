"""O19 classify_outcome: is a started run finished, and did it fail?

Two run systems report states in different words:

* platform jobs (``db``): finished when the life-cycle state is terminal; failed when
  finished and the result is anything but SUCCESS (a missing result counts as failed);
* data-factory pipelines (``adf``): finished on Succeeded, Failed or Cancelled; failed only
  on Failed (a cancelled pipeline is not a failure).

The system name is compared case-insensitively; an unknown system gives nulls.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vocab


def classify_outcome(runs: DataFrame, system_col: str = "system", state_col: str = "state",
                     result_col: str = "result") -> DataFrame:
    system = F.lower(F.col(system_col))
    state, result = F.col(state_col), F.col(result_col)
    db_terminal = F.coalesce(state.isin(*vocab.TERMINAL_LIFE_CYCLE_STATES), F.lit(False))
    adf_terminal = F.coalesce(state.isin(*vocab.FACTORY_TERMINAL_STATES), F.lit(False))
    terminal = (F.when(system == vocab.JOB_TYPE_PLATFORM, db_terminal)
                .when(system == vocab.JOB_TYPE_FACTORY, adf_terminal))
    failed = (F.when(system == vocab.JOB_TYPE_PLATFORM,
                     db_terminal & F.coalesce(result != F.lit(vocab.STATUS_SUCCESS), F.lit(True)))
              .when(system == vocab.JOB_TYPE_FACTORY, F.coalesce(state == F.lit(vocab.FACTORY_FAILED), F.lit(False))))
    return runs.withColumns({"terminal": terminal, "failed": failed})
