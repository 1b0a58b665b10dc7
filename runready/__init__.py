"""runready — a Spark-native engine that decides which data pipelines are ready to run.

Inputs are tables: job definitions (schedule, zone, fiscal rule, upstream dependencies,
failure policy), run logs, an external run feed, a fiscal calendar and the previous
state table.  Everything is DataFrame/SQL; see ``runready.operators`` for the
operators and ``runready.plans.readiness_pass`` for the composed pass.

Main entry points (imported lazily, so importing the package needs no Spark session)::

    from runready import configure, readiness_pass, readiness_stream, decide_at
"""

__version__ = "0.1.0"

_EXPORTS = {
    "configure": ("runready.session", "configure"),
    "get_spark": ("runready.session", "get_spark"),
    "readiness_pass": ("runready.plans.readiness_pass", "readiness_pass"),
    "decide": ("runready.plans.readiness_pass", "decide"),
    "decide_at": ("runready.plans.readiness_pass", "decide_at"),
    "readiness_stream": ("runready.streaming.stream", "readiness_stream"),
    "import_previous_state": ("runready.plans.migrate", "import_previous_state"),
}


def __getattr__(name):
    if name in _EXPORTS:
        import importlib
        module, attr = _EXPORTS[name]
        return getattr(importlib.import_module(module), attr)
    raise AttributeError(name)


__all__ = sorted(_EXPORTS)
