"""Composed curation jobs with presets, and the registry of checked queries."""


def registered():
    """All registered queries: ``name -> (fn(spark, sf_dir), oracle_sql or None)``."""
    from . import curation_checks  # noqa: F401  (registers on import)
    for mod in ("split_checks", "slice_checks", "grid_checks", "score_checks", "thin_checks",
                "registry_checks", "train_checks", "store_checks", "jobs_checks", "operator_checks", "whole_checks"):
        try:
            __import__(f"{__name__}.{mod}")
        except ModuleNotFoundError as e:
            if e.name != f"{__name__}.{mod}":
                raise
    from .checks import QUERIES
    return dict(QUERIES)
