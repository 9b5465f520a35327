"""cohortlens: is a new release healthier than the one it replaces?

Reports over two tables of pre-aggregated cohort cells (activity and
progression), built from Spark DataFrame operations only.  Typical use::

    from cohortlens import CohortSpec, read_activity, read_progression, run_analysis
    act = read_activity(spark, "…/activity")
    prog = read_progression(spark, "…/progression")
    run_analysis(spark, act, prog, "…/out", CohortSpec(base="10.2", cand="11.0"))

Individual reports live in ``cohortlens.operators`` (window, integrity,
labels, retention, mix, funnel, engagement, charts).
"""

from cohortlens.operators.window import AnalysisWindow, WindowError, derive_window
from cohortlens.plans.analysis import AnalysisParams, prepare, run_analysis
from cohortlens.sources.cells import read_activity, read_progression, register, write_cells
from cohortlens.spec import CohortSpec

__all__ = [
    "AnalysisParams", "AnalysisWindow", "CohortSpec", "WindowError", "derive_window",
    "prepare", "read_activity", "read_progression", "register", "run_analysis", "write_cells",
]
