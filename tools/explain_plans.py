"""Print the final (post-AQE) physical plan of selected reports.

    python tools/explain_plans.py /root/testdata/sf0.1 retention_curve integrity_report ...

Each report is executed once (so adaptive decisions are final), then its
plan is printed with expression ids removed and long lines cut.
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

DEFAULT = ["fixture_progression", "retention_curve", "integrity_report", "mix_balance",
           "level_funnel", "playtime_quirk", "duplicate_prog_keys", "missing_cohort_days"]


def clean(plan: str, width: int = 150) -> str:
    out = []
    for line in plan.splitlines():
        line = re.sub(r"#\d+L?", "", line)
        line = re.sub(r", \[plan_id=\d+\]", "", line)
        line = re.sub(r"Location: InMemoryFileIndex\([^)]*\)\[[^\]]*\]", "Location: …", line)
        out.append(line if len(line) <= width else line[: width - 1] + "…")
    return "\n".join(out)


def main(argv: list[str]) -> None:
    from cohortlens.plans import catalog
    from cohortlens.session import local_session

    sf_dir = argv[0] if argv else "/root/testdata/sf0.1"
    names = argv[1:] or DEFAULT
    spark = local_session(8, 16)
    spark.conf.set("spark.sql.maxMetadataStringLength", "100")
    if "fixture_activity" in names or "fixture_progression" in names:
        from cohortlens.sources import fixture

        lazy = dict(zip(("fixture_activity", "fixture_progression"),
                        fixture.fixture_frames(spark, sf_dir)))
    for name in names:
        df = lazy[name] if name.startswith("fixture_") else catalog.queries()[name](spark, sf_dir)
        df._jdf.queryExecution().toRdd().count()   # run this plan, so AQE is final
        plan = spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "simple")
        final = plan.split("+- == Initial Plan ==")[0]
        print(f"### {name}\n\n```\n{clean(final)}\n```\n")


if __name__ == "__main__":
    main(sys.argv[1:])
