"""Values that must equal the original analysis for the results to match.

Code elsewhere uses these as defaults and does not repeat the literals.
"""

# Fixed values of the original analysis (builds, horizon, report choices,
# thresholds, names and formats), in the order the analysis uses them.
BASE_BUILD = "10.2"
CANDIDATE_BUILD = "11.0"
PATCH_BUILD = "11.0.1"
HORIZON_DAYS = 7
HEADLINE_DAYS = (1, 3, 7)
MONTH_FORMAT = "yyyy-MM"
NAIVE_READ = "naive_censored (do not ship)"
GATED_READ = "maturity_gate (full history)"
MIX_DIMENSIONS = (("country", "s_country"),
                  ("network", "s_acquisition_network"),
                  ("package", "s_installing_pckg_group"))
BREAK_LEVEL = 7
TIME_LEVELS = (6, 7, 8)
REACH_LEVELS = (1, 7, 8, 15, 20)
EARLY_LEVELS = (1, 6)
LATE_LEVELS = (8, 24)
TAIL_FROM_LEVEL = 25
SECOND_BREAK_LEVEL = 23
REPORT_MAX_LEVEL = 24
THIN_LEVEL_STARTS = 400
SLICE_COUNTRY = "US"
SECONDS_PER_DAY = 86400.0
LEVEL_TIME_TOLERANCE = 1.001
