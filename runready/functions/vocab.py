"""Fixed values.

These literals must equal the ones the reference's rules compare against; they
are stated here plainly, in natural order, in one place.
"""

# Terminal life-cycle states of a platform run.
TERMINAL_LIFE_CYCLE_STATES = ["TERMINATED", "SKIPPED", "INTERNAL_ERROR", "BLOCKED"]

# Terminal states of a data-factory pipeline run.
FACTORY_TERMINAL_STATES = ["Succeeded", "Failed", "Cancelled"]

# Status literals read by the rules.
STATUS_RUNNING = "RUNNING"
STATUS_FAILED = "FAILED"
STATUS_SUCCESS = "SUCCESS"
FACTORY_FAILED = "Failed"

# The only definition state that can become ready.
STATE_ACTIVE = "active"

# Fiscal gate tag values ("None" = no fiscal gate).
SPEC_NONE = "None"
SPEC_PERIOD_DAY1 = "fy_per_d1"
SPEC_PERIOD_FIRST_MONDAY = "fy_per_1st_monday"
SPEC_QUARTER_DAY1 = "fy_qtr_d1"
SPEC_QUARTER_FIRST_MONDAY = "fy_qtr_1st_monday"

# Failure policy tag values.
ONFAIL_HOLD = "hold"
ONFAIL_PASS = "pass"

# Defaults filled into missing tags.
DEFAULT_CRON = "* * * * *"
DEFAULT_TZ = "UTC"
DEFAULT_SPEC = "None"
DEFAULT_ONFAIL = "hold"

# Zone of the fiscal calendar and of every job with a fiscal gate.
FISCAL_TZ = "US/Eastern"

# Fiscal day-of-period / day-of-quarter that marks the "first Monday".
FISCAL_FIRST_MONDAY_DAY = 3

# Job id given to every run from the external feed.
EXTERNAL_JOB_ID = 99999999999999

# Source name of runs read from the platform's own run log.
PLATFORM_SOURCE = "azure_databricks"

# Decision-log retention, in milliseconds (30 days).
LOG_RETENTION_MS = 2592000000

# Invocation job types (compared case-insensitively).
JOB_TYPE_FACTORY = "adf"
JOB_TYPE_PLATFORM = "db"

# Cron month and weekday names, in calendar order.
MONTH_NAMES = ["JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC"]
WEEKDAY_NAMES = ["SUN", "MON", "TUE", "WED", "THU", "FRI", "SAT"]
