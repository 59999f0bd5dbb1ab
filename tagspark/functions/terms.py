"""Fixed values of the data contract. Results are compared on these strings and numbers."""

CELL = ["sampleId", "cellId"]
ANY_SAMPLE = "*"

# states
BOUND = "bound"
NOT_BOUND = "not bound"
UNRELIABLE = "unreliable"
NEVER_ASKED = "never asked"
SETTLED = [BOUND, NOT_BOUND]

# why one cell's reading is unreliable
GATED = "cell set aside by the sticky cell limit"
NO_COMPARATOR = "no comparator for this cell"

# why a set's reading is unreliable, or was never asked
NEVER_OFFERED = "never-offered"
SET_NO_COMPARATOR = "no-comparator"
ALL_CELLS_GATED = "all-cells-gated"
TIE = "tie"
BELOW_AGREEMENT = "below-agreement-floor"
TOO_FEW_VOTERS = "too-few-voters"

# quality statuses
OK = "OK"
WARN = "warn"
ALERT = "alert"

# defaults and limits
FLOOR = 4
CUTOFF = 75.0
BETA_X = 0.925
BETA_A = 1
BETA_B = 3
PANEL_MIN_MEMBERS = 25
BOUND_PROBABILITY = 0.9
MIN_VOTERS = 1
FIT_MIN_CELLS = 300
FIT_INITIAL_WEIGHT = 0.1
FIT_TRIM_PERCENTILE = 99.0
UNDECLARED_KEPT = 1000
IDENTITY_PIVOT_LIMIT = 10_000
TAG_MEDIAN_LIMIT = 2_000
CELL_PUNCH_LIMIT = 2_000_000
AGGREGATE_IQR = 3.0
AGGREGATE_MIN_UMI = 1000.0
AGGREGATE_TOP = 100
LOG1P_WIDTH = 0.2
LINEAR_BINS = 24

GROUPING_SEPARATOR = " | "
REFERENCE_LABEL = "background control"

FIT_TOO_FEW = "the sample holds too few cells for a distribution to be fitted"
FIT_NONE = "no two-component fit could be computed for this tag"
