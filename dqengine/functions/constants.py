"""Fixed values that must equal the reference's so results agree.

All thresholds are stated once here, in the order the reference lists them,
and every operator reads them from this module.
"""

# --- fixed values: profiling thresholds -----------------------------------
MISSING_DROP_THRESH = 0.60      # drop a column if its null ratio is > this
HIGH_CARDINALITY_RATIO = 0.95   # flag if unique/rows is > this
CLASS_IMBALANCE_RATIO = 4.0     # flag if majority/minority count is >= this
OUTLIER_IQR_FACTOR = 1.5        # outlier if strictly outside q1/q3 -+ 1.5 iqr
CORR_HIGH_THRESH = 0.85         # flag if |r| >= this
MISSING_WARN_THRESH = 0.05      # flag if 5 % < missing % < 60 %

# --- fixed values: other limits used by the rules -------------------------
CV_LIMIT = 3.0                  # coefficient of variation flag, strict >
OUTLIER_FLAG_PCT = 10.0         # outlier flag, strict >
OUTLIER_REC_PCT = 5.0           # outlier recommendation, strict >
MISSING_REC_PCT = 2.0           # imputation recommendation, strict >
SMALL_DATASET_ROWS = 1_000      # strict <
LARGE_DATASET_ROWS = 500_000    # strict >
MIN_IQR_VALUES = 4              # fewer non-null values -> no outliers
TOP_VALUES = 10                 # top values kept per non-numeric column
TOP_CORRELATIONS = 30           # correlation pairs kept per dataset
TOP_ALGORITHMS = 5              # advisor rows kept per dataset
CLASSIFICATION_MAX_CLASSES = 20 # advisor: categorical column with <= 20 values
REGRESSION_MIN_NUMERIC = 5      # advisor: >= 5 numeric columns -> regression

# --- fixed values: health score deductions (cap, weight) ------------------
SCORE_MISSING = (25.0, 2.0)
SCORE_DUPLICATES = (20.0, 4.0)
SCORE_OUTLIERS = (15.0, 1.5)
SCORE_DROPPED = (20.0, 5.0)
SCORE_FLAGS = (20.0, 4.0)
SCORE_FLOOR = 10

# --- fixed values: file admission and question answering ------------------
ALLOWED_SUFFIXES = (".csv", ".xlsx", ".xls")
MAX_FILE_BYTES = 50 * 1024 * 1024
CSV_INFER_ROWS = 10_000          # the reference looks no further; an option here
REPORT_CONTEXT_CHARS = 12_000
REPORT_CONTEXT_FLOOR = 2_000
CHAT_SOURCES = ("EDA Report",)

# --- fixed values: the sentence a dropped column is reported with ----------
DROP_REASON = ("Dropped: ", "% of values are missing (threshold is 60%). "
               "A column with this much missing data adds noise rather than signal.")

# --- fixed values: catalogue checks ----------------------------------------
DATASET_STATUSES = ("processing", "ready", "failed")
CHAT_ROLES = ("user", "assistant")

# Strings longer than this are grouped by a prefix plus a SHA-256 digest so a
# shuffle never carries whole documents (see functions/keys.py).
LONG_TEXT_CHARS = 64
