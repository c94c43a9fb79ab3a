"""Thresholds, word lists and text formats that results depend on."""

# Cleaning thresholds.
SPARSE_COLUMN_RATIO = 0.4
DATETIME_PARSE_RATIO = 0.5
IQR_FACTOR = 1.5
FLOAT32_TOLERANCE = 5e-4
MIN_ROWS_AFTER_CLEANING = 2

# Text cells that mean "missing" once lower-cased and trimmed.
NULL_TOKENS = ["?", "nan", "none", ""]
NULL_TOKENS_WITHOUT_NONE = ["?", "nan", ""]

# CSV cells that mean "missing", as they are written.
CSV_NULLS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]

# How a number is written in text.
NUMBER_FORM = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"

# Date formats tried on text columns, in this order; the first is the engine's own ISO reading.
DATE_FORMATS = ["ISO", "M/d/yyyy", "d/M/yyyy", "yyyy/M/d", "d-M-yyyy", "d.M.yyyy", "d MMM yyyy", "MMM d yyyy", "MMM d, yyyy", "d MMMM yyyy", "MMMM d yyyy", "MMMM d, yyyy",
                "M/d/yyyy H:mm", "M/d/yyyy H:mm:ss", "d/M/yyyy H:mm", "d/M/yyyy H:mm:ss", "yyyy/M/d H:mm:ss"]

# Names of the ten cleaning steps.
CLEANING_STEPS = [
    "Normalize Column Names",
    "Remove Duplicate Rows",
    "Handle Missing Values (Time-series Bfill)",
    "Fix Data Types",
    "Clean Text Columns",
    "Handle Infinite Values",
    "Remove Constant Columns",
    "Remove Identifier Columns",
    "Outlier Removal (IQR)",
    "Downcast Numeric Types & Reset Index",
]

# Column roles.
ROLES = ["numerical", "categorical", "datetime", "text", "identifier"]
IDENTIFIER_MIN_ROWS = 10
CATEGORICAL_MAX_DISTINCT = 10
CATEGORICAL_MIN_ROWS = 50
TEXT_MEAN_LENGTH = 50
CATEGORICAL_RATIO = 0.05

# Quality rules.
MISSING_WARNING_PCT = 50
DUPLICATE_WARNING_PCT = 5
NON_NEGATIVE_COLUMNS = ["age", "height", "weight"]
HIGH_CARDINALITY = 50

# Statistics and insights.
ZSCORE_LIMIT = 3.0
STRONG_CORRELATION = 0.7
VERY_STRONG_CORRELATION = 0.8
SKEW_LIMIT = 1.0
TOP_VALUES = 10
TOP_CORRELATIONS = 3

# Words that keep a numeric column out of feature engineering.
FEATURE_EXCLUDE_WORDS = ["anomaly", "label", "target", "id", "index", "_hour", "_day", "_month", "_weekday"]
DATE_NAME_WORDS = ["date", "time", "timestamp"]
FEATURE_GROUPS = ["rolling_mean", "rolling_std", "lag", "diff", "rate_of_change", "zscore", "date_"]

# Modelling defaults.
SEED = 42
TEST_SHARE = 0.2
BASELINE_MIN_ROWS = 10
BASELINE_TREES = 100
ENSEMBLE_ROUNDS = 150
TREE_DEPTH = 8
LOGISTIC_ITERATIONS = 1000
NEIGHBOURS = 5
FOREST_TREES = 200
FOREST_SAMPLE = 256
CONTAMINATION = 0.08
BOUNDED_SAMPLE_ROWS = 2000
CV_FOLDS = 5
TUNING_FOLDS = 3
METRIC_DIGITS = 4

# File extensions and the reader each one uses.
FORMATS = {
    ".csv": "csv",
    ".xlsx": "xlsx",
    ".json": "json",
    ".parquet": "parquet",
}

# Report sentences: fixed values, as results hold them word for word.
SAYS_SIZE = "Dataset contains {rows} rows and {columns} columns"
SAYS_MISSING = "Dataset has {share:.1f}% missing values overall"
SAYS_KINDS = "Found {numerical} numerical and {categorical} categorical columns"
SAYS_SKEW = "Column '{column}' is highly {side}-skewed (skewness: {skew:.2f})"
SAYS_CORRELATION = "{strength} {direction} correlation ({r:.2f}) between '{x}' and '{y}'"
SAYS_OUTLIERS = "Column '{column}' has {count} outliers ({share:.1f}%)"
SAYS_BINARY = "Column '{column}' is binary with values: {values}"
ADVISES_LOG = "Consider log transformation for right-skewed '{column}'"
ADVISES_SQUARE = "Consider square transformation for left-skewed '{column}'"
ADVISES_ONE_HOT = "Consider one-hot encoding for categorical columns: {columns}"
ADVISES_DATES = "Extract features from datetime columns: {columns}"
ADVISES_SCALING = "Consider standardizing numerical features for ML models"
