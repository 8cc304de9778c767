"""Values that must equal the reference's for equal results.

Fixed values, kept as plain text in their natural order.
"""

# Strings read as missing (the pandas read_csv default NA list).
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
    "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

# Words that make a column boolean (compared lowercased and trimmed).
BOOLEAN_WORDS = ["true", "false", "t", "f", "yes", "no", "y", "n", "1", "0"]

# Candidate delimiters, in the reference's order.
DELIMITERS = [",", "\t", ";", "|"]

# Fallback names when a column is not found (target -> substrings to try).
COLUMN_SYNONYMS = {
    "quantity": ["qty", "amount", "count", "volume"],
    "unitprice": ["price", "unit_price", "cost", "rate"],
    "total": ["amount", "sum", "total_amount"],
    "sales": ["revenue", "amount", "total"],
    "revenue": ["sales", "total", "amount"],
}

# Characters removed before a numeric test.
NUMERIC_NOISE = ",$%"

# Text that the display preparation treats as missing.
DISPLAY_NULL_TEXT = ["nan", "None"]

# Name fragments that mark a text column as a date for display.
DATE_NAME_HINTS = ["date", "time", "timestamp"]

# Cardinality classes by distinct count.
CARDINALITY_LOW_MAX = 10
CARDINALITY_MEDIUM_MAX = 100

# Chart and filter kinds.
