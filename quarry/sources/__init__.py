"""Sources and sinks: delimited text in; Parquet, CSV and JSON specs out and back."""
