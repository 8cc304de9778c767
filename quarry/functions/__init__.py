"""Column-level building blocks: fixed token lists, lenient parsers, formats, formulas."""
