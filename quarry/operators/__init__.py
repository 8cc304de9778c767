"""DataFrame operators: cleaning, profiling, derived columns, filters, KPIs and charts."""
