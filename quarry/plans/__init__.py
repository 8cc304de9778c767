"""Dashboard plans: schema, rule-based recommendation, execution."""
