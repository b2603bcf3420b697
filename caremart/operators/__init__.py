"""DataFrame operators: enrichment, reports, joins, parameterised queries,
slowly-changing dimensions and data-quality checks."""
