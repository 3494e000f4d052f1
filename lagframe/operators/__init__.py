"""DataFrame operators: filters, joins, deduplication, reshaping, summaries, distributions, rules, model."""
