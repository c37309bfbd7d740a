"""DataFrame -> DataFrame operators (cleaning, sequences, entities, joins,
aggregates, ranking, report rendering, model calls)."""
