"""DataFrame operators: filters, joins, ranking, sets, caches, routing, conversations, frontiers."""
