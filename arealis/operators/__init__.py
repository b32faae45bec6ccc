"""DataFrame-to-DataFrame operators: joins, aggregates, ranking, sets."""
