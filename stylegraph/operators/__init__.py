"""DataFrame operators: joins, grouping, graphs, weights, ranking, metrics."""
