"""DataFrame operators: adjacency, batch reads, statistics and the data-hygiene operators."""
