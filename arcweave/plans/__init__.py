"""Query plans: the Graph object, the query registry and its SQL twins."""
