"""Query plans: the fixture graph, named queries, the pattern-query front end and stage ordering."""
