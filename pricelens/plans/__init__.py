"""Plan shapes shared by the operators: blocking joins, exact ranks, components."""
