"""Table operators: joins, groupings and iterations over repository tables."""
