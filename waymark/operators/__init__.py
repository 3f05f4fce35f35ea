"""Query operators: spatial joins, text index, scoring, graph."""
