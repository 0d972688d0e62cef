"""DataFrame operators: term weights, spatial joins, searches."""
