"""Plans above single operators: cyclic joins and eager aggregation."""
