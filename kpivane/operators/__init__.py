"""DataFrame operators: KPI queries, features, signals, explanations, tiles and clusters."""
