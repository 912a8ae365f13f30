"""Column-level building blocks: numbers, periods, display text and markup."""
