"""Change events, generations and freshness."""
