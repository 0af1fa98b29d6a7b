"""Analytics for entity panels: one row per entity and period, turned into features, scores and ranks."""
