"""Query plans: the catalogue of registered queries with their oracle SQL."""
