"""Adapter views over the test tables, oracle SQL twins and the query registry."""
