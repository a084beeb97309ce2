"""Planners above Catalyst: recipes, rules, constraints, machines, transactions, schema mapping."""
