"""The audit as a plan in three stages: parse, features, rules and score."""
