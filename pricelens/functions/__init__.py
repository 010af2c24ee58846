"""Column-level building blocks: parsing, rules, scoring, text and numbers."""
