"""Relational operators: merge order, routing, book folds, views, snapshots."""
