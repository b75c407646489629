"""Execution helpers: durable intermediate tables and fixpoint loops."""
