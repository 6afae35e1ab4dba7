"""Query and row-mutation operators."""
