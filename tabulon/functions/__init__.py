"""Part of the tabulon engine."""
