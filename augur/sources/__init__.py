"""Reading and writing question data, and mapping sources to the canonical question."""
