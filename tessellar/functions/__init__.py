"""Part of the array engine."""
