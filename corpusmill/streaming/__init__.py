"""The row-local operators on streaming frames."""
