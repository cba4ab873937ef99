"""See the package docstring of tallyforge."""
