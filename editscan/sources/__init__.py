"""File formats as tables, and back."""
