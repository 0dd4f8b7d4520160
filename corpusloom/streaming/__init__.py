"""The line operators on streams."""
