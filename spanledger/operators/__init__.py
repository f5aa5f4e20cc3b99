"""Operators on histories: extraction, resolution, selection, verification and what surrounds them."""
