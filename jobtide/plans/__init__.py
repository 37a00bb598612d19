"""Read models: views, search, listings, joins and statistics."""
