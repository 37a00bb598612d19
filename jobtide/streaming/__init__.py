"""Incremental forms: landed snapshots and sightings as file streams."""
