"""Feature preparation and the two fitted models."""
