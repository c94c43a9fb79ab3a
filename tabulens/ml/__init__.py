"""Feature preparation, models, metrics and unsupervised detection."""
