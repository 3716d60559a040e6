"""Dataset-level operators: cohorts, splits, transforms, moments, geometry, models, inference, dynamics and results."""
