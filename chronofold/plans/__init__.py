"""Multi-step plans: data preparation, candidate generation, cross-fitting, training, replay."""
