"""Ground truth: simulated runs, spiked copies and a scorer."""
