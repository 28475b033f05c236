"""Planning on the driver: schemas, workloads, trees, privacy budgets."""
