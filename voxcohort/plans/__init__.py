"""Multi-step plans: shared storage, graph components, queries registered for the driver."""
