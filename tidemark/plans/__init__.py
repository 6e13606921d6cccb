"""Multi-step jobs: warehouse tables, features, training, scoring and dispatch."""
