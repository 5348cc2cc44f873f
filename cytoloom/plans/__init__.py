"""Multi-step plans: skew-safe ranking, spatial joins, graph iteration, whole extraction flows."""
