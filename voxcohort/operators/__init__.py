"""DataFrame operators: summaries, ranks and tests, cohort tables, voxels, evaluation, models."""
