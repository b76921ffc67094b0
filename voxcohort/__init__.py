"""PySpark jobs for imaging-cohort tables: voxels, group statistics, cross-validation, robustness."""
