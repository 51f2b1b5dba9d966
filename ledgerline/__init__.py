"""A PySpark engine for longitudinal market listings: typed sources, cleaning,
identity resolution, cohort panels, as-of joins, models and report queries."""
