"""Column expressions: missing values, physics, calendar and calibration formulas."""
