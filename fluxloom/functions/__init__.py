"""Column expressions. Missing is NULL everywhere; no function returns NaN or infinity."""
