"""Figures printed in company reports: normalised, laid out, reconciled and counted on Spark."""
