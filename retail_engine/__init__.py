"""Retail sales reporting on Spark: landing, star schema, reports, intake, audits."""
