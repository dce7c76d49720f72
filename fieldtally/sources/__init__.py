"""Readers, writers and the survey-shaped view of a table folder."""
