"""Plans: operator chains composed into the study's tables, and session settings."""
