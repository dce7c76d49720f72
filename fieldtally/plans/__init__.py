"""Ready-made survey queries over a folder of tables, by name in ``catalog``."""
