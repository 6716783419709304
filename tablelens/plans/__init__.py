"""The workspace and the SQL runner."""
