"""Column expressions. Nothing here starts a job or needs a session."""
