"""Reading payloads and tables, and writing the layered outputs of a run."""
