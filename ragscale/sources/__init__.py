"""Reading and writing records, registries and reports."""
