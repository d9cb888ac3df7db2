"""Reading and writing narrow arrays."""
