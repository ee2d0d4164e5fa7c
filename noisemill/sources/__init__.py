"""Reading and writing tables, schemas and models."""
