"""The engine's registered queries over the driver tables, with their SQL."""
