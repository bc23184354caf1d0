"""Physical names of layers, schemas and tables."""

from __future__ import annotations

LAYERS = ("raw", "transform", "consumption")
ENVIRONMENTS = ("dev", "prod")


def database(environment: str, layer: str, schema: str | None = None) -> str:
    """``dev`` + ``raw`` -> ``dev_raw``; a schema name is appended as given."""
    if layer.lower() not in LAYERS:
        raise ValueError(f"unknown layer {layer!r}")
    name = f"{environment}_{layer}".lower()
    return f"{name}_{schema.strip()}" if schema else name


def log_database(qualified_name: str | None = None, configured: str | None = None) -> str:
    """Where the run log lives: as configured, else the raw layer of the caller's environment."""
    if configured and configured.strip():
        return configured
    parts = (qualified_name or "").split(".")
    if len(parts) < 3 or "_" not in parts[0]:
        raise ValueError(f"{qualified_name!r} must read DATABASE.SCHEMA.NAME when no log database is given")
    environment = parts[0].split("_")[0].lower()
    return database(environment if environment in ENVIRONMENTS else "dev", "raw")
