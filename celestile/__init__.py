"""Hierarchical equal-area sky tiles on Spark."""

from importlib import import_module

_PUBLIC = {
    "Box": "operators.regions", "Catalog": "catalog", "Cone": "operators.regions", "Polygon": "operators.regions", "Properties": "sources.properties", "Registry": "sources.registry",
    "in_memory": "catalog", "is_valid": "sources.validation", "open_catalog": "catalog", "write_association": "sources.stores", "write_catalog": "sources.writer",
    "write_index": "sources.stores", "write_margin": "sources.stores",
}
__all__ = list(_PUBLIC)


def __getattr__(name: str):
    """Public names are imported on first use, so Python workers load only what they run."""
    if name not in _PUBLIC:
        raise AttributeError(f"module {__name__} has no attribute {name}")
    return getattr(import_module(f"{__name__}.{_PUBLIC[name]}"), name)
