"""A registry of catalogs: one YAML file each, linked to one another by name or path."""

from __future__ import annotations

import os
import warnings
from dataclasses import dataclass, field

import yaml
from pyspark.sql import DataFrame, SparkSession

from celestile.sources import paths as P
from celestile.sources.properties import TYPES, Properties

#: The environment variable that names the default folder of registry files.
ENVIRONMENT = "CELESTILE_REGISTRY_DIR"
#: By type: the field that names the other catalog, whether it must, and what each is to the other.
LINKS = {
    "object": (),
    "source": (("primary", False, "objects", "sources"),),
    "association": (("primary", True, "primary", "associations"), ("join", True, "join", "associations_right")),
    "margin": (("primary", True, "primary", "margins"),),
    "index": (("primary", True, "primary", "indexes"),),
}
FIELDS = ("catalog_path", "catalog_name", "catalog_type", "primary", "join", "creators", "description", "version", "deprecated", "catalog_info")


def default_directory(variable: str = ENVIRONMENT) -> str:
    """From the environment; variables within are expanded. Empty where it is unset."""
    return os.path.expandvars(os.environ.get(variable, ""))


@dataclass(eq=False)
class Entry:
    """What one registry file says. ``links`` holds, by role, the entries it is tied to."""

    catalog_path: str = ""
    catalog_name: str = ""
    catalog_type: str = ""
    primary: str | None = None
    join: str | None = None
    creators: list[str] = field(default_factory=list)
    description: str = ""
    version: str = ""
    deprecated: str = ""
    catalog_info: dict = field(default_factory=dict)
    namespace: str = ""
    links: dict[str, list[Entry]] = field(default_factory=dict, repr=False)

    def __post_init__(self) -> None:
        self.primary = self.primary or self.catalog_info.get("primary_catalog")
        self.join = self.join or self.catalog_info.get("join_catalog")
        self.catalog_path = os.path.expandvars(self.catalog_path)

    @property
    def full_name(self) -> str:
        return f"{self.namespace}:{self.catalog_name}" if self.namespace else self.catalog_name

    def linked(self, role: str) -> list[Entry]:
        return self.links.get(role, [])

    @classmethod
    def from_catalog(cls, path: str) -> Entry:
        p = Properties.read(path)
        return cls(catalog_path=str(path), catalog_name=p.catalog_name, catalog_type=p.catalog_type, catalog_info=p.explicit())

    @classmethod
    def from_file(cls, path: str, namespace: str = "") -> Entry:
        if not str(path).endswith(".yml"):
            raise ValueError(f"registry files end in .yml: {path}")
        values = yaml.safe_load(P.read_text(path)) or {}
        if unknown := set(values) - set(FIELDS):
            raise TypeError(f"unknown field {', '.join(sorted(unknown))} in {path}")
        return cls(**values, namespace=namespace)

    def write(self, directory: str | None = None, variable: str = ENVIRONMENT) -> str:
        """Into a folder, or into the default one if none is given; never over another file."""
        into = directory or default_directory(variable)
        if not into:
            raise ValueError("give a directory or set a default one")
        path = f"{str(into).rstrip('/')}/{self.catalog_name}.yml"
        if P.exists(path):
            raise ValueError(f"{path} exists")
        always = ("catalog_path", "catalog_name", "catalog_type", "creators", "description", "catalog_info")
        values = {k: getattr(self, k) for k in (*always, "primary", "join", "version", "deprecated") if k in always or getattr(self, k)}
        P.write_text(path, yaml.safe_dump(values, sort_keys=False))
        return path


class Registry:
    """All entries of some files and folders. ``sources`` is one path, a list of them, or
    a dict of namespace -> either; names must differ within a namespace."""

    def __init__(self, sources: str | list | dict | None = None, use_default: bool = True, variable: str = ENVIRONMENT) -> None:
        self.entries: dict[str, Entry] = {}
        self._by_path: dict[str, Entry] = {}
        given = [("", default_directory(variable))] if use_default and default_directory(variable) else []
        given += list(sources.items()) if isinstance(sources, dict) else [("", sources)] if sources is not None else []
        for namespace, some in given:
            for path in some if isinstance(some, (list, tuple, set)) else [some]:
                files = [str(path)] if P.is_file(path) else [x for x in P.contents(path) if x.endswith(".yml")]
                for file in files:
                    self._add(Entry.from_file(file, namespace))
        for entry in self.entries.values():
            self._link(entry)

    def _add(self, entry: Entry) -> None:
        if entry.full_name in self.entries:
            warnings.warn(f"Duplicate catalog name {entry.full_name}; use namespaces", stacklevel=3)
            return
        self.entries[entry.full_name] = entry
        self._by_path[entry.catalog_path] = entry

    def _link(self, entry: Entry) -> None:
        if entry.catalog_type not in TYPES:
            warnings.warn(f"{entry.full_name} is of unknown type {entry.catalog_type}", stacklevel=3)
        for name, must, role, back in LINKS.get(entry.catalog_type, ()):
            text = getattr(entry, name)
            other = self.find(text, entry.namespace)
            if other is not None:
                entry.links.setdefault(role, []).append(other)
                other.links.setdefault(back, []).append(entry)
            elif must or text:
                warnings.warn(f"{entry.catalog_type} {entry.full_name} missing {name} catalog {text}", stacklevel=3)

    def find(self, text: str | None, namespace: str = "") -> Entry | None:
        """By path (environment variables expanded), by full name, or by name in a namespace."""
        if not text:
            return None
        return self._by_path.get(os.path.expandvars(text)) or self.entries.get(text) or self.entries.get(f"{namespace}:{text}")

    def names(self, include_deprecated: bool = False, types: list[str] | None = None) -> list[str]:
        return [k for k, e in self.entries.items() if (include_deprecated or not e.deprecated) and (not types or e.catalog_type in types)]

    def __getitem__(self, name: str) -> Entry:
        return self.entries[name]

    def open(self, spark: SparkSession, name: str):
        from celestile.catalog import open_catalog

        return open_catalog(spark, self[name].catalog_path)

    def frame(self, spark: SparkSession) -> DataFrame:
        """``(name, catalog_type, catalog_path, deprecated)`` of every entry."""
        return spark.createDataFrame([(k, e.catalog_type, e.catalog_path, bool(e.deprecated)) for k, e in self.entries.items()], "name string, catalog_type string, catalog_path string, deprecated boolean")

    def links(self, spark: SparkSession) -> DataFrame:
        """``(name, role, other)`` of every link, from both sides."""
        rows = [(k, role, o.full_name) for k, e in self.entries.items() for role, others in e.links.items() for o in others]
        return spark.createDataFrame(rows, "name string, role string, other string")
