"""The metadata of a catalog: a java properties file with a fixed set of keys.

Most keys on disk carry a prefix that names the layout's standard. Any prefix is
understood when reading; the one to write is given.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field, fields, replace

from celestile.sources.paths import read_text, write_text

PREFIX = "sky"
TYPES = ("object", "source", "association", "index", "margin")
# Fixed values of the file format, down to EXTRA.
#: field -> key on disk; ``*`` stands for the prefix.
KEYS = {
    "catalog_name": "obs_collection", "catalog_type": "dataproduct_type", "total_rows": "*_nrows", "ra_column": "*_col_ra", "dec_column": "*_col_dec",
    "default_columns": "*_cols_default", "primary_catalog": "*_primary_table_url", "margin_threshold": "*_margin_threshold", "primary_column": "*_col_assn_primary",
    "primary_column_association": "*_col_assn_primary_assn", "join_catalog": "*_assn_join_table_url", "join_column": "*_col_assn_join",
    "join_column_association": "*_col_assn_join_assn", "contains_leaf_files": "*_assn_leaf_files", "indexing_column": "*_index_column", "extra_columns": "*_index_extra_column",
}
ALWAYS = ("catalog_name", "catalog_type", "total_rows")
REQUIRED = {
    "object": ("ra_column", "dec_column"), "source": ("ra_column", "dec_column"), "index": ("primary_catalog", "indexing_column"), "margin": ("primary_catalog", "margin_threshold"),
    "association": ("primary_catalog", "primary_column", "join_catalog", "join_column", "contains_leaf_files"),
}
OPTIONAL = {
    "object": ("default_columns",), "source": ("primary_catalog", "default_columns"), "index": ("extra_columns",), "margin": ("ra_column", "dec_column", "default_columns"),
    "association": ("primary_column_association", "join_column_association"),
}
#: Further keys a file may have.
EXTRA = frozenset(
    "addendum_did bib_reference bib_reference_url creator_did data_ucd *_builder *_cols_sort *_cols_survey_id *_coordinate_epoch *_copyright *_creation_date *_creator *_estsize "
    "*_frame *_max_rows *_order *_progenitor_url *_release_date *_service_url *_status *_version moc_sky_fraction obs_ack obs_copyright obs_copyright_url obs_description "
    "obs_regime obs_title prov_progenitor publisher_id t_max t_min".split()
)
_LISTS = ("default_columns", "extra_columns")
_STARRED = {k[2:] for k in (*KEYS.values(), *EXTRA) if k[0] == "*"}


def _general(key: str) -> str:
    """A key with its prefix, if any, replaced by ``*``."""
    head, _, tail = key.partition("_")
    return f"*_{tail}" if tail in _STARRED and re.fullmatch("[a-z]+", head) else key


def as_list(value: str | list[str] | None) -> list[str] | None:
    found = [x for x in re.split(r"[; ,\n]", value) if x] if isinstance(value, str) else list(value or [])
    return found or None


@dataclass(frozen=True)
class Properties:
    catalog_name: str
    catalog_type: str
    total_rows: int
    ra_column: str | None = None
    dec_column: str | None = None
    default_columns: list[str] | None = None
    primary_catalog: str | None = None
    margin_threshold: float | None = None
    primary_column: str | None = None
    primary_column_association: str | None = None
    join_catalog: str | None = None
    join_column: str | None = None
    join_column_association: str | None = None
    contains_leaf_files: bool | None = None
    indexing_column: str | None = None
    extra_columns: list[str] | None = None
    extra: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        put = lambda k, v: object.__setattr__(self, k, v)
        put("catalog_type", str(getattr(self.catalog_type, "value", self.catalog_type)))
        if self.catalog_type not in TYPES:
            raise ValueError(f"unknown catalog type {self.catalog_type}")
        put("total_rows", int(self.total_rows))
        for k in _LISTS:
            put(k, as_list(getattr(self, k)))
        if self.margin_threshold is not None:
            put("margin_threshold", float(self.margin_threshold))
        if isinstance(self.contains_leaf_files, str):
            put("contains_leaf_files", self.contains_leaf_files.strip().lower() in ("true", "1", "yes"))
        given = self.explicit().keys()
        allowed = {*ALWAYS, *REQUIRED[self.catalog_type], *OPTIONAL[self.catalog_type]}
        if bad := given - allowed:
            raise ValueError(f"a catalog of type {self.catalog_type} has no {', '.join(sorted(bad))}")
        if bad := {*ALWAYS, *REQUIRED[self.catalog_type]} - given:
            raise ValueError(f"a catalog of type {self.catalog_type} needs {', '.join(sorted(bad))}")
        if bad := {k for k in self.extra if _general(k) not in EXTRA}:
            raise ValueError(f"unknown property {', '.join(sorted(bad))}")

    @classmethod
    def of(cls, values: dict) -> Properties:
        """From field names or keys on disk; what is neither becomes ``extra``."""
        names = {v: k for k, v in KEYS.items()} | {k: k for k in KEYS}
        own = {names[g]: v for k, v in values.items() if (g := _general(k)) in names}
        return cls(**own, extra={k: v for k, v in values.items() if _general(k) not in names})

    def explicit(self) -> dict:
        """The fields that are set, without further keys."""
        return {f.name: v for f in fields(self) if f.name != "extra" and (v := getattr(self, f.name)) is not None}

    def updated(self, **changes) -> Properties:
        return replace(self, **changes)

    def __str__(self) -> str:
        return "".join(f"  {k} {v}\n" for k, v in self.explicit().items())

    @classmethod
    def read(cls, directory: str) -> Properties:
        return cls.of(parse(read_text(f"{str(directory).rstrip('/')}/properties")))

    def write(self, directory: str, prefix: str = PREFIX) -> None:
        out = ["#Catalog metadata"]
        for k, v in (*((KEYS[k].replace("*", prefix), v) for k, v in self.explicit().items()), *self.extra.items()):
            out.append(f"{k}={escaped(' '.join(v) if isinstance(v, list) else str(v))}")
        write_text(f"{str(directory).rstrip('/')}/properties", "\n".join(out) + "\n")


def escaped(value: str) -> str:
    return re.sub(r"([:=#!\\])", r"\\\1", value).replace("\n", "\\n")


def parse(text: str) -> dict[str, str]:
    """Lines ``key=value``, ``key: value`` or ``key value``; comments, escapes, and lines
    that go on after a backslash."""
    out = {}
    text = re.sub(r"(?<!\\)((?:\\\\)*)\\\r?\n[ \t]*", r"\1", text)
    for line in text.splitlines():
        line = line.strip()
        if line and line[0] not in "#!":
            m = re.match(r"((?:\\.|[^\\=:\s])+)\s*[=:]?\s*(.*)", line)
            if m:
                plain = lambda s: re.sub(r"\\(.)", lambda e: {"n": "\n", "t": "\t", "r": "\r"}.get(e[1], e[1]), s)
                out[plain(m[1])] = plain(m[2])
    return out
