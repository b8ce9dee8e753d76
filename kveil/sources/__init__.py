from kveil.sources.config import Attribute, JobSpec, Roles, load_spec, read_attributes, read_dgh
from kveil.sources.tables import (
    literal_table,
    load_model,
    preview,
    read_csv,
    read_table,
    read_text,
    save_model,
    write_csv,
    write_text,
)

__all__ = [
    "Attribute",
    "JobSpec",
    "Roles",
    "load_spec",
    "read_attributes",
    "read_dgh",
    "literal_table",
    "load_model",
    "preview",
    "read_csv",
    "read_table",
    "read_text",
    "save_model",
    "write_csv",
    "write_text",
]
