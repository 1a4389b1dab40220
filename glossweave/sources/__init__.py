"""Sources and sinks."""

from glossweave.sources.files import (
    read_assets,
    read_catalogs,
    read_event_stream,
    read_manifests,
    read_pages,
    write_cache,
)

__all__ = [
    "read_assets",
    "read_catalogs",
    "read_event_stream",
    "read_manifests",
    "read_pages",
    "write_cache",
]
