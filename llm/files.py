"""Files of the shared folder, opened from inside tasks."""

from __future__ import annotations

from pyarrow import fs


def opened(address: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a plain path or of a file:, hdfs:, s3: or gs: address."""
    if address.startswith("file:"):
        address = "/" + address.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(address if "://" in address else f"file://{address}")
