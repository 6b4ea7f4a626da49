"""Files of the shared folders as Python tasks open them."""

from __future__ import annotations


def filesystem(uri: str):
    """The pyarrow file system of a path or URI, and the path in it."""
    from pyarrow import fs
    scheme, _, rest = uri.partition(":")
    if scheme == "file":
        uri = "file:///" + rest.lstrip("/")
    return fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))
