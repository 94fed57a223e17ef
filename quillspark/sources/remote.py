"""File access for data sources, whose readers and writers run outside Spark's own: one open file system per URI."""

from __future__ import annotations

import re


def opened(uri: str):
    """(pyarrow file system, path) of a URI or an absolute path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))


def names(uri: str) -> list[str]:
    """Names of the entries of a folder in order; none where there is no folder."""
    from pyarrow import fs

    system, path = opened(uri)
    if system.get_file_info(path).type != fs.FileType.Directory:
        return []
    return sorted(x.base_name for x in system.get_file_info(fs.FileSelector(path)))
