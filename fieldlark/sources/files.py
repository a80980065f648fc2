"""Files that Python sources open themselves: any place that Arrow knows (local, S3, HDFS, GCS)."""

from __future__ import annotations

from pyarrow import fs


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a place, and its path there; a place without a scheme is local."""
    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri)


def read_text(uri: str) -> str:
    """All files of a place in order of their names, hidden ones left out; a single file as it is."""
    system, at = opened(uri)
    info = system.get_file_info(at)
    names = [at]
    if info.type == fs.FileType.Directory:
        names = sorted(f.path for f in system.get_file_info(fs.FileSelector(at)) if f.is_file and f.base_name[0] not in "._")
    out = []
    for name in names:
        with system.open_input_stream(name) as f:
            out.append(f.read().decode("utf-8"))
    return "".join(out)
