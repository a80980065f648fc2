"""Folders whose content changes as a whole: versions beside each other, and a file that names the one that holds."""

from __future__ import annotations

import uuid

from pyarrow import fs

from .files import opened

HOLDS = "CURRENT"


def fresh() -> str:
    return uuid.uuid4().hex


def current(path: str) -> str | None:
    """The version that holds, or None where none was ever published."""
    system, at = opened(path)
    if system.get_file_info(f"{at}/{HOLDS}").type != fs.FileType.File:
        return None
    with system.open_input_stream(f"{at}/{HOLDS}") as f:
        return f.read().decode()


def publish(path: str, version: str) -> None:
    """From now on ``version`` holds: the pointer is replaced in one step."""
    system, at = opened(path)
    with system.open_output_stream(f"{at}/{HOLDS}.{version}") as f:
        f.write(version.encode())
    system.move(f"{at}/{HOLDS}.{version}", f"{at}/{HOLDS}")


def discard(path: str, version: str) -> None:
    """Removes what an unpublished or superseded version wrote."""
    system, at = opened(path)
    if system.get_file_info(f"{at}/{version}").type == fs.FileType.Directory:
        system.delete_dir(f"{at}/{version}")
