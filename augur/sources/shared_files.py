"""Small files in a folder that all tasks share, on whatever file system its address names.

Tasks cannot reach the driver's JVM, so these go through Arrow's file systems; a plain path
is a mounted folder.
"""

from __future__ import annotations

import uuid

from pyarrow import fs


def place(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of an address, and the path in it."""
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def read_bytes(uri: str) -> bytes | None:
    """What a file holds; None where there is no file."""
    system, path = place(uri)
    try:
        with system.open_input_file(path) as f:
            return f.read()
    except FileNotFoundError:
        return None


def write_bytes(uri: str, data: bytes) -> None:
    """Writes a file at once: under a name of its own first, then moved, so that readers never
    see a part of it and tasks that write the same do not disturb each other."""
    system, path = place(uri)
    folder, _, name = path.rpartition("/")
    system.create_dir(folder, recursive=True)
    draft = f"{folder}/.{name}.{uuid.uuid4().hex}"
    with system.open_output_stream(draft) as f:
        f.write(data)
    system.move(draft, path)


def mounted(uri: str) -> bool:
    """Whether an address is in a mounted folder, where files can be added to."""
    return place(uri)[0].type_name == "local"


def append_bytes(uri: str, data: bytes) -> None:
    """Adds to the end of a file in a mounted folder. To open it again and again costs less than to make
    a file each time: some systems look long for a free inode where many were freed of late."""
    system, path = place(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    with system.open_append_stream(path) as f:
        f.write(data)


def named(folder: str, first: str, last: str) -> list[str]:
    """Addresses of the files in a folder whose names begin and end so."""
    system, path = place(folder)
    inside = system.get_file_info(fs.FileSelector(path, allow_not_found=True))
    return [f"{folder}/{f.base_name}" for f in inside if f.base_name.startswith(first) and f.base_name.endswith(last)]


def remove_file(uri: str) -> None:
    """Deletes a file, which another task may have done."""
    system, path = place(uri)
    try:
        system.delete_file(path)
    except FileNotFoundError:
        pass
