"""Contents by place: the bytes of a file, or of an entry of an archive, also of one within archives.

What a plan says of a class is its place and digest. Whoever needs the bytes reads them here, in the task that uses them, so contents never
travel through a shuffle, a cache or a window.
"""

from __future__ import annotations

import hashlib
import io
import zipfile


class Changed(OSError):
    """A place no longer holds what was scanned there."""


class Contents:
    """Keeps the last archive open, and those within it that led to the last entry: rows sorted by place open each archive once."""

    def __init__(self) -> None:
        self.path: str | None = None
        self.opened: list[tuple[str, zipfile.ZipFile]] = []  # the entry that led to each, the outermost first

    def __enter__(self) -> "Contents":
        return self

    def __exit__(self, *_: object) -> None:
        self.close()

    def close(self) -> None:
        while self.opened:
            self.opened.pop()[1].close()
        self.path = None

    def archive(self, path: str, within: list[str]) -> zipfile.ZipFile:
        if path != self.path:
            self.close()
            self.opened, self.path = [("", zipfile.ZipFile(path))], path
        shared = 0
        while shared < min(len(within), len(self.opened) - 1) and self.opened[shared + 1][0] == within[shared]:
            shared += 1
        while len(self.opened) > shared + 1:
            self.opened.pop()[1].close()
        for name in within[shared:]:
            self.opened.append((name, zipfile.ZipFile(io.BytesIO(self.opened[-1][1].read(name)))))
        return self.opened[-1][1]

    def read(self, path: str, entry: str | None = None, digest: str | None = None) -> bytes:
        """entry: `inner.jar!/A.class` within archives. digest: what the content must still have."""
        if entry is None:
            with open(path, "rb") as f:
                data = f.read()
        else:
            *within, name = entry.split("!/")
            data = self.archive(path, within).read(name)
        if digest is not None and hashlib.sha256(data).hexdigest() != digest:
            raise Changed(f"{path}{'!/' + entry if entry else ''} has changed since it was scanned")
        return data
