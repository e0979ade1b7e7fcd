"""Limits on packages and parts; each failure is an error row, never a lost job."""

from __future__ import annotations

import re

# Limits on archives and on the scan for document types.
MAX_ENTRIES = 10_000
MAX_ENTRY_BYTES = 100 * 1024 * 1024
MAX_TOTAL_BYTES = 500 * 1024 * 1024
MOST_PACKED = 1000
DOCTYPE_WINDOW = 4096
MAX_CHAIN = 64

_UNSAFE = re.compile(r"^[/\\]|(?:^|[/\\])\.\.(?:[/\\]|$)")
_DOCTYPE = re.compile(rb"<!DOCTYPE", re.I)


class PackageError(Exception):
    """kind (as in the error taxonomy), part and detail."""

    def __init__(self, kind: str, part: str, detail: str):
        super().__init__(f"{kind}: {part}: {detail}")
        self.kind, self.part, self.detail = kind, part, detail

    def row(self) -> dict:
        return {"kind": self.kind, "part": self.part, "detail": self.detail}


def check_count(entries: int) -> None:
    if entries > MAX_ENTRIES:
        raise PackageError("zip_entry_limit", "", f"{entries} entries, at most {MAX_ENTRIES}")


def safe_path(name: str) -> bool:
    return not _UNSAFE.search(name)


def check_path(name: str) -> None:
    if not safe_path(name):
        raise PackageError("zip_path_traversal", name, "unsafe path")


def too_large(size):
    """Of numbers or columns alike."""
    return size > MAX_ENTRY_BYTES


def too_packed(size, packed):
    """Of numbers or columns alike: a ratio under 1 / MOST_PACKED, as whole numbers tell it exactly."""
    return (size > 0) & (packed > 0) & (packed * MOST_PACKED < size)


def check_entry(name: str, size: int, packed: int, total: int) -> None:
    """total: bytes of entries read before this one; unlike a check of single entries, it adds up."""
    if too_large(size):
        raise PackageError("zip_bomb", name, f"{size} bytes")
    if too_packed(size, packed):
        raise PackageError("zip_bomb", name, f"packed to {packed} of {size} bytes")
    if total + size > MAX_TOTAL_BYTES:
        raise PackageError("zip_bomb", name, f"{total + size} bytes in all")


def check_doctype(part: str, data: bytes) -> None:
    if _DOCTYPE.search(data[:DOCTYPE_WINDOW]):
        raise PackageError("xml_parse", part, "document type declarations are not allowed")
