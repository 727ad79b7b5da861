"""Path predicates and title/content predicates as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extensions that are indexed.
NOTE_TYPES = ["md", "pdf"]
AUDIO_TYPES = ["mp3", "wav", "m4a", "ogg", "flac", "webm"]


def in_folder(path: Column, folder: str | None) -> Column:
    """Inside the folder; a slash is added to it where it has none. No folder: everything."""
    return F.lit(True) if not folder else path.startswith(folder if folder.endswith("/") else f"{folder}/")


def scope(path: Column, folder: str | None = None, exclude_folder: str | None = None, exclude_file: str | None = None) -> Column:
    out = in_folder(path, folder)
    if exclude_folder:
        out = out & ~in_folder(path, exclude_folder)
    if exclude_file:
        out = out & (path != exclude_file)
    return out


def indexable(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)).isin(*NOTE_TYPES, *AUDIO_TYPES)


def under_root(path: Column, root: str) -> Column:
    """A plain prefix, without a slash of its own."""
    return F.lit(True) if root in ("", "/") else path.startswith(root)


def excluded(path: Column, pattern: str) -> Column:
    """A glob (any of ``* ? [ ]``) over the whole path, a directory name, or a prefix if it has a slash."""
    if any(c in pattern for c in "*?[]"):
        regex = "".join(".*" if c == "*" else "." if c == "?" else c if c in "[]" or c.isalnum() or c in "_/ " else f"\\{c}" for c in pattern)
        return path.rlike(f"^{regex}$")
    if "/" not in pattern:
        parts = F.split(path, "/")
        return F.array_contains(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), pattern)
    return path.startswith(pattern)


def is_title(chunk_id: Column) -> Column:
    return chunk_id.endswith("#title")


def needs_index(mtime: Column, size: Column, old_mtime: Column, old_size: Column) -> Column:
    return old_mtime.isNull() | (mtime != old_mtime) | (size != old_size)
