"""Finding repositories below a folder: working clones (standard) or bare ones, directly in it or one bucket folder down."""

from __future__ import annotations

import os

FORMATS = ("standard", "bare")


def check_format(fmt: str) -> str:
    if fmt not in FORMATS:
        raise ValueError(f"repository format {fmt!r} is not supported; there are {', '.join(FORMATS)}")
    return fmt


def git_dir_of(folder: str, fmt: str) -> str | None:
    """The git folder of a repository's folder; None if none is there."""
    at = os.path.join(folder, ".git") if fmt == "standard" else folder
    return at if os.path.isfile(os.path.join(at, "HEAD")) and os.path.isdir(os.path.join(at, "objects")) else None


def discover(path: str, fmt: str) -> list[tuple[str, str]]:
    """(folder, git folder) of each repository, sorted; links that lead out of the path are not followed."""
    check_format(fmt)
    path = path.removeprefix("file://")
    root = os.path.realpath(path)
    found = []

    def inside(folder: str) -> bool:
        real = os.path.realpath(folder)
        return real == root or real.startswith(root + os.sep)

    def look(folder: str, depth: int) -> None:
        if git_dir := git_dir_of(folder, fmt):
            found.append((folder, git_dir))
        elif depth < 2:
            for entry in os.scandir(folder):
                if entry.is_dir() and not entry.name.startswith(".git") and inside(entry.path):
                    look(entry.path, depth + 1)

    look(path, 0)
    return sorted(found)
