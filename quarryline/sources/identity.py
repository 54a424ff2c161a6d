"""Which repository a remote, a reference or a folder stands for."""

from __future__ import annotations

import os
import re
from urllib.parse import urlsplit

_SHORT = re.compile(r"[\w.+-]+@([^:/]+):(.+?)(?:\.git)?$")


def id_of_url(url: str) -> str | None:
    """host/path; .git goes from user@host:path and stays in a full url; None if the url can't be read."""
    if m := _SHORT.match(url):
        return f"{m[1]}/{m[2]}"
    try:
        parts = urlsplit(url)
    except ValueError:
        return None
    host = parts.netloc.rpartition("@")[2].split(":")[0]  # as it is written, as in functions.scalar
    return f"{host}{parts.path}" if parts.scheme and host else None


def id_of_urls(urls: list[str]) -> str | None:
    return min((i for u in urls if (i := id_of_url(u))), default=None)


def id_of_folder(git_dir: str) -> str:
    """A repository without a remote is named by its folder, the parent one for a .git inside."""
    path = os.path.abspath(git_dir)
    return "file://" + (os.path.dirname(path) if os.path.basename(path) == ".git" else path)


def parse_reference(name: str, remotes: dict[str, str], git_dir: str) -> tuple[str, str, bool]:
    """(repository id, normalised name, is remote) of a reference; remotes: ids by the remotes' names."""
    head, _, last = name.rpartition("/")
    if not name.startswith("refs/remotes/") and head and last in remotes:  # an archive of many repositories: the last part is the remote
        return remotes[last], head, True
    if name.startswith("refs/remotes/"):
        for remote in sorted(remotes, key=len, reverse=True):  # a remote's name may hold slashes
            prefix = f"refs/remotes/{remote}/"
            if name.startswith(prefix):
                return remotes[remote], "refs/heads/" + name[len(prefix) :], True
    return id_of_folder(git_dir), name, False
