"""One repository read through the git command: references, logs, trees and blobs as plain rows.

Repositories are untrusted: neither system nor user configuration is read, no hook, filter or pager runs, and of a
repository's own configuration only remote.* is used. Logs are read from a pipe as they come; trees and blobs come from one
process for all objects, and a tree that many commits share is parsed once while it's among the last MEMO ones.
"""

from __future__ import annotations

import os
import subprocess
from collections import OrderedDict
from collections.abc import Iterator
from datetime import UTC, datetime
from typing import Any

from .identity import id_of_urls, parse_reference

#: Bytes of a blob that are read at most.
MOST_BYTES = 20 << 20
#: Bytes in which a zero byte makes a blob binary.
SNIFFED = 8000
#: Parsed trees that are kept.
MEMO = 20_000
_FORMAT = "--format=%H%n%P%n%ae%n%an%n%at%n%ce%n%cn%n%ct%n%B"


class RepositoryError(RuntimeError):
    """An error in a repository, with its path and its remotes."""

    def __init__(self, path: str, urls: list[str], why: str):
        super().__init__(f"{why} [repository {path}; remotes {', '.join(urls) or 'none'}]")


class Repository:
    """git_dir: the folder with HEAD and objects."""

    def __init__(self, path: str, git_dir: str):
        self.path, self.git_dir = path, git_dir
        self._batch: subprocess.Popen | None = None
        self._width = 20
        self._trees: OrderedDict[str, list[tuple[str, bool, str]]] = OrderedDict()
        self.urls, self.forks = self._remotes()
        self.remotes = {name: i for name, urls in self.urls.items() if (i := id_of_urls(urls))}

    def __enter__(self) -> Repository:
        return self

    def __exit__(self, *_: object) -> None:
        if self._batch:
            self._batch.stdin.close()
            self._batch.stdout.close()
            self._batch.wait()
            self._batch = None

    def error(self, why: str) -> RepositoryError:
        return RepositoryError(self.path, sum(getattr(self, "urls", {}).values(), []), why)

    def _start(self, *args: str, **pipes: Any) -> subprocess.Popen:
        env = {"PATH": os.environ.get("PATH", ""), "GIT_CONFIG_NOSYSTEM": "1", "GIT_CONFIG_GLOBAL": os.devnull, "GIT_OPTIONAL_LOCKS": "0", "GIT_TERMINAL_PROMPT": "0", "LC_ALL": "C"}
        command = ["git", "--no-pager", "-c", "safe.directory=*", "-c", "core.fsmonitor=false", "-c", "core.hooksPath=/dev/null", f"--git-dir={self.git_dir}", *args]
        return subprocess.Popen(command, env=env, stdout=subprocess.PIPE, **pipes)

    def _run(self, *args: str, ok: tuple[int, ...] = (0,)) -> bytes:
        process = self._start(*args, stderr=subprocess.PIPE)
        out, err = process.communicate()
        if process.returncode not in ok:
            raise self.error(err.decode("utf-8", "replace").strip())
        return out

    def _remotes(self) -> tuple[dict[str, list[str]], dict[str, bool]]:
        urls: dict[str, list[str]] = {}
        forks: dict[str, bool] = {}
        for entry in self._run("config", "--local", "-z", "--get-regexp", r"^remote\..*\.(url|isfork)$", ok=(0, 1)).decode("utf-8", "replace").split("\0"):
            key, _, value = entry.partition("\n")
            if key:
                name, _, what = key[len("remote.") :].rpartition(".")
                if what == "url":
                    urls.setdefault(name, []).append(value)
                else:
                    forks[name] = value.lower() in ("true", "1", "yes", "on")
        return urls, forks

    def references(self) -> list[dict[str, Any]]:
        """References with their peeled hashes, HEAD included."""
        rows = []
        head = self._run("rev-parse", "--verify", "-q", "HEAD", ok=(0, 1)).decode().strip()
        found = [("HEAD", head)] if head else []
        for line in self._run("for-each-ref", "--format=%(refname)%00%(objectname)%00%(*objectname)").decode("utf-8", "replace").splitlines():
            name, own, peeled = line.split("\0")
            found.append((name, peeled or own))
        for name, hash_ in found:
            repository_id, parsed, remote = parse_reference(name, self.remotes, self.git_dir)
            rows.append({"repository_id": repository_id, "name": parsed, "hash": hash_, "is_remote": remote})
        return rows

    def repositories(self, references: list[dict[str, Any]]) -> dict[str, dict[str, Any]]:
        """The repositories that its remotes and references belong to, by their ids."""
        rows = {}
        for id_ in dict.fromkeys([*self.remotes.values(), *(r["repository_id"] for r in references)]):
            name = next((n for n, i in self.remotes.items() if i == id_), None)
            rows[id_] = {"id": id_, "urls": self.urls.get(name, []), "is_fork": self.forks.get(name, False), "repository_path": self.path}
        return rows

    def log(self, tip: str, most: int | None = None) -> Iterator[dict[str, Any]]:
        """The commits that lead to a tip, the newest first, at most so many; none if the tip is no commit."""
        if most == 0 or self._kind(tip) != "commit":
            return
        limit = [] if most is None else ["-n", str(most)]
        process = self._start("log", "-z", *limit, "--no-show-signature", "--no-notes", "--encoding=UTF-8", _FORMAT, tip, "--", stderr=subprocess.PIPE)
        rest = b""
        try:
            while chunk := process.stdout.read1(1 << 20):
                *whole, rest = (rest + chunk).split(b"\0")
                yield from (_commit(x) for x in whole if x)
            if rest:
                yield _commit(rest)
            why = process.stderr.read().decode("utf-8", "replace").strip()
            if process.wait():
                raise self.error(why)
        finally:
            process.stdout.close()
            process.stderr.close()
            process.wait()

    def _read(self, name: str, most: int | None = None) -> tuple[str, bytes] | None:
        """(kind, content) of an object, None if it's missing."""
        if self._batch is None:
            self._batch = self._start("cat-file", "--batch", stdin=subprocess.PIPE, stderr=subprocess.DEVNULL)
        self._batch.stdin.write(name.encode() + b"\n")
        self._batch.stdin.flush()
        about = self._batch.stdout.readline().split()
        if not about:
            self._batch = None
            raise self.error(f"object {name} can't be read")
        if len(about) != 3 or not about[2].isdigit():
            return None
        self._width = len(about[0]) // 2  # bytes of a hash
        size = int(about[2])
        data = self._batch.stdout.read(size if most is None else min(size, most))
        for at in range(len(data), size + 1, 1 << 20):  # the rest and the closing line end
            self._batch.stdout.read(min(1 << 20, size + 1 - at))
        return about[1].decode(), data

    def _kind(self, name: str) -> str | None:
        found = self._read(name, 0)
        return found and found[0]

    def _tree(self, name: str) -> list[tuple[str, bool, str]]:
        """(name, is a tree, hash) of what a tree holds."""
        if name in self._trees:
            self._trees.move_to_end(name)
            return self._trees[name]
        found = self._read(name)
        if found is None or found[0] != "tree":
            raise self.error(f"tree {name} is missing")
        data, at, entries = found[1], 0, []
        while at < len(data):
            space, end = data.index(b" ", at), data.index(b"\0", at)
            entries.append((data[space + 1 : end].decode("utf-8", "replace"), data[at:space] == b"40000", data[end + 1 : end + 1 + self._width].hex()))
            at = end + 1 + self._width
        self._trees[name] = entries
        if len(self._trees) > MEMO:
            self._trees.popitem(last=False)
        return entries

    def entries(self, commit: str) -> Iterator[tuple[str, str]]:
        """(path, hash) of the files, links and submodules of a commit, with paths from the root."""
        open_ = [("", iter(self._tree(f"{commit}^{{tree}}")))]
        while open_:
            folder, rest = open_[-1]
            for name, is_tree, hash_ in rest:
                if is_tree:
                    open_.append((f"{folder}{name}/", iter(self._tree(hash_))))
                    break
                yield folder + name, hash_
            else:
                open_.pop()

    def blob(self, hash_: str) -> dict[str, Any] | None:
        """content (up to MOST_BYTES, blank if binary) and is_binary; None if the object is missing or no blob."""
        found = self._read(hash_, MOST_BYTES)
        if found is None or found[0] != "blob":
            return None
        binary = b"\0" in found[1][:SNIFFED]
        return {"content": b"" if binary else found[1], "is_binary": binary}


def _commit(entry: bytes) -> dict[str, Any]:
    hash_, parents, ae, an, at, ce, cn, ct, message = entry.decode("utf-8", "replace").split("\n", 8)
    own = parents.split()
    return {
        "hash": hash_, "message": message[:-1] if message.endswith("\n\n") else message, "parents": own, "parents_count": len(own),
        "author_email": ae, "author_name": an, "author_date": datetime.fromtimestamp(int(at), UTC), "committer_email": ce, "committer_name": cn, "committer_date": datetime.fromtimestamp(int(ct), UTC),
    }
