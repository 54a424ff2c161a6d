import os
import subprocess
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
os.environ["PYTHONPATH"] = os.pathsep.join([str(Path(__file__).resolve().parent.parent), os.environ.get("PYTHONPATH", "")])

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.driver.memory", "3g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse"))).getOrCreate()
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    return c


class Git:
    """The git command in one repository, with fixed people and times."""

    def __init__(self, path: Path, *init: str):
        self.path, self.time = path, 1_500_000_000
        path.mkdir(parents=True)
        self("init", "-q", "-b", "master", *init)

    def __call__(self, *args: str, data: bytes | None = None) -> str:
        when = f"{self.time} +0000"
        env = {"PATH": os.environ["PATH"], "GIT_AUTHOR_NAME": "Ann Author", "GIT_AUTHOR_EMAIL": "ann@example.com", "GIT_COMMITTER_NAME": "Cy Committer", "GIT_COMMITTER_EMAIL": "cy@example.com", "GIT_AUTHOR_DATE": when, "GIT_COMMITTER_DATE": when, "GIT_CONFIG_GLOBAL": os.devnull, "HOME": str(self.path)}
        return subprocess.run(["git", "-C", str(self.path), *args], env=env, check=True, capture_output=True, input=data).stdout.decode().strip()

    def commit(self, message: str, **files: bytes) -> str:
        for name, content in files.items():
            at = self.path / name.replace("__", "/").replace("_dot_", ".")
            at.parent.mkdir(parents=True, exist_ok=True)
            at.write_bytes(content)
        self.time += 100
        self("add", "-A")
        self("commit", "-q", "--allow-empty", "-m", message)
        return self("rev-parse", "HEAD")


@pytest.fixture(scope="session")
def repositories(tmp_path_factory):
    """Two working clones, one of them a bucket folder down, and one bare repository in a folder of its own."""
    root = tmp_path_factory.mktemp("git")
    one = Git(root / "standard" / "one")
    one.commit("first", a_dot_py=b"import json\nwith open(path) as source:\n    rows = json.load(source)\n", doc__readme_dot_md=b"# hi\n")
    one.commit("fix: second\n\nbody", bin__data=b"\x00\x01\x02", **{"ünïcode_dot_txt": "é".encode()}, empty=b"")
    one("branch", "side")
    one.commit("third", a_dot_py=b"print(1)\n")
    one("checkout", "-q", "side")
    one.commit("on side", b_dot_rb=b"puts 1\n")
    one("checkout", "-q", "master")
    one.time += 100
    one("merge", "-q", "--no-ff", "-m", "merge side", "side")
    one("tag", "-a", "v1", "-m", "tagged")
    one("update-ref", "refs/blobs/one", one("rev-parse", "HEAD:a.py"))
    one("update-index", "--add", "--cacheinfo", "160000," + "1" * 40 + ",sub")
    one("commit", "-q", "-m", "submodule")
    one("remote", "add", "origin", "git@github.com:user/one.git")
    one("config", "--add", "remote.origin.url", "https://github.com/user/one.git")
    one("config", "remote.origin.isfork", "true")
    one("update-ref", "refs/remotes/origin/master", "master~1")
    one("update-ref", "refs/remotes/origin/HEAD", "master~1")

    two = Git(root / "standard" / "bucket" / "two")
    two.commit("only", x_dot_go=b"package main\n", y_dot_java=b"class Y {}\n")
    two("remote", "add", "origin", "https://gitlab.com/team/two.git")

    bare = Git(root / "bare" / "three.git", "--bare")
    blob = bare("hash-object", "-w", "--stdin", data=b"hello\n")
    tree = bare("mktree", data=f"100644 blob {blob}\thello.sh\n".encode())
    bare("update-ref", "refs/heads/master", bare("commit-tree", tree, "-m", "bare"))
    return root, one, two, bare
