"""The Git source, the typed frames and the metadata snapshots, held against the git command."""

import pytest
from pyspark.sql import functions as F

from quarryline.engine import Engine
from quarryline.schemas import SCHEMAS
from quarryline.sources import identity
from quarryline.sources.discovery import discover


@pytest.fixture(scope="module")
def engine(spark, repositories):
    return Engine(spark, str(repositories[0] / "standard"))


@pytest.fixture(scope="module", params=["git", "metadata"])
def backend(request, spark, repositories, tmp_path_factory):
    """The same suite on both backends."""
    found = Engine(spark, str(repositories[0] / "standard"))
    if request.param == "metadata":
        folder = tmp_path_factory.mktemp("snapshot")
        found.save_metadata(str(folder))
        found.from_metadata(str(folder))
    yield found
    found.from_repositories()


ONE = "github.com/user/one"


def test_discovery(repositories):
    root = repositories[0]
    assert [p for p, _ in discover(str(root / "standard"), "standard")] == [str(root / "standard/bucket/two"), str(root / "standard/one")]
    assert [p for p, _ in discover(str(root / "bare"), "bare")] == [str(root / "bare/three.git")]
    with pytest.raises(ValueError, match="not supported"):
        discover(str(root), "siva")


def test_identity():
    assert identity.id_of_url("git@github.com:git/repo.git") == "github.com/git/repo"
    assert identity.id_of_url("https://github.com/git/repo.git") == "github.com/git/repo.git"
    assert identity.id_of_url("nonsense") is None and identity.id_of_url("https://me@GitHub.com:443/A/b") == "GitHub.com/A/b"
    assert identity.id_of_urls(["https://b.com/x", "https://a.com/x", "?"]) == "a.com/x"
    remotes = {"0168e2c7": "a.com/x", "origin": "b.com/y"}
    assert identity.parse_reference("refs/heads/dev/0168e2c7", remotes, "/r/.git") == ("a.com/x", "refs/heads/dev", True)
    assert identity.parse_reference("refs/remotes/origin/HEAD", remotes, "/r/.git") == ("b.com/y", "refs/heads/HEAD", True)
    assert identity.parse_reference("HEAD", remotes, "/r/.git") == ("file:///r", "HEAD", False)


def test_schemas(backend):
    for level in ("repositories", "references", "commits", "tree_entries"):
        assert backend.table(level).schema.names == SCHEMAS[level].names


def test_repositories(backend, repositories):
    root = repositories[0] / "standard"
    rows = {r["id"]: r for r in backend.repositories.collect()}
    assert set(rows) == {ONE, f"file://{root}/one", "gitlab.com/team/two.git", f"file://{root}/bucket/two"}
    assert rows[ONE]["urls"] == ["git@github.com:user/one.git", "https://github.com/user/one.git"] and rows[ONE]["is_fork"]
    assert rows[f"file://{root}/one"]["urls"] == [] and rows[ONE]["repository_path"] == f"{root}/one"


def test_references(backend, repositories):
    one = repositories[1]
    local = {tuple(x.split()) for x in one("for-each-ref", "--format=%(refname) %(objectname)", "refs/heads").splitlines()} | {("HEAD", one("rev-parse", "HEAD"))}
    refs = {(r["name"], r["hash"]) for r in backend.repositories.references.filter(F.col("repository_id").startswith("file://") & F.col("repository_id").endswith("/one")).collect()}
    assert local <= refs and ("refs/tags/v1", one("rev-parse", "v1^{}")) in refs
    remote = {r["name"] for r in backend.repositories.remote_references.filter(F.col("repository_id") == ONE).collect()}
    assert remote == {"refs/heads/master", "refs/heads/HEAD"}
    assert backend.repositories.master_ref.count() == 3
    assert {r["name"] for r in backend.repositories.head_ref.collect()} == {"HEAD", "refs/heads/HEAD"}


def test_commits(backend, repositories):
    one = repositories[1]
    local = backend.repositories.references.filter(F.col("repository_id").endswith("/one") & F.col("repository_id").startswith("file"))
    assert {(r["reference_name"], r["hash"]) for r in local.ref("refs/heads/master").commits.collect()} == {("refs/heads/master", one("rev-parse", "master"))}
    log = local.ref("refs/heads/master").commits.all_reference_commits.sort("index").collect()
    assert [r["hash"] for r in log] == one("rev-list", "master").split() and [r["index"] for r in log] == list(range(len(log)))
    merge = next(r for r in log if r["message"].startswith("merge"))
    assert merge["parents"] == one("rev-parse", "master~1^1", "master~1^2").split() and merge["parents_count"] == 2
    second = next(r for r in log if r["message"].startswith("fix"))
    assert second["message"] == "fix: second\n\nbody\n" and second["author_email"] == "ann@example.com" and second["committer_name"] == "Cy Committer"
    assert log[-1]["parents"] == [] and local.filter("name = 'refs/blobs/one'").all_reference_commits.count() == 0


def test_tree_entries_and_blobs(backend, repositories):
    one = repositories[1]
    tips = backend.repositories.filter(F.col("id").endswith("/one")).references.ref("refs/heads/master")
    entries = {(r["path"], r["blob"]) for r in tips.commits.tree_entries.filter("repository_id LIKE 'file%'").collect()}
    assert entries == {(x.split("\t")[1], x.split()[2]) for x in one("-c", "core.quotepath=off", "ls-tree", "-r", "master").splitlines()}
    blobs = {r["path"]: r for r in tips.blobs.filter("repository_id LIKE 'file%'").collect()}
    assert set(blobs) == {p for p, _ in entries} - {"sub"}  # a submodule has no content here
    assert blobs["bin/data"]["is_binary"] and bytes(blobs["bin/data"]["content"]) == b""
    assert bytes(blobs["a.py"]["content"]) == b"print(1)\n" and bytes(blobs["empty"]["content"]) == b""


def test_blobs_by_ids(backend, repositories):
    one = repositories[1]
    first = one("rev-list", "--max-parents=0", "master")
    assert {r["path"] for r in backend.blobs([ONE], ["refs/heads/master"], [first]).collect()} == {"a.py", "doc/readme.md"}
    assert {r["repository_id"] for r in backend.blobs([ONE]).collect()} == {ONE}
    with pytest.raises(TypeError):
        backend.blobs("x")


@pytest.mark.parametrize("condition", ["index = 0", "hash IN ({0}, {1})", "NOT (index = 0 AND parents_count = 1)", "reference_name = 'HEAD' OR index > 2", "reference_name <=> 'HEAD'", "message LIKE '%fix%'", "index < 2 AND parents_count >= 1", "index <= 1", "index < 0", "index IN (1, 3)", "index <= 2 AND index < 2 AND hash IS NOT NULL"])
def test_pushed_filters_change_nothing(condition, engine, repositories):
    hashes = [f"'{h}'" for h in repositories[1]("rev-list", "master").split()[:2]]
    commits = engine.table("commits")
    whole = commits.cache()
    pushed = engine._git("commits").filter(condition.format(*hashes)).select("repository_id", "reference_name", "index", "hash")
    assert sorted(pushed.collect()) == sorted(whole.filter(condition.format(*hashes)).select("repository_id", "reference_name", "index", "hash").collect())
    whole.unpersist()


def test_sql(engine, spark):
    engine.from_repositories()
    assert spark.sql("SELECT count(*) FROM commits WHERE index = 0").first()[0] == spark.sql("SELECT count(DISTINCT repository_id, reference_name) FROM commits").first()[0]


def test_bare(spark, repositories):
    bare = Engine(spark, str(repositories[0] / "bare"), "bare")
    assert [(r["path"], bytes(r["content"])) for r in bare.repositories.references.ref("refs/heads/master").blobs.collect()] == [("hello.sh", b"hello\n")]


def test_errors(spark, tmp_path, repositories):
    import shutil

    with pytest.raises(ValueError, match="not supported"):
        Engine(spark, str(tmp_path), "nonsense")
    shutil.copytree(repositories[0] / "standard/bucket/two", tmp_path / "two")
    shutil.copytree(repositories[0] / "standard/one", tmp_path / "one")
    tree = repositories[2]("rev-parse", "HEAD^{tree}")
    (tmp_path / "two/.git/objects" / tree[:2] / tree[2:]).unlink()
    broken = Engine(spark, str(tmp_path))
    with pytest.raises(Exception, match="remotes https://gitlab.com/team/two.git"):
        broken.repositories.references.blobs.count()
    assert {r["repository_id"] for r in broken.skip_read_errors(True).repositories.references.blobs.collect()} == {ONE, f"file://{tmp_path}/one"}
    with pytest.raises(ValueError):
        broken.save_metadata(str(tmp_path / "missing"))


def test_errors_end_only_what_they_belong_to(spark, tmp_path, repositories):
    """Without the tree of one commit, the other commits of its reference stay, and so do the other references."""
    import shutil

    one = repositories[1]
    shutil.copytree(repositories[0] / "standard/one", tmp_path / "one")
    log = one("rev-list", "master").split()
    tree = one("rev-parse", f"{log[2]}^{{tree}}")
    (tmp_path / "one/.git/objects" / tree[:2] / tree[2:]).unlink()
    broken = Engine(spark, str(tmp_path), skip_read_errors=True)
    entries = broken.repositories.references.ref("refs/heads/master").all_reference_commits.tree_entries
    lost = {h for h in log if one("rev-parse", f"{h}^{{tree}}") == tree}
    assert {r["commit_hash"] for r in entries.select("commit_hash").distinct().collect()} == set(log) - lost and 0 < len(lost) < len(log)
    assert broken.repositories.references.all_reference_commits.count() == Engine(spark, str(repositories[0] / "standard")).repositories.references.all_reference_commits.filter(F.col("repository_id").endswith("/one")).count()

    blob = one("rev-parse", "master:doc/readme.md")
    (tmp_path / "one/.git/objects" / blob[:2] / blob[2:]).unlink()
    paths = {r["path"] for r in broken.repositories.references.ref("refs/heads/master").blobs.collect()}
    assert "doc/readme.md" not in paths and "a.py" in paths  # a blob that is missing has no row
    with pytest.raises(Exception, match="is missing"):
        Engine(spark, str(tmp_path)).table("tree_entries").count()


def test_union_keeps_every_commit_reachable(backend):
    """Entries of newest commits together with older ones, on both backends."""
    references = backend.repositories.filter(F.col("id").startswith("file") & F.col("id").endswith("/one")).references.ref("refs/heads/master")
    newest, every = references.commits, references.all_reference_commits
    older = every.filter("index > 0")
    want = every.tree_entries.count()
    assert newest.tree_entries.count() < want
    assert newest.union(older).tree_entries.count() == newest.unionByName(older).tree_entries.count() == older.unionAll(newest).tree_entries.count() == want
    assert newest.union(older.df).tree_entries.count() == newest.transform(lambda d: d.union(older.df)).tree_entries.count() == want
    assert newest.union(newest).distinct().tree_entries.count() == newest.tree_entries.count()
    side = backend.repositories.references.ref("refs/heads/side").commits
    both = newest.union(side).all_reference_commits
    assert {r["reference_name"] for r in both.collect()} == {"refs/heads/master", "refs/heads/side"} and both.count() == every.count() + side.all_reference_commits.count()
    entries = newest.tree_entries.union(older.tree_entries)
    assert entries.blobs.select("commit_hash").distinct().count() == every.count()


def scans(frame):
    return frame._jdf.queryExecution().optimizedPlan().toString().count("RelationV2")


def test_a_filtered_chain_is_one_scan(engine, repositories):
    """Conditions on several levels in one scan, with the rows that joins give."""
    def chain(f):
        repos = f(engine.repositories).filter("NOT is_fork").filter(F.col("id").startswith("file"))
        refs = repos.references.filter(~F.col("is_remote")).where("name LIKE 'refs/heads/%'")
        commits = refs.all_reference_commits.filter("index < 3").filter(F.col("parents_count") < 2)
        return [repos.references, refs.ref("refs/heads/master"), refs.commits, commits, commits.tree_entries, commits.tree_entries.filter("path LIKE '%.py'").blobs, refs.blobs, repos.head_ref.commits.tree_entries]

    plain = chain(lambda r: r.hint("broadcast"))  # no longer only filtered: joins
    for one, joined in zip(chain(lambda r: r), plain, strict=True):
        assert scans(one) == 1 < scans(joined) or one.columns == ["id", "urls", "is_fork", "repository_path"]
        assert one.columns == joined.columns and sorted(map(str, one.collect())) == sorted(map(str, joined.collect())) != []
    refs = engine.repositories.references
    bound = refs.filter(refs["name"] == "HEAD").commits  # a condition that belongs to one frame
    assert {r["reference_name"] for r in bound.collect()} == {"HEAD"}


def test_splits_and_session_configuration(spark, repositories, tmp_path):
    path = str(repositories[0] / "standard")
    whole = Engine(spark, path)
    split = Engine(spark, path, splits=3)
    for level in ("repositories", "references", "commits", "tree_entries", "blobs"):
        rows = lambda e: sorted(map(str, e.table(level).collect()))  # noqa: E731, B023
        assert rows(split) == rows(whole)
    assert split.table("commits").rdd.getNumPartitions() == 3 * whole.table("commits").rdd.getNumPartitions()
    spark.conf.set("quarryline.repository.format", "bare")
    spark.conf.set("quarryline.read.errors.skip", "true")
    try:
        told = Engine(spark, str(repositories[0] / "bare"))
        assert told.format == "bare" and told._skip_read_errors and not Engine(spark, path, "standard", skip_read_errors=False)._skip_read_errors
        assert told.repositories.count() == 1
    finally:
        spark.conf.unset("quarryline.repository.format")
        spark.conf.unset("quarryline.read.errors.skip")


def test_large_blobs_are_cut(tmp_path, repositories):
    from quarryline.sources import repository as r
    from tests.conftest import Git

    git = Git(tmp_path / "large")
    data = bytes(range(1, 256)) * (r.MOST_BYTES // 255 + 5000)
    git.commit("large", data=data, zero=b"x" * r.SNIFFED + b"\0", early=b"x" * (r.SNIFFED - 1) + b"\0")
    with r.Repository(str(tmp_path / "large"), str(tmp_path / "large/.git")) as found:
        hashes = dict(found.entries("HEAD"))
        assert found.blob(hashes["data"]) == {"content": data[: r.MOST_BYTES], "is_binary": False}
        assert not found.blob(hashes["zero"])["is_binary"] and found.blob(hashes["early"]) == {"content": b"", "is_binary": True}
        assert found.blob("0" * 40) is None and found.blob(hashes["zero"])["content"] == b"x" * r.SNIFFED + b"\0"


def test_snapshots_are_switched_as_a_whole(spark, repositories, tmp_path):
    engine = Engine(spark, str(repositories[0] / "standard"))
    first = engine.save_metadata(str(tmp_path))
    second = engine.save_metadata(str(tmp_path))
    assert first != second and len([p for p in (tmp_path / "metadata").iterdir() if p.name.startswith("snapshot")]) == 1
    n = engine.table("commits").count()
    assert engine.from_metadata(str(tmp_path)).table("commits").count() == n
    engine.from_repositories()
    with pytest.raises(ValueError, match="no snapshot"):
        engine.from_metadata(str(tmp_path), "other")


def test_frames_keep_their_verbs(engine):
    refs = engine.repositories.references
    for frame in (refs.filter("is_remote"), refs.sort("name"), refs.limit(3), refs.distinct(), refs.union(refs), refs.alias("x"), refs.where("true"), refs.withColumn("k", F.lit(1)), refs.sample(0.5), refs.hint("broadcast"), refs.dropDuplicates(["name"])):
        assert type(frame) is type(refs) and callable(frame.ref)
    assert isinstance(refs.randomSplit([0.5, 0.5], 1)[0], type(refs))
    with pytest.raises(ValueError, match="lacks hash"):
        engine.repositories.references.commits.drop("hash").tree_entries  # noqa: B018


def test_languages_and_trees(engine):
    tips = engine.repositories.references.ref("refs/heads/side").commits.tree_entries.blobs
    lang = {r["path"]: r["lang"] for r in tips.classify_languages().collect()}
    assert lang["a.py"] == "Python" and lang["b.rb"] == "Ruby" and lang["doc/readme.md"] == "Markdown" and lang["bin/data"] is None
    found = tips.classify_languages().extract_uasts().query_uast("//*[@roleIdentifier and not(@roleIncomplete)]").extract_tokens()
    tokens = {r["path"]: r["tokens"] for r in found.collect()}
    assert sorted(tokens["a.py"]) == sorted(["json", "open", "path", "source", "rows", "load", "json", "source"]) and tokens["b.rb"] == [] and tokens["doc/readme.md"] == []
    with pytest.raises(ValueError, match="already has"):
        found.query_uast("//*")
