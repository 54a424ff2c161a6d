"""Column functions and trees by themselves."""

from xml.etree import ElementTree as ET

import pytest
from hypothesis import given
from hypothesis import strategies as st

from quarryline.functions import languages, register, scalar, uast
from quarryline.sources.identity import id_of_urls

FILES = [
    ("f01", False, "app/main.py", b"from sys import argv\nprint(argv)\n", "Python"),
    ("f02", False, "lib/Shape.java", b"class Shape {}\n", "Java"),
    ("f03", False, "cmd/run.go", None, "Go"),
    ("f04", False, "tools/start", b"#! /usr/bin/python3\nimport os\n", "Python"),
    ("f05", False, "tools/serve", b"#!/usr/bin/env node\nserve()\n", "JavaScript"),
    ("f06", False, "notes", b"nothing tells\n", None),
    ("f07", False, "empty-content", None, None),
    ("f08", True, "img/logo.py", b"\x89\x00\x00", None),
    ("f09", None, "Makefile", b"all:\n", "Makefile"),
    ("f10", False, "a.b/c", b"x", None),
    ("f11", False, "UPPER.PY", b"x = 1\n", "Python"),
    ("f12", False, None, b"#!/bin/sh\n", "Shell"),
]


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame([f[:4] for f in FILES], "file_hash string, is_binary boolean, path string, content binary")


def test_languages(spark, files):
    want = {f[0]: f[4] for f in FILES}
    assert {r["file_hash"]: r["lang"] for r in languages.classify(files).collect()} == want
    register(spark)
    files.createOrReplaceTempView("files")
    assert {r[0]: r[1] for r in spark.sql("SELECT file_hash, classifyLanguages(is_binary, path, content) FROM files").collect()} == want
    row = spark.sql("SELECT size(extractUASTs(path, content, 'Python')) a, extractTokens(queryXPath(extractUASTs(path, content, 'Python'), '//Call/Name')) b, concatArray(array('x', 'y'), '|') c FROM files WHERE file_hash = 'f01'").first()
    assert row["a"] == 1 and row["b"] == ["print", "argv"] and row["c"] == "x|y"
    with pytest.raises(ValueError, match="lacks"):
        languages.classify(files.drop("path"))


def test_xpath():
    root = ET.fromstring("<a><b x='1' y='2'><c x='1'/></b><c y='3'/></a>")
    tags = lambda q: [e.tag for e in uast.xpath(root, q)]
    assert tags("//c") == ["c", "c"] and tags("/a/c") == ["c"] and tags("/*") == ["a"] and tags("//*[@x and not(@y)]") == ["c"]
    assert tags("//*[@y='3' or @y='2']") == ["b", "c"] and tags("//b[@x]//c") == ["c"] and tags("/*[not(@x)]") == ["a"]
    assert tags("//*[not(@x or @y) or (@x and @y='2')]") == ["a", "b"] and tags("//c[@x][@x='1']") == ["c"] and tags("//*[@x='2']") == []
    for bad in ("a", "", "//*[]", "//*[@x and]", "//*[not @x]", "//*[(@x]", "//*[@x @y]", "//a[1]", "//a[f()]", "//*[@x"):
        with pytest.raises((ValueError, SyntaxError)):
            uast.xpath(root, bad)


def test_trees_of_odd_files():
    assert uast.parse("a.py", b"", "Python") == [] and uast.parse("a.py", None, "Python") == [] and uast.parse("a.md", b"# x", "Markdown") == []
    assert uast.parse("a.py", b"def (", "Python") == [] and uast.parse("a.py", b"x = 1", None) and uast.parse("x", b"#!/usr/bin/python\nx", None)
    assert uast.parse("a.py", b"x = '" + b"\\x01" + b"'", "Python") and uast.node_tokens(None) == [] and uast.query_nodes(None, "//*") is None
    deep = uast.parse("i.html", b"<b>" * 5000 + b"x", "HTML")
    assert uast.node_tokens(uast.query_nodes(deep, "//b/text")) == ["x"] and len(uast.query_nodes(deep, "/Document/b/b/b/b")) == 1  # no level is lost
    odd = uast.parse("a.py", "x = '<\"&\\'>\\t\\r\\n é'\n".encode(), "Python")
    assert uast.node_tokens(uast.query_nodes(odd, "//Constant")) == ["<\"&'>\t\r\n é"] == [ET.fromstring(uast.query_nodes(odd, "//Constant")[0]).get("token")]
    assert b"token=\"p\"" in uast.parse("i.html", b"<html><p>x<br><b>y", "HTML")[0]


@given(st.lists(st.one_of(st.from_regex(r"[a-z]{1,5}@[a-z]{1,5}\.com:[a-z]{1,4}/[a-z]{1,4}(\.git)?", fullmatch=True), st.from_regex(r"https?://[a-z]{1,5}\.com/[a-z]{1,4}(\.git)?", fullmatch=True), st.sampled_from(["", "nonsense", "/local/path"])), max_size=3))
def test_ids_of_urls(urls):
    ids = [i for i in (id_of_urls([u]) for u in urls) if i]
    assert id_of_urls(urls) == min(ids, default=None)


def test_repository_id_column_equals_the_rule(spark):
    urls = [["git@github.com:git/repo.git", "https://b.com/x.git"], ["https://user@a.com:80/p/q.git?x=1"], ["nonsense"], [], ["ssh://git@h.com/p.git"]]
    df = spark.createDataFrame([(u,) for u in urls], "urls array<string>")
    assert [r[0] for r in df.select(scalar.repository_id(df["urls"])).collect()] == [id_of_urls(u) for u in urls]
