"""The language of a file by its name, its first line or its content, as one expression without Python on its path."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Languages by file name, by extension and by interpreter.
NAMES = {"Makefile": "Makefile", "Dockerfile": "Dockerfile", "Rakefile": "Ruby", "Gemfile": "Ruby", "CMakeLists.txt": "CMake", "Jenkinsfile": "Groovy", "BUILD": "Python", "go.mod": "Go"}
EXTENSIONS = {
    "py": "Python", "java": "Java", "go": "Go", "rb": "Ruby", "md": "Markdown", "markdown": "Markdown", "yml": "YAML", "yaml": "YAML", "html": "HTML", "htm": "HTML", "js": "JavaScript",
    "ts": "TypeScript", "c": "C", "h": "C", "cc": "C++", "cpp": "C++", "hpp": "C++", "cs": "C#", "rs": "Rust", "scala": "Scala", "sbt": "Scala", "kt": "Kotlin", "php": "PHP", "pl": "Perl",
    "sh": "Shell", "bash": "Shell", "sql": "SQL", "css": "CSS", "scss": "SCSS", "json": "JSON", "xml": "XML", "txt": "Text", "rst": "reStructuredText", "swift": "Swift", "lua": "Lua", "r": "R",
    "hs": "Haskell", "clj": "Clojure", "ex": "Elixir", "erl": "Erlang", "ml": "OCaml", "proto": "Protocol Buffer", "gradle": "Gradle", "toml": "TOML", "ini": "INI", "csv": "CSV", "tex": "TeX",
}
INTERPRETERS = {"python": "Python", "python2": "Python", "python3": "Python", "ruby": "Ruby", "node": "JavaScript", "bash": "Shell", "sh": "Shell", "zsh": "Shell", "perl": "Perl", "php": "PHP", "lua": "Lua"}


def _map(entries: dict[str, str]) -> str:
    return f"map({', '.join(f'{chr(39)}{x}{chr(39)}' for x in chain.from_iterable(entries.items()))})"


def language_sql(is_binary: str, path: str, content: str) -> str:
    """The expression in SQL. Null for binary files and for what nothing tells; a null content is judged by its path alone."""
    name = f"element_at(split({path}, '/'), -1)"
    first = f"decode(substring({content}, 1, 200), 'ISO-8859-1')"
    shebang = r"'^#!\\s*(?:\\S*/)?(?:env\\s+)?([A-Za-z]+[23]?)'"
    told = ", ".join((
        f"try_element_at({_map(NAMES)}, {name})",
        f"try_element_at({_map(EXTENSIONS)}, lower(regexp_extract({name}, '\\\\.([^.]+)$', 1)))",
        f"try_element_at({_map(INTERPRETERS)}, coalesce(regexp_extract({first}, {shebang}, 1), ''))",
    ))
    return f"CASE WHEN NOT coalesce({is_binary}, false) THEN coalesce({told}) END"


def classify(df: DataFrame) -> DataFrame:
    """df with a column lang."""
    if missing := [c for c in ("is_binary", "path", "content") if c not in df.columns]:
        raise ValueError(f"classify_languages can not be applied: the frame lacks {', '.join(missing)}")
    return df.withColumn("lang", F.expr(language_sql("is_binary", "path", "content")))


def register(spark: SparkSession) -> None:
    body = language_sql("is_binary", "path", "content")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION classifyLanguages(is_binary BOOLEAN, path STRING, content BINARY) RETURNS STRING RETURN {body}")
