"""Small inline tables, the same for Spark and for SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def quoted(value: object) -> str:
    if value is None:
        return "NULL"
    return str(value) if isinstance(value, int | float) else "'" + str(value).replace("'", "''") + "'"


class Fixture:
    """Rows with column names; types by Spark DDL."""

    def __init__(self, ddl: str, rows: list[tuple]) -> None:
        self.ddl, self.rows = ddl, rows
        self.names = [c.split()[0] for c in ddl.split(",")]

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, self.ddl)

    @property
    def sql(self) -> str:
        values = ", ".join("(" + ", ".join(map(quoted, r)) + ")" for r in self.rows)
        return f"(VALUES {values}) AS t({', '.join(self.names)})"


URLS = Fixture(
    "ord int, url string",
    list(
        enumerate(
            [
                "https://example.com/", "https://www.facebook.com/a", "http://m.x.com/b", "https://xx.com/b", "https://example.com/style.css", "https://example.com/page.html?x=1", "https://example.com/feedback",
                "https://en.wikipedia.org/wiki/Spark", "https://en.wikipedia.org/wiki/A", "https://en.wikipedia.org/w/index.php?title=A", "https://en.m.wikipedia.org/wiki/Spark", "https://en.wikipedia.org/wiki/Help:Contents",
                "https://www.reddit.com/r/a/comments/1", "https://old.reddit.com/x", "https://github.com/a/b", "https://github.com/a/b/issues/1", "https://github.com/a/b/blob/main/readme.md", "https://gitlab.com/a/b/-/blob/main/x.py",
                "https://gitlab.com/a/b/-/raw/main/x", "https://bitbucket.org/a/b/raw/1/x", "https://raw.githubusercontent.com/a/b/x.txt", "https://pastebin.com/raw/abc", "https://dpaste.com/ABC", "https://codeberg.org/a/b/x.rs", "https://codeberg.org/a/b",
                "https://example.com/a?ref=1", "https://example.com/a?x=1&ref=1", "https://example.com/a?" + "&".join(f"p{i}=1" for i in range(10)), "https://example.com/a?" + "&".join(f"p{i}=1" for i in range(11)),
                "https://example.com/" + "a" * 480, "https://example.com/" + "a" * 481, "javascript:void(0)", "mailto:a@example.com", "", "https://user@Example.com:8080/Path/File.PHP#top", "//cdn.example.com/x.png", "/rooted/path", "https://example.com/data.tar.gz",
                "https://example.com/my-slug_here/x", "https://example.com/apache-spark/guide", "https://example.com/a%20b/c+d.txt", "https://GitHub.com/A/B/blob/v1/dir/f.py",
            ]
        )
    ),
)
WIKI = Fixture(
    "ord int, url string, title string",
    [
        (0, "https://en.wikipedia.org/wiki/Apache_Spark", "a"), (1, "https://es.wikipedia.org/wiki/Apache_Spark", "b"), (2, "https://example.com/x", "c"), (3, "https://fr.wikipedia.org/wiki/Caf%C3%A9", "d"), (4, "https://es.wikipedia.org/wiki/Caf%C3%A9#top", "e"),
        (5, "https://de.wikipedia.org/wiki/C%2B%2B", "f"), (6, "https://en.wikipedia.org/wiki/C++?x=1", "g"), (7, "https://fr.wikipedia.org/wiki/Apache_Spark/", "h"), (8, "https://example.com/y", "i"),
    ],
)
EDGES = Fixture(
    "src string, dst string, ord int",
    [
        ("https://a.com/", "https://a.com/spark-guide", 0), ("https://a.com/", "https://a.com/about", 1), ("https://a.com/", "https://b.com/spark", 2), ("https://a.com/spark-guide", "https://a.com/spark-sql", 0), ("https://a.com/spark-guide", "https://a.com/", 1),
        ("https://a.com/about", "https://a.com/team", 0), ("https://a.com/about", "https://a.com/spark-sql", 1), ("https://b.com/spark", "https://b.com/spark/streaming", 0), ("https://a.com/spark-sql", "https://a.com/spark-sql-deep", 0), ("https://a.com/spark-sql-deep", "https://a.com/spark-deeper", 0),
    ],
)
THINK = Fixture("id int, text string", [(0, "<think>x</think> a"), (1, "a <think>b\nc</think>\n d <think>e</think>f"), (2, "<think>only</think>"), (3, "<think>open a"), (4, "plain"), (5, "")])
CODE = Fixture(
    "id int, text string",
    [
        (0, "Look:\n```python\nclass A:\n    def inner(self): pass\ndef f():\n    pass\n```\nthen\n```\nplain\n```"), (1, "open\n```js\nconsole.log(1)"), (2, "no code"), (3, "```python\nasync def g():\n    pass\n```"), (4, ""),
    ],
)
CONTENT = Fixture(
    "id int, content string",
    [
        (0, '{"topic": "A", "summary": "s"}'), (1, '[{"title": "B", "content": "c"}, "text", {"summary": ["x", ["y", "z"]]}]'), (2, '"just text"'), (3, "not json"), (4, None), (5, "42"), (6, '[{"topic": "T", "summary": {"content": "nested"}, "source": "u"}]'),
    ],
)
MEDIA = Fixture(
    "ord int, base string, src string, score double",
    [
        (0, "https://a.com/p", "//cdn.a.com/1.png", 6.0), (1, "https://a.com/p", "/img/2.png", 7.0), (2, "https://a.com/p", "img/3.png?x=1", 5.0), (3, "https://a.com/p", "https://a.com/img/2.png?w=100", 9.0), (4, "https://a.com/p", "https://b.com/a b.png", 6.5), (5, "https://a.com/p", "", 9.0),
    ],
)
OPERATIONS = Fixture(
    "cache string, ord bigint, op string, key string, value string, ts double",
    [
        ("c", 0, "put", "a", "1", 0.0), ("c", 1, "put", "b", "2", 1.0), ("c", 2, "get", "a", None, 2.0), ("c", 3, "put", "d", "3", 3.0), ("c", 4, "get", "b", None, 4.0), ("c", 5, "get", "a", None, 10.0), ("c", 6, "get", "a", None, 10.5), ("c", 7, "get", "d", None, 11.0), ("e", 0, "get", "a", None, 0.0),
    ],
)
