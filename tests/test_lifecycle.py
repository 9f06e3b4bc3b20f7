"""Whole runs, models and their failures, configurations, the shared folder."""

import json

import pytest
from pyspark.sql import functions as F

from skeinflow.functions import vector as V
from skeinflow.functions.json import extracted_item, normalise_content, normalise_item
from skeinflow.operators import frontier, judging, lifecycle, routing
from skeinflow.plans import catalog
from skeinflow.plans import fixtures as X
from skeinflow.plans import lifecycle as plans
from skeinflow.sources import models, storage, tables
from skeinflow.streaming import stateful


def test_normalise_item():
    assert normalise_item(["plain", {"topic": "", "title": "t"}, {"summary": None}, [42], {"title": "x", "content": "c", "source": 5}]) == [
        ("Extracted information", "plain", None), ("", "", None), ("Content", "None", None), ("Content", "42", None), ("x", "c", "5"),
    ]
    assert normalise_item({"summary": [{"summary": ["a", {"summary": "b"}]}, {"content": "c"}, "d"]}) == [("Content", "a b c d", None)]


def test_extracted_item():
    blocks = [{"error": False, "topic": "t", "summary": "s"}, {"error": True, "topic": "no"}, {"topic": "no error told"}, "text", [{"summary": 1}, 2, {"topic": "x"}], {"error": False}]
    assert extracted_item(blocks) == [("t", "s", None), ("Content", "text", None), ("Information", "1", None), ("Content", "2", None), ("x", "{'topic': 'x'}", None), ("Information", "{'error': False}", None)]
    assert extracted_item({"error": False}) == extracted_item(None) == extracted_item("x") == []


def test_extracted_column(spark):
    df = spark.createDataFrame([(1, '[{"error": false, "topic": "t", "summary": "s"}, "u"]'), (2, "junk"), (3, None)], "i int, content string")
    got = normalise_content(df, "content", "i", items=extracted_item).collect()
    assert sorted((r["i"], r["ord"], r["topic"], r["summary"]) for r in got) == [(1, 0, "t", "s"), (1, 1, "Content", "u")]


def test_requests():
    url, body = models.request("llamacpp/m", "http://h:1/v1/", "p", "s", max_tokens=5, stop=[], seed=None)
    assert url == "http://h:1/v1/chat/completions" and body["max_tokens"] == 5 and "stop" not in body and "seed" not in body
    assert body["model"] == "m" and body["cache_prompt"] and body["chat_template_kwargs"] == {"enable_thinking": False}
    url, body = models.request("m", "http://ollama.example", "p", "s", max_tokens=5, response_format={"type": "json_object"}, extra={"options": {"num_ctx": 9}, "keep_alive": 1})
    assert url.endswith("/api/generate") and body["options"] == {"temperature": 0.0, "num_predict": 5, "think": False, "num_ctx": 9} and body["format"] == "json" and body["keep_alive"] == 1
    assert models.request("m", "http://h", "p", "s", chat=False)[1]["prompt"] == "s\n\np"
    assert [models.backend_of(m, u) for m, u in (("llamacpp/x", "http://ollama"), ("x", "http://h:11434/v1"), ("x", "http://h"))] == ["llamacpp", "ollama", "openai"]
    for bad in ({"model": ""}, {"backend": "other"}, {"unknown": 1}):
        with pytest.raises(models.ConfigError):
            models.request(**({"model": "m", "base_url": "http://h", "prompt": "p"} | bad))


def test_answers():
    one = lambda message: {"choices": [{"message": message, "finish_reason": "stop"}], "usage": {"prompt_tokens": 1, "completion_tokens": 2}}
    assert models.answer_of(one({"content": "a"}), "openai") == models.Answer("a", "stop", 1, 2) and models.answer_of(one({"content": "a"}), "openai").tokens == 3
    assert models.answer_of(one({"content": "", "reasoning_content": " r "}), "openai").text == "r"
    assert models.answer_of({"response": "x", "done_reason": "length"}, "ollama") == models.Answer("x", "length")
    assert models.answer_of({"choices": [{"text": "t"}]}, "openai", chat=False).tokens is None
    for empty in ({}, {"choices": []}, one({})):
        with pytest.raises(models.EmptyAnswer):
            models.answer_of(empty, "openai")
    with pytest.raises(RuntimeError, match="out of memory"):
        models.answer_of({"error": "out of memory"}, "ollama")


def test_retries():
    waits, errors = [], [TimeoutError(), models.HTTPFailure(503), models.HTTPFailure(429)]

    def call():
        if errors:
            raise errors.pop()
        return "done"

    assert models.with_retries(call, 4, 2.0, sleep=waits.append, spread=lambda: 0.5) == "done" and waits == [2.0, 4.0, 8.0]
    for error, again in ((models.HTTPFailure(404), False), (models.ConfigError(), False), (models.EmptyAnswer(), True), (ConnectionError(), True), (KeyError(), False), (RuntimeError(), True)):
        assert models.is_retryable(error) is again
    assert not models.is_retryable(models.EmptyAnswer(), on_empty=False)
    errors = [TimeoutError()] * 5
    with pytest.raises(TimeoutError):
        models.with_retries(call, 9, 2.0, deadline=3.0, sleep=waits.append, clock=lambda: 0.0, spread=lambda: 1.0)
    score = models.model(lambda url, body: {"choices": [{"message": {"content": body["messages"][1]["content"][::-1]}}]} if "bad" not in str(body) else {}, "m", "http://h", attempts=1)
    assert score(["abc", "bad"]) == ["cba", None]


def test_plugins(spark):
    df = spark.createDataFrame([(1, "a b c"), (2, None)], "i int, text string")
    made = {r["i"]: r for r in models.embed(df, "text", models.hashing_encoder(8)).collect()}
    assert sum(map(abs, made[1]["embedding"])) == 3 and not any(made[2]["embedding"])
    assert [r["tokens"] for r in models.count_tokens(df, "text", lambda: lambda texts: [len(t.split()) for t in texts]).orderBy("i").collect()] == [3, 0]
    with pytest.raises(Exception, match="no model"):
        models.embed(df, "text", lambda: (_ for _ in ()).throw(OSError("no model"))).collect()


def test_expert_config(spark):
    config = tables.ExpertConfig(spark)
    assert [r["id"] for r in config.rows.orderBy("ord").collect()][0] == "experto-en-neovim" and config.rows.count() == 4
    assert not config.load("junk") and not config.load("[]") and not config.load('[{"id": "x"}]') and config.rows.count() == 4
    assert config.load('[{"id": "a", "name": "A", "keywords": ["k"]}]') and config.rows.count() == 1
    assert not config.load('[{"id": "a", "name": "A", "keywords": ["k"]}]')


def test_search_source_in_stretches(spark, tmp_path, monkeypatch):
    lines = [json.dumps({"query": f"q{i}", "engine": "é", "results": [{"url": f"u{i}"}, {"url": "x"}]}) for i in range(50)]
    (tmp_path / "a.jsonl").write_text("\n".join(lines[:30]))
    (tmp_path / "b.jsonl").write_text("\n".join(lines[30:]) + "\n\n")
    monkeypatch.setattr(tables, "STRETCH", 100)
    reader = tables.SearchSource({"path": str(tmp_path), "limit": "1"}).reader(None)
    parts = reader.partitions()
    assert len(parts) > 20 and [r[3] for p in parts for r in reader.read(p)] == [f"u{i}" for i in range(50)]


def test_nearest_in_blocks(spark):
    queries = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(8)] + [(8, None), (9, [0.0, 0.0])], "k long, embedding array<double>")
    examples = spark.createDataFrame([(1, "b", [1.0, 0.0]), (0, "a", [0.0, 1.0]), (2, "c", [0.0, 2.0])], "expert_ord int, expert_id string, embedding array<double>")
    want = {r["k"]: r["expert_id"] for r in routing.by_similarity(queries, examples, "k", threshold=0.5).collect()}
    assert want == {0: "a", 1: "a", **{i: "b" for i in range(2, 8)}, 8: routing.DEFAULT, 9: routing.DEFAULT}
    assert {r["k"]: r["expert_id"] for r in routing.by_similarity(queries, examples, "k", threshold=0.5, block_bytes=1).collect()} == want
    assert {r["expert_id"] for r in routing.by_similarity(queries, examples.limit(0), "k").collect()} == {routing.DEFAULT}


def test_planes_find_similar_pairs(spark):
    import numpy as np

    r = np.random.default_rng(3)
    base = r.standard_normal((120, 32))
    rows = np.concatenate([base, base + 0.3 * r.standard_normal((120, 32))])
    df = spark.createDataFrame([(i, [float(y) for y in x]) for i, x in enumerate(rows)] + [(999, None)], "k long, v array<double>").repartition(3)
    exact = {(x["a"], x["b"]) for x in V.similar_pairs(df.where("v is not null"), "k", "v", 0.9, block=50).collect()}
    found = {(x["a"], x["b"]) for x in V.similar_pairs_by_planes(df, "k", "v", 0.9, block=50).collect()}
    assert found <= exact and len(exact) > 80 and len(found) >= 0.95 * len(exact)
    assert V.similar_pairs_by_planes(df.limit(0), "k", "v", 0.9).count() == 0


def test_memo_evicts_the_oldest(spark):
    asked = spark.createDataFrame([("a",), ("b",), ("b",), ("c",), (None,)], "key string")
    memo = spark.createDataFrame([("a", "1", 95.0), ("b", "2", 90.0), ("z", "3", 99.0)], "key string, value string, ts double")
    made = []

    def compute(keys):
        made.extend(sorted(r["key"] for r in keys.collect()))
        return keys.withColumn("value", F.upper("key"))

    found, after = lifecycle.memoised(asked, memo, "key", "value", compute, F.lit(100.0), 10, size=3)
    assert sorted((r["key"] or "", r["value"], r["hit"]) for r in found.collect() if r["key"]) == [("a", "1", True), ("b", "B", False), ("b", "B", False), ("c", "C", False)]
    assert made == ["b", "c"] and {r["key"] for r in after.collect()} == {"b", "c", "z"}


def test_two_levels_promote(spark):
    keys = spark.createDataFrame([("a",), ("b",), ("c",)], "key string")
    near = spark.createDataFrame([("a", "1", 99.0), ("b", "old", 1.0)], "key string, value string, ts double")
    far = spark.createDataFrame([("a", "far", 99.0), ("b", "2", 98.0), ("c", "x", 1.0)], "key string, value string, ts double")
    found, after = lifecycle.two_levels(keys, near, far, "key", "value", "ts", F.lit(100.0), 10)
    assert sorted(tuple(r) for r in found.select("key", F.coalesce("value", F.lit("-")), "level").collect()) == [("a", "1", "near"), ("b", "2", "far"), ("c", "-", "miss")]
    assert sorted(tuple(r) for r in after.collect()) == [("a", "1", 99.0), ("b", "2", 98.0)]


def test_failed_batches_of_urls_are_kept(spark):
    results = spark.createDataFrame([(f"https://a.com/{'jaguar-car' if i == 3 else i}", i) for i in range(12)], "url string, ord int")
    titles = spark.createDataFrame([("https://a.com/1", "T")], "url string, title string")
    judged = judging.keep_urls(results, titles, F.array(F.lit("Jaguar car")), "q", lambda prompts: ["[0, 5, 40]" if len(plans.lines_of(p)) == 10 else "?" for p in prompts]).orderBy("ord").collect()
    assert [r["decision"] for r in judged] == ["KEEP", "REJECT", "REJECT", "REJECT", "REJECT", "REJECT", "KEEP", *["REJECT"] * 4, "KEEP"]
    assert [r["title"] for r in judged][:2] == ["N/A", "T"]


def test_tool(spark, small):
    run, now = plans.recorded(spark, small), F.lit(plans.NOW)
    assert lifecycle.call_tool(run, {"query": plans.QUERY, "max_results": 3}, now).select("source").distinct().count() <= 3
    edges = X.EDGES.frame(spark)
    tokens = edges.select(F.col("src").alias("url")).union(edges.select("dst")).distinct().withColumn("tokens", F.lit(500))
    mine = {"query": "spark", "urls": ["https://a.com/"], "research_mode": True}
    for mode in frontier.MODES:
        found = lifecycle.call_tool(run, mine | {"research_crawl_mode": mode}, now, edges, tokens)
        assert found.columns == ["url", "depth", "score", "step"] and "https://a.com/" in {r["url"] for r in found.collect()}
    for bad in ({}, {"query": 1}, {"query": "q", "max_results": 0}, {"query": "q", "max_results": True}, {"query": "q", "other": 1}, {"query": "q", "research_crawl_mode": "x"}, {"query": "q", "research_mode": True}):
        with pytest.raises(ValueError):
            lifecycle.call_tool(run, bad, now)


def test_compressed_inlet(spark):
    rows = [(1, i, "user", "word " * 400 if i == 0 else f"python question {i}") for i in range(8)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = {r["turn"]: r for r in lifecycle.compressed_inlet(turns, tables.experts(spark)).collect()}
    assert len(out[0]["text"]) < 1000 and out[7]["expert"] == "progrmador" and out[0]["changed"] and not out[7]["changed"]


def test_empty_run(spark, small):
    run = plans.recorded(spark, small)
    none = lifecycle.Recorded(run.results.limit(0), run.pages.limit(0), run.cache.limit(0), run.excluded.limit(0))
    assert lifecycle.search_and_crawl(none, "q", F.lit(0.0)).count() == 0
    assert lifecycle.counters(lifecycle.unified_crawl(none.results, none.pages, none.cache, none.excluded, "q", F.lit(0.0))).first()["items"] == 0


def test_streams_that_take_too_long(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "r"))
    slow = spark.readStream.schema("id long").parquet(str(tmp_path / "r"))
    assert sorted(r["id"] for r in stateful.drain(slow, "append").collect()) == [0, 1, 2]
    with pytest.raises(TimeoutError):
        stateful.drain(slow.where(F.expr("reflect('java.lang.Thread', 'sleep', id * 0 + 4000L) is null")), "append", timeout=0.5)


def test_shared_folder(spark):
    assert all(storage.is_local(m) for m in ("local", "local[4]", "local[*]")) and not any(storage.is_local(m) for m in ("local-cluster[2,1,1024]", "yarn", "spark://h:1"))
    began = storage.mark()
    one, two = storage.materialise(spark.range(3)), storage.materialise(spark.range(4))
    assert storage.sweep(spark, began, keep_last=True) == 1
    assert two.count() == 4
    with pytest.raises(Exception):
        one.collect()
    assert storage.sweep(spark, began) == 1


def test_import_guard(monkeypatch):
    import builtins
    import importlib

    import __spark_entry__ as entry

    real = builtins.__import__

    def missing(name, *args, **kwargs):
        if name == "skeinflow.llm" and args[2] == ("queries",):
            raise ModuleNotFoundError("No module named 'zstandard'", name="zstandard")
        return real(name, *args, **kwargs)

    if entry._llm is not None:
        monkeypatch.setattr(builtins, "__import__", missing)
        with pytest.raises(ModuleNotFoundError, match="zstandard"):
            importlib.reload(entry)
        monkeypatch.undo()
        importlib.reload(entry)


def same_as_sql(spark, folder, name: str, but: tuple[str, ...] = ()) -> list[tuple]:
    """The rows of a query over tables in a folder, sorted, which DuckDB gives too; columns that its SQL leaves open aside."""
    import duckdb

    con = duckdb.connect()
    for path in folder.glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}/*.parquet'")
    df = catalog.QUERIES[name](spark, str(folder))
    assert sorted(df.columns) == sorted(con.execute(f"DESCRIBE {catalog.ORACLES[name]}").df()["column_name"])
    columns = [c for c in df.columns if c not in but]
    got = sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({catalog.ORACLES[name]})").fetchall()
    assert got == sorted(want, key=repr)
    return got


@pytest.fixture
def twice_recorded(spark, tmp_path):
    """A table of pages of which some share a URL: cached and not, cached twice, excluded and not, never cached, in the first batches and later."""
    shared = {4: "a", 7: "a", 12: "b", 28: "b", 9: "c", 13: "c", 102: "d", 103: "d", 19: "e", 29: "e", 20: "f", 21: "f", 36: "f", 83: "g", 81: "g"}
    page = lambda i: f"<html><title>T{i}</title><body>{'reation ' * (i % 3)}{f'page {i} ' * (20 if i in (28, 36) else 150)}</body></html>"
    rows = [(i, f"https://a.com/{shared.get(i, i)}", page(i)) for i in range(120)]
    spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3).write.parquet(f"{tmp_path}/pages.parquet")
    return tmp_path


def test_counters_of_urls_recorded_twice(spark, twice_recorded):
    assert same_as_sql(spark, twice_recorded, "crawl_counters")[0][1] > 0
    assert len(same_as_sql(spark, twice_recorded, "crawl_batches")) == 12


def test_citations_of_urls_recorded_twice(spark, twice_recorded):
    assert len(same_as_sql(spark, twice_recorded, "crawl_citations")) > 60


def test_citations_are_placed_by_ord_and_named_by_part(spark):
    items = spark.createDataFrame([(1, 2, "late", "a2", "a"), (3, 1, "first", "a1", "a"), (1, 1, "t", "b1", "b")], "ord int, part int, topic string, summary string, source string")
    assert [tuple(r) for r in lifecycle.citations(items).orderBy("position").collect()] == [(0, "a", "first", "a2\n\na1"), (1, "b", "t", "b1")]


def test_items_of_urls_recorded_twice(spark, twice_recorded):
    """All but the parts of chunks of equal score and index, which the SQL leaves open: these go by ord, then record."""
    same_as_sql(spark, twice_recorded, "unified_crawl", but=("part",))
    of = lambda url: sorted((r["part"], r["ord"], r["summary"].split()[-2:][-1]) for r in catalog.QUERIES["unified_crawl"](spark, str(twice_recorded)).where(F.col("source") == url).collect())
    assert [x[:2] for x in of("https://a.com/a")] == [(1, 4), (2, 7), (3, 4), (4, 7)]
    assert of("https://a.com/b") == [(1, 12, "28"), (2, 28, "28"), (3, 12, "12"), (4, 28, "12"), (5, 12, "12"), (6, 28, "12")]


def test_items_are_those_of_the_sql_with_its_orders_completed(spark, twice_recorded):
    """All columns, on a table where rows repeat a record too, with its own text or another, cached and crawled."""
    import duckdb

    other = lambda i: f"<html><title>U{i}</title><body>{f'the other {i} ' * 70}{f'of thention {i} ' * 90}</body></html>"
    again = spark.read.parquet(f"{twice_recorded}/pages.parquet").where("page_id IN (7, 9, 20, 28, 30)").collect()
    rows = [tuple(r) for r in again] + [(i, f"https://a.com/{u}", other(i)) for i, u in ((4, "a"), (12, "b"), (20, "f"), (21, "f"), (6, 6), (44, 44), (44, "g"))]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.mode("append").parquet(f"{twice_recorded}/pages.parquet")
    sql = catalog.ORACLES["unified_crawl"]
    for told, more in (("hits AS (SELECT url, ", "page_id, "), ("k FROM (SELECT url, ", "page_id, "), ("ORDER BY score DESC, k", ", ord, page_id, chunk"), ("OVER (ORDER BY ord, url", ", page_id, html NULLS FIRST")):
        assert sql.count(told) == 1
        sql = sql.replace(told, told + more)
    df = catalog.QUERIES["unified_crawl"](spark, str(twice_recorded))
    want = duckdb.connect().execute(f"WITH pages AS (SELECT * FROM '{twice_recorded}/pages.parquet/*.parquet') SELECT {', '.join(df.columns)} FROM ({sql})").fetchall()
    assert sorted((tuple(r) for r in df.collect()), key=repr) == sorted(want, key=repr)


def test_titles_of_urls_recorded_twice(spark, twice_recorded):
    got = same_as_sql(spark, twice_recorded, "titled_urls")
    assert [t for u, t in got if u == "https://a.com/f"] == ["N/A", "page 20", "page 36"]


def test_rounds_of_urls_recorded_twice(spark, twice_recorded):
    got = same_as_sql(spark, twice_recorded, "refined_rounds")
    assert [r for u, r in got if u == "https://a.com/b"] == [0, 1]


def test_streams_of_tables_in_folders(spark, tmp_path):
    """Several files, turns out of order in pieces of three rows, and blanks that are none to SQL."""
    words = ["one two", "one two three", "one\xa0two", "one two\x0bthree", "four", "four five ΣΑΣ", "ΣΑΣ four", "six", "one four", ""]
    rows = [(c, t, "user" if t % 4 else "assistant", None if t == 9 else words[(3 * t + c) % 10]) for c in range(5) for t in reversed(range(24))]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        assert len(same_as_sql(spark, tmp_path, "stream_sticky")) == 85
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
