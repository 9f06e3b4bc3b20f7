"""The pipeline's stages against the operators' brute-force versions, each on its own input, and on awkward ones."""

import random

import pytest
from pyspark.sql import functions as F
from test_operators_llm import DDL, awkward, brute_components, words

from skeinflow.llm import decontamination, line_dedup, near_dedup, quality_rules, queries, source_mixing
from skeinflow.llm._shared import materialise, table


def spelled(rows, gone):
    """(doc_id, text) after line dedup; documents that lose all their words go."""
    for d, t in rows:
        left = None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in set(gone.get(d, [])))
        if d not in gone or left.split():
            yield d, left


def check_stages(spark, docs, folder):
    """Every stage on what the one before kept, against plain loops; gives the counts."""
    import corpus_pipeline as pipeline

    own, counts = docs.columns, [docs.count()]
    for i, (name, stage) in enumerate(pipeline.STAGES):
        came = docs.collect()
        before = [(r["doc_id"], r["text"]) for r in came]
        docs = materialise(stage(spark, docs, folder))
        rows = docs.collect()
        after = sorted((r["doc_id"], r["text"]) for r in rows)
        if i < 4:
            assert docs.columns == own
        if name == "quality_rules":
            good = {r["doc_id"] for r in table(spark, folder, "labels").where("quality = 1").collect()}
            size = spark.createDataFrame([(t,) for _, t in before], "text string")
            scores = quality_rules.score_reference(before, good, quality_rules.bucket_count(size))
            want = [x for x, s in zip(before, scores, strict=True) if not quality_rules.reference(x[1])[5] and s >= quality_rules.THRESHOLD]
            assert all(abs(s - quality_rules.THRESHOLD) > 1e-5 for s in scores)
        elif name == "line_dedup":
            want = list(spelled(before, line_dedup.reference(before)))
        elif name == "near_dedup":
            kept = {r[0] for r in brute_components(before) if r[3]}
            want = [x for x in before if x[0] in kept]
        elif name == "decontamination":
            items = [tuple(r) for r in table(spark, folder, "benchmark").collect()]
            want = [x for x, r in zip(before, decontamination.reference(before, items), strict=True) if not r[5]]
        else:
            size = lambda r: len((r["text"] or "").encode().split())
            assert all(0 < r["taken"] <= 3 * r["size"] == 3 * size(r) for r in rows)
            whole, taken = dict.fromkeys((r["source"] for r in came), 0), dict.fromkeys((r["source"] for r in came), 0)
            for r in came:
                whole[r["source"]] += size(r)
            for r in rows:
                taken[r["source"]] += r["taken"]
            assert all(abs(taken[s] - t) <= 2 * source_mixing.BLOCK + 0.02 * t for s, t in source_mixing.reference(whole).items())
            want = [x for x in before if x in set(after)]
        assert after == sorted(want), name
        counts.append(len(rows))
    return counts


def test_stages(spark, small):
    assert check_stages(spark, table(spark, small, "documents"), small)[-1] > 0


def folder(tmp_path, spark, docs, labels, items):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


CLASH = ["n_words", "n_removed", "n_lines", "quality", "kept", "spans", "items", "gone", "text_hash", "score", "component_id"]


def test_awkward_rows(spark, tmp_path):
    """Nulls, empty, long and repeated texts, ties, columns with the operators' names."""
    r = random.Random(8)
    texts = [*awkward(), *((100 + i, " ".join(words(50 + i, r.choice([12, 40, 300]), 2000))) for i in range(40)), (200, " ".join(words(60, 40_000, 9000))), (201, None), (202, "x " * 50)]
    rows = [(i, t, None if i % 5 == 0 else "en", None if i % 4 == 0 else f"s{i % 3}", len(t or "")) for i, t in texts]
    docs = spark.createDataFrame(rows, DDL).withColumns({c: F.lit(7) for c in CLASH}).repartition(3)
    d = folder(tmp_path, spark, docs, [(i, 1, 0) for i in range(100, 130)] + [(None, 1, 0), (101, None, 0)], [(1, texts[25][1]), (2, None), (3, ""), (4, "never seen words")])
    counts = check_stages(spark, spark.read.parquet(f"{d}/documents.parquet"), d)
    assert counts[0] > counts[1] >= counts[2] > counts[4] - 1


def test_repeated_ids_and_empty_tables(spark, tmp_path):
    import corpus_pipeline as pipeline

    text = " ".join(words(70, 40, 3000))
    rows = [(1, text, "en", "s", 1), (1, text, "en", "s", 1), (1, " ".join(words(71, 40, 3000)), "en", "s", 1), (None, " ".join(words(72, 40, 3000)), None, None, None), (2, text + " more words here", "en", "s", 1)]
    d = folder(tmp_path / "a", spark, spark.createDataFrame(rows, DDL), [], [])
    out = [(r["doc_id"], r["text"]) for r in pipeline.run(spark, d).collect()]
    assert sorted(x for x, _ in out if x) == [1, 1] + [1] * (len(out) - 3) and (None, rows[3][1]) in out and all(x != 2 for x, _ in out)
    d = folder(tmp_path / "b", spark, spark.createDataFrame([], DDL), [], [])
    assert pipeline.run(spark, d).count() == 0


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_registered(spark, small, name):
    df = queries.QUERIES[name](spark, small)
    assert df.count() == spark.read.parquet(f"{small}/{'pages' if 'warc' in name else 'documents'}.parquet").count()


def test_near_dedup_recall(spark, small):
    """All links of a corpus are found: components equal those of brute force."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert sorted(tuple(r) for r in near_dedup.near_duplicates(docs).collect()) == brute_components(rows)
