"""The pipeline against plain Python on a small folder of tables."""

from collections import Counter

import pytest

from attesta.llm import decontam, langid

from .test_operators import brute_components, brute_targets, line_sets, linked, shingle_set


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("tables"))
    src = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{src}/documents.parquet")
    odd = spark.createDataFrame([(5000, None, None, None, None), (5001, "", "en", "src1", 0), (5002, "123 456", "en", "src1", 7)], docs.schema)
    docs.unionByName(odd).unionByName(docs.where("doc_id = 3")).write.parquet(f"{at}/documents.parquet")
    spark.read.parquet(f"{src}/benchmark.parquet").write.parquet(f"{at}/benchmark.parquet")
    return at


def test_each_stage_against_brute_force(spark, folder):
    import corpus_pipeline as p

    assert [n for n, _ in p.STAGES] == ["language_id", "line_dedup", "ngram_jaccard_join", "benchmark_decontamination", "mixing"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    one = p.identify_language(spark, docs, folder).cache()
    scored = {r.doc_id: r for r in langid.identify(spark, docs).collect()}
    want = Counter(r.doc_id for r in docs.collect() if scored[r.doc_id].lang_pred != "und" and scored[r.doc_id].score >= langid.LEAST_SCORE)
    assert Counter(r.doc_id for r in one.collect()) == want and 5000 not in want and 5002 not in want

    two = p.remove_repeated_lines(spark, one, folder).cache()
    texts, seen, left = {r.doc_id: r.text for r in one.collect()}, [], {}
    for d in sorted(texts):
        lines = texts[d].split("\n")
        gone = set()
        for k, s in line_sets(texts[d]).items():
            if any(linked(s, e) for e in seen):
                gone.add(k)
            seen.append(s)
        kept = "\n".join(x for k, x in enumerate(lines) if k not in gone)
        if kept.strip() or not gone:
            left[d] = kept
    assert {r.doc_id: r.text for r in two.collect()} == left

    three = p.keep_one_of_each_group(spark, two, folder).cache()
    placed = brute_components([(d, shingle_set(t)) for d, t in sorted(left.items())], linked)
    assert sorted(r.doc_id for r in three.collect()) == sorted({c if n else d for d, n, c in placed})

    four = p.decontaminate(spark, three, folder).cache()
    items = [shingle_set(r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    clean = [r.doc_id for r in three.collect() if not any(q and 100 * len(q & shingle_set(r.text)) >= 80 * len(q) for q in items)]
    assert sorted(r.doc_id for r in four.collect()) == sorted(clean)
    assert one.columns == two.columns == three.columns == four.columns == columns

    five = p.mix_sources(spark, four, folder)
    assert five.columns == [*columns, "copy"]
    size = {r.doc_id: (r.source, len([w for w in (r.text or "").split() if w])) for r in four.collect()}
    sizes, taken = Counter(), Counter()
    for s, n in size.values():
        sizes[s] += n
    for r in five.collect():
        taken[r.source] += size[r.doc_id][1]
    targets = brute_targets(dict(sizes))
    largest = {s: max(n for t, n in size.values() if t == s) for s in sizes}
    assert all(abs(taken[s] - targets[s]) <= largest[s] for s in sizes)


def test_run(spark, folder):
    import corpus_pipeline as p

    out = p.run(spark, folder)
    assert out.count() > 0 and out.columns[-1] == "copy"
    assert decontam.contaminated(spark, out, spark.read.parquet(f"{folder}/benchmark.parquet")).isEmpty()


def test_stages_on_empty_tables_and_clashing_columns(spark, folder):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{folder}/documents.parquet").selectExpr("*", "1 as k1", "'x' as letters", "2 as n", "'y' as c", "3 as pos", "'z' as score", "4 as copy")
    for name, stage in p.STAGES:
        none = stage(spark, docs.where("false"), folder)
        assert none.isEmpty() and set(none.columns) == set(docs.columns), name
        some = stage(spark, docs.where("doc_id < 12"), folder)
        assert set(some.columns) == set(docs.columns), name
        if name != "mixing":
            assert some.columns == docs.columns and some.where("k1 <> 1 or letters <> 'x' or n <> 2 or c <> 'y' or pos <> 3 or score <> 'z' or copy <> 4").isEmpty(), name
