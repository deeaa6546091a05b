import corpus_pipeline
from eventloom.llm import simhash

LONG = "Every good story begins with a quiet morning in the small town by the sea where nothing ever happens until it does"


def test_stages_names_and_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "toxicity", "line_dedup", "simhash_near_dedup", "benchmark_decontamination", "byte_bpe",
    ]
    assert corpus_pipeline.ORACLE_SQL is None


def test_each_stage_on_its_input(spark, frame, tmp_path):
    rows, labels = [], []
    for i in range(120):
        bad = i % 6 == 0
        body = " ".join(f"word{(i * 37 + k * k) % 997}" for k in range(60))
        rows.append((i, body + (" vileword vileword" if bad else ""), "en", f"s{i % 3}", len(body)))
        labels.append((i, 1, int(bad)))
    rows += [(200, rows[1][1], "en", "s", 1), (201, "some words " + LONG, "en", "s", 1), (202, None, None, None, None), (203, "first\n" + rows[2][1], "en", "s", 3)]
    folder = str(tmp_path)
    schema = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT"
    frame(rows, schema).write.parquet(f"{folder}/documents.parquet")
    frame(labels, "doc_id BIGINT, quality INT, toxic INT").write.parquet(f"{folder}/labels.parquet")
    frame([(1, LONG)], "item_id BIGINT, text STRING").write.parquet(f"{folder}/benchmark.parquet")
    docs, seen = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        if name != "byte_bpe":
            assert out.columns == docs.columns
        path = f"{folder}/{name}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        seen[name] = {r.doc_id: r for r in docs.collect()}
    clean = {i for i in range(120) if i % 6}
    assert set(seen["toxicity"]) == clean | {200, 201, 202, 203}
    lines = seen["line_dedup"]
    assert set(lines) == set(seen["toxicity"]) and lines[200].text == "" and lines[200].n_chars == 0 and lines[203].text == "first"
    assert lines[1].text == rows[1][1] and lines[202].text is None
    near = seen["simhash_near_dedup"]
    assert clean <= set(near) and len({200, 202} & set(near)) == 1
    prints = [simhash.simhash((r.text or "").encode()) for r in near.values()]
    assert all(bin((a ^ b) & (1 << 64) - 1).count("1") > 4 for i, a in enumerate(prints) for b in prints[:i])
    assert set(near) - set(seen["benchmark_decontamination"]) == {201}
    last = seen["byte_bpe"]
    assert set(last) == set(seen["benchmark_decontamination"]) and all(r.n_tokens == len(r.ids) for r in last.values())


def test_empty_tables(spark, tmp_path):
    folder = str(tmp_path)
    spark.createDataFrame([], "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id BIGINT, quality INT, toxic INT").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([], "item_id BIGINT, text STRING").write.parquet(f"{folder}/benchmark.parquet")
    assert corpus_pipeline.run(spark, folder).count() == 0
