"""Hand-computed results of the library's own operators."""

import pytest
from pyspark.sql import functions as F

from lorewell import schemas
from lorewell.functions import prompts
from lorewell.functions import text as T
from lorewell.operators import catalog, documents, fusion, graph, lexical, quality, split, vector
from lorewell.plans.retrieve import retrieve, retrieve_bases
from lorewell.sources import files, tables
from lorewell.streaming import messages, outbox


def one(spark, expr, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize(("model", "name", "factory"), [("gpt-4@openai", "gpt-4", "openai"), ("llama2-7b", "llama2-7b", "Local"), ("a@b@c", "a@b", "c"), ("m@", "m", "Local"), ("", "", "")])
def test_model_ids(spark, model, name, factory):
    assert (one(spark, T.model_name(F.col("m")), m=model), one(spark, T.model_factory(F.col("m")), m=model)) == (name, factory)


def test_scalars(spark):
    assert one(spark, T.masked(F.col("k")), k="12345678") == "****" and one(spark, T.masked(F.col("k")), k="123456789") == "1234****6789"
    assert one(spark, T.host(F.col("u")), u="https://api.x.cn/v1") == "api.x.cn"
    assert one(spark, T.trim(F.col("t")), t="\t　 a b 　\n") == "a b"
    assert one(spark, T.overlap(F.col("p"), F.col("c")), p=" head abcabc", c="abcabc tail") == 6
    long = "abcdefghij" * 4
    assert one(spark, T.overlap(F.col("p"), F.col("c")), p="x" + long, c=long + "y") == 40 and one(spark, T.overlap(F.col("p"), F.col("c")), p=long + "z", c=long) == 0
    assert one(spark, T.tokens(F.col("t")), t="Go 语言模型, v2") == ["go", "语言模型", "v2", "语言", "言模", "模型"]
    assert [one(spark, T.backoff_seconds(F.col("n")), n=n) for n in (0, 1, 2)] == [30, 60, 120]


@pytest.mark.parametrize(("n", "score"), [(500, 20), (300, 20), (800, 20), (200, 12), (900, 16), (50, 6), (1500, 10)])
def test_length_scores(spark, n, score):
    assert one(spark, quality.length_score(F.col("c")), c="字" * n) == score


def test_chunk_scores_and_issues(spark):
    rows = [("d", 0, " head abcabc"), ("d", 1, "abcabc tail"), ("e", 0, "它说,")]
    got = {(r["doc_id"], r["chunk_index"]): r for r in quality.scored(spark.createDataFrame(rows, "doc_id string, chunk_index int, content string")).collect()}
    assert got["d", 1]["content_score"] == pytest.approx(10 / 11 * 10 + (1 - 6 / 11) * 10)
    assert got["d", 1]["issues"] == ["chunk_too_short", "high_overlap", "low_qa_coverage"]
    assert got["e", 0]["issues"] == ["chunk_too_short", "truncated_end", "dangling_reference", "low_qa_coverage"]
    qa = spark.createDataFrame([("Go 语言", [("Go 语是", "a"), ("Go 语有", "b"), ("Go 语呢", "c")])], f"c string, q {quality.QA}")
    assert qa.select(quality.qa_score(F.col("c"), F.col("q")).alias("x")).first()["x"] == pytest.approx(10 + 5 / 3)


def test_headers_and_sections(spark):
    text = "开头的一些话。\n\n第一章 架构\n内容在这里。\n1. 模块\n更多内容。\n1.1 不是标题，因为没有点。\n小结\n\n完。"
    got = split.sections(spark.createDataFrame([(1, text), (2, ""), (3, None)], "doc_id long, text string")).orderBy("doc_id", "section_index").collect()
    assert [(r["header_context"], r["header_level"], r["header_type"]) for r in got] == [
        ("前言/摘要", 0, "implicit"), ("第一章 架构", 1, "chinese"), ("模块", 1, "numbered"), ("小结", 2, "heuristic"), ("无标题", 0, "implicit"), ("无标题", 0, "implicit"),
    ]


def test_size_bounded_pieces():
    text = "one two three. four five six.\n\nseven eight nine ten eleven twelve thirteen"
    parts = split.pieces_of(text, split.SEPARATORS, 20, 0)
    assert all(len(p) <= 20 for p in parts) and "".join("".join(parts).split()).replace(".", "") == "".join(text.split()).replace(".", "")
    assert split.pieces_of("abcdefgh", [], 4, 1) == ["abcd", "defg", "gh"] and split.pieces_of("", split.SEPARATORS, 5, 0) == []


def test_topic_chunks():
    sentences = ["第一章 序言 这是序言的内容。", "这是序言的第二句。", "第一章 正文", "这是第一章正文内容。", "正文内容继续。", "第二章 结论 结论部分很简短。"]
    cuts = [(False, ""), (True, "第一章 正文"), (False, ""), (False, ""), (True, "第二章 结论")]
    whole = split.topic_chunks(sentences, cuts, 1000, 0)
    assert len(whole) == 3 and "【第一章 正文】" in whole[1] and "【第二章 结论】" in whole[2]
    small = split.topic_chunks(sentences, cuts, 15, 0)
    assert len(small) == 6 and small[4] == "【第一章 正文】\n正文内容继续。"
    assert split.topic_chunks(sentences, cuts, 15, 4)[4] == "【第一章 正文】\n文内容。 正文内容继续。"


def test_markdown_sections_skip_fences(spark):
    text = "# A\nx\n```\n# no\n```\n## B\ny\n# C\nz"
    got = split.markdown_sections(spark.createDataFrame([(1, text)], "doc_id long, text string")).orderBy("section_index").collect()
    assert [(r["h1"], r["h2"]) for r in got if r["content"]] == [("A", None), ("A", "B"), ("C", None)]


def test_bm25_and_ties(spark):
    chunks = spark.createDataFrame([(1, "red fox"), (2, "red fox"), (3, "blue whale blue"), (4, None)], "chunk_id long, content string")
    queries = spark.createDataFrame([(1, "red"), (2, "none")], "query_id long, query string")
    got = lexical.top_k(lexical.bm25(chunks, queries), 5).orderBy("rank").collect()
    assert [(r["id"], r["rank"]) for r in got] == [(1, 1), (2, 2)] and got[0]["score"] == got[1]["score"]


def test_knn_and_fusion(spark):
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, [-1.0, 0.0]), (4, [0.0, 0.0]), (5, None), (6, [1.0])], "id long, embedding array<double>")
    got = vector.knn(vectors, spark.createDataFrame([(9, [3.0, 0.0])], "query_id long, query_vector array<double>"), 10).orderBy("rank").collect()
    assert [(r["id"], r["score"]) for r in got] == [(1, 1.0), (2, 0.5), (3, 0.0)]
    a = spark.createDataFrame([(1, 10, 3.0), (1, 11, 1.0)], "query_id long, id long, score double")
    b = spark.createDataFrame([(1, 11, 5.0)], "query_id long, id long, score double")
    assert {r["id"]: r["score"] for r in fusion.summed(a, b).collect()} == {10: 3.0, 11: 6.0}
    assert {r["id"]: r["score"] for r in fusion.reciprocal_ranks(a, b).collect()} == pytest.approx({10: 1 / 61, 11: 1 / 62 + 1 / 61})


def test_retrieval_modes(spark):
    chunks = spark.createDataFrame([("a", 1, "red fox runs", [1.0, 0.0]), ("b", 1, "blue whale", [0.0, 1.0])], "id string, doc_id long, content string, embedding array<double>")
    queries = spark.createDataFrame([(1, "red fox", [1.0, 0.0])], "query_id long, query string, query_vector array<double>")
    for mode in ("fulltext", "vector", "hybrid"):
        assert [(r["id"], r["score"]) for r in retrieve(chunks, queries, mode).collect()] == [("a", 1.0)]
    with pytest.raises(ValueError):
        retrieve(chunks, queries, k=0)


def test_graph_records_and_merges(spark):
    answers = [
        (1, "c1", '("entity"<|>"A"<|>"person"<|>"ab")##("relationship"<|>"A"<|>"B"<|>"owns"<|>"x"<|>8)##("entity"<|>"A")'),
        (2, "c2", '("entity"<|>"A"<|>"geo"<|>"abcd")##("relationship"<|>"A"<|>"B"<|>"owns"<|>"y"<|>6)##("relationship"<|>"B"<|>"A"<|>"r"<|>"z"<|>x)'),
        (3, "c1", '("entity"<|>"A"<|>"-"<|>"abc")##("relationship"<|>"A"<|>"B"<|>"owns"<|>"x"<|>4)'),
    ]
    parsed = graph.records(spark.createDataFrame(answers, "chunk_index long, chunk_id string, answer string"))
    (entity,) = graph.merged_entities(graph.entities(parsed)).collect()
    assert (entity["name"], entity["type"], entity["description"], entity["source_id"]) == ("A", "person", "abcd", ["c1", "c2"])
    got = {(r["src_id"], r["dst_id"]): (r["weight"], r["description"], r["source_id"]) for r in graph.merged_relations(graph.relations(parsed)).collect()}
    assert got == {("A", "B"): (5.5, "x\ny", ["c1", "c2"]), ("B", "A"): (0.0, "z", ["c2"])}


def test_visibility_needs_a_tenant(spark):
    bases = spark.createDataFrame([(1, 1, 7, "me", 1), (2, 1, 8, "team", 1), (3, 1, 8, "me", 1), (4, 2, 8, "team", 1), (5, 1, 7, "me", 0)], "kb_id int, tenant_id int, created_by int, permission string, status int")
    members = spark.createDataFrame([(7, 1, 1), (9, 1, 0)], "user_id int, tenant_id int, status int")
    see = lambda user: sorted(r["kb_id"] for r in catalog.visible(bases, members, user).collect())
    assert see(7) == [1, 2] and see(8) == [] and see(9) == []


def test_insert_ignore_counts_repeats(spark):
    rows = spark.createDataFrame([(1, "a")], "k int, v string")
    added, refused = catalog.insert_ignore(rows, spark.createDataFrame([(1, "b"), (2, "c"), (2, "c")], "k int, v string"), ["k"])
    assert [r["k"] for r in added.collect()] == [2] and sorted(r["k"] for r in refused.collect()) == [1, 2]


def test_task_states_stream(spark, tmp_path):
    spark.createDataFrame([(1, 10, "fail"), (1, 20, "fail"), (2, 5, "fail"), (2, 6, "success"), (2, 7, "fail")], "id long, at long, outcome string").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("id long, at long, outcome string").parquet(f"{tmp_path}/in")
    out = []
    messages.run_batches(outbox.task_states(stream), lambda df, n: out.extend(df.collect()), f"{tmp_path}/marks", mode="update").awaitTermination()
    assert {r["id"]: (r["status"], r["retry_times"], r["next_retry"]) for r in out} == {1: ("fail", 2, 80), 2: ("success", 1, 35)}


def test_malformed_messages_are_dropped(spark):
    df = spark.createDataFrame([('{"document_id": "1"}',), ("{broken",), ('{"document_id": ""}',), (None,)], "value string")
    assert [r["document_id"] for r in messages.parsed(df, schemas.INDEX_MESSAGE, "document_id").collect()] == ["1"]


def test_entry_names_match():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_structure_split_keeps_the_text_and_ingest_its_questions(spark):
    from lorewell.plans.ingest import ingest

    text = "1. Start\n" + "Some words of a sentence here. " * 20 + "\n\n" + "More of them follow now. " * 20
    docs = spark.createDataFrame([(1, "a.txt", text), (2, "b.md", "# H\nshort text")], "doc_id long, path string, text string")
    chunks = split.structure_split(docs, size=120).where("doc_id = 1").orderBy("chunk_index").collect()
    bare = lambda s: "".join(c for c in s if c.isalnum())
    assert [r["chunk_index"] for r in chunks] == list(range(len(chunks))) and all(len(r["content"]) <= 120 and r["header_context"] == "Start" for r in chunks)
    assert bare("".join(r["content"] for r in chunks)) == bare(text)
    ask = lambda c: F.lit('```json\n[{"question": "q?", "answer": "a"}, {"question": ""}]\n```')
    rows = ingest(docs, "path", F.lit("kb"), F.lit(0.0), size=130, ask=ask).collect()
    assert {r["content"] for r in rows if r["id"].startswith("qa-")} == {"Question: q?\nAnswer: a"}
    assert [r["content"] for r in rows if r["doc_id"] == "2"] == ["# H\nshort text"]


def test_put_chunks_keeps_the_other_rows_of_a_base(spark, tmp_path):
    schema, path = "id string, kb_id string, content string, create_timestamp_flt double", f"file://{tmp_path}/chunks"
    put = lambda *rows: tables.put_chunks(spark.createDataFrame(rows, schema), path)
    put(("a", "01", "first", 1.0), ("b", "01", "stays", 1.0), ("c", "2", "other base", 1.0), ("n", None, "no base", 1.0))
    put(("a", "01", "older", 0.5), ("a", "01", "second", 0.7), ("d", "01", "new", 2.0), ("b", "3", "same id elsewhere", 1.0), ("m", None, "added", 1.0))
    got = sorted((r["id"], r["content"]) for r in spark.read.parquet(path).collect())
    assert got == [("a", "second"), ("b", "same id elsewhere"), ("b", "stays"), ("c", "other base"), ("d", "new"), ("m", "added"), ("n", "no base")]


def test_upserts_apply_repeated_ids_one_after_another(spark):
    kind = "id string, graph_type string, weight double, description string, source_ids array<string>, updated_at int"
    old = spark.createDataFrame([("r", "relation", 8.0, "a", ["1"], 0), ("e", "entity", 1.0, "", ["1"], 0), ("k", "entity", 5.0, "kept", None, 0)], kind)
    new = spark.createDataFrame([("r", "relation", 4.0, "b", ["2"], 2), ("r", "relation", 6.0, "a", ["1", "3"], 1), ("e", "entity", 3.0, "d", ["2"], 1), ("n", "relation", 2.0, "x", ["9"], 1), ("n", "relation", 4.0, None, ["9"], 2)], kind)
    got = {r["id"]: (r["weight"], r["description"], r["source_ids"], r["updated_at"]) for r in graph.upsert_docs(old, new).collect()}
    assert got == {"r": (5.5, "a\nb", ["1", "3", "2"], 2), "e": (1.0, "d", ["1", "2"], 1), "k": (5.0, "kept", None, 0), "n": (3.0, "x", ["9"], 2)}


def test_relations_begin_with_a_description_that_says_something(spark):
    rows = [(1, 0, "c", "A", "B", "t", "", 1.0), (2, 0, "c", "A", "B", "t", "x", 1.0), (1, 0, "c", "B", "A", "t", "", 1.0)]
    found = spark.createDataFrame(rows, "chunk_index long, record_index int, source_id string, src_id string, dst_id string, type string, description string, weight double")
    assert {r["src_id"]: r["description"] for r in graph.merged_relations(found).collect()} == {"A": "x", "B": ""}


def test_graph_view_shows_the_last_of_a_name(spark):
    nodes = spark.createDataFrame([("a", "1"), ("a", "2"), ("b", "0")], "name string, type string")
    shown, _ = graph.graph_view(nodes, spark.createDataFrame([("a", "b")], "src_id string, dst_id string"))
    assert {r["name"]: r["type"] for r in shown.collect()} == {"a": "2", "b": "0"}


def test_boundaries_that_are_missing_are_cuts(spark):
    docs = spark.createDataFrame([(1, "one. two. three. four."), (2, "alone"), (3, None)], "doc_id long, text string")
    no, yes = '{"is_boundary": false, "header": ""}', '{"is_boundary": true, "header": "H"}'
    chunks = lambda answer: [(r["chunk_id"], r["content"]) for r in split.agentic_split(docs, lambda s: F.lit(answer)).orderBy("doc_id", "chunk_index").collect()]
    rest = [("2", "alone"), ("3", "")]
    assert chunks(f"```json\n[{no}, {yes}, {no}]```") == [("1_chunk_1", "one two"), ("1_chunk_2", "【H】\nthree four"), *rest]
    assert chunks(f"[{no}]") == [("1_chunk_1", "one two"), ("1_chunk_2", "three"), ("1_chunk_3", "four"), *rest]
    assert [c for _, c in chunks("no list")] == ["one", "two", "three", "four", "alone", ""]
    windows = spark.createDataFrame([(1, ". ".join(f"s{i}" for i in range(45)))], "doc_id long, text string")
    assert split.found_boundaries(split.sentence_windows(windows), lambda s: F.lit(None).cast("string")).select(F.size("sentences").alias("n"), F.size("boundaries").alias("b")).first() == (45, 44)


def test_uploads_are_taken_whole_or_not_at_all(spark):
    files_ = [("u", f"f{i}.txt", 10) for i in range(11)] + [("v", "a.PDF", 5), ("v", " ", 5), ("v", "noext", 7), ("w", "big.txt", 200 << 20)]
    taken, refused = documents.admitted(spark.createDataFrame(files_, "upload_id string, name string, size long"), {"kb_id": 3, "tenant_id": 9, "parser_config": None}, "me", F.lit(0))
    assert {(r["doc_name"], r["doc_type"], r["run_status"]) for r in taken.collect()} == {("a.PDF", "pdf", "pending"), ("noext", "unknown", "pending")}
    assert all(r["storage_path"].startswith("tenant_9/kb_3/") for r in taken.collect())
    assert sorted(r["reason"] for r in refused.collect()) == ["no name"] + ["too large"] + ["too many files"] * 11


def test_messages_of_nulls_and_unknown_topics_are_refused(spark):
    rows = spark.createDataFrame([("1", "t"), (None, None)], "document_id string, tenant_id string")
    assert [r["value"] for r in messages.as_messages(rows, "document_index").collect()] == ['{"document_id":"1","tenant_id":"t"}']
    with pytest.raises(ValueError):
        messages.as_messages(rows, "other")


def test_objects_and_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("hello")
    place = f"file://{tmp_path}/bucket"
    files.ensure_folder(spark, place)
    files.put_object(spark, f"{tmp_path}/a.txt", f"{place}/x/a.txt")
    files.get_object(spark, f"{place}/x/a.txt", f"{tmp_path}/b.txt")
    assert (tmp_path / "b.txt").read_text() == "hello" and [r["text"] for r in files.load_texts(spark, f"{place}/x").collect()] == ["hello"]
    assert files.remove_object(spark, f"{place}/x/a.txt") and not files.remove_object(spark, f"{place}/x/a.txt")
    with pytest.raises(ValueError):
        files.load_texts(spark, "HTTPS://host/a.txt")


def test_folder_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "m.txt").write_text('{"document_id": "7"}\n{broken\n')
    out = []
    found = messages.parsed(messages.read_folder(spark, f"{tmp_path}/in"), schemas.INDEX_MESSAGE, "document_id")
    messages.run_batches(found, lambda df, n: out.extend(r["document_id"] for r in df.collect()), f"{tmp_path}/marks").awaitTermination()
    assert out == ["7"]


def test_what_is_ingested_can_be_put_and_deleted(spark, tmp_path):
    from lorewell.plans.ingest import ingest

    docs = spark.createDataFrame([(i, "a.txt", f"Words of text {i}. " * 30) for i in range(4)], "doc_id long, path string, text string")
    path = f"file://{tmp_path}/index"
    for kb in ("x", "y"):
        tables.put_chunks(ingest(docs, "path", F.lit(kb), F.lit(1.0), size=200), path)
    rows = spark.read.parquet(path)
    assert rows.where("total is null or size(suggestions) = 0").count() == 0
    left = documents.deleted_chunks(rows, "x", spark.createDataFrame([("1",)], "doc_id string"))
    assert rows.count() - left.count() == rows.where("kb_id = 'x' and doc_id = '1'").count() > 0
    assert {r["kb_id"] for r in catalog.cascade_delete("x", rows.select("kb_id"), rows.select("kb_id"), rows)[2].select("kb_id").distinct().collect()} == {"y"}


def test_bases_are_searched_in_one_job(spark):
    rows = [("a", 1, "red fox", [1.0, 0.0], ["k1"]), ("b", 2, "red fox runs", [0.0, 1.0], ["k1", "k2"]), ("c", 3, "red whale", [1.0, 1.0], ["k2"]), ("d", 4, "red fox", [1.0, 0.0], ["k3"])]
    chunks = spark.createDataFrame(rows, "id string, doc_id long, content string, embedding array<double>, kb_ids array<string>")
    queries = spark.createDataFrame([(1, "red fox", [1.0, 0.0])], "query_id long, query string, query_vector array<double>")
    got = {(r["kb_id"], r["id"], r["rank"]) for r in retrieve_bases(chunks, queries, ["k1", "k2"], k=2, least=0.4).collect()}
    assert got == {("k1", "a", 1), ("k1", "b", 2), ("k2", "b", 1), ("k2", "c", 2)}
    narrowed = retrieve(chunks, queries, "fulltext", doc_ids=[3], least=0.1).collect()
    assert [(r["id"], r["score"]) for r in narrowed] == [("c", 0.5)]
    every, one_ = lexical.bm25(chunks, queries, "id"), lexical.bm25(chunks, queries, "id", among=F.col("doc_id") == 3)
    assert {r["id"]: r["score"] for r in every.collect()}["c"] == one_.first()["score"]


def test_knn_in_blocks(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 6)).round(1)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<double>")
    asked = rows.where("id % 10 = 0").selectExpr("id as query_id", "embedding as query_vector")
    whole = {(r["query_id"], r["id"], r["score"], r["rank"]) for r in vector.knn(rows, asked, 7).collect()}
    monkeypatch.setattr(vector, "BLOCK", 40)
    assert {(r["query_id"], r["id"], r["score"], r["rank"]) for r in vector.knn(rows.repartition(5), asked, 7).collect()} == whole
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    for q in range(0, 300, 10):
        s = np.round((1 + u @ u[q]) / 2, 6)
        best = sorted(range(300), key=lambda i: (-s[i], i))[:7]
        assert {(i, r) for k, i, _, r in whole if k == q} == {(i, r) for r, i in enumerate(best, 1)}


def test_prompts(spark):
    got = one(spark, prompts.filled("{a} and {n}: {{x}}", a=F.col("a"), n=2), a="{b}")
    assert got == "{b} and 2: {x}" and one(spark, prompts.numbered(F.col("s")), s=["u", "v"]) == "1. u\n2. v"
    with pytest.raises(KeyError):
        prompts.filled("{missing}")


def test_answers_are_parsed_once_for_merged_relations(spark):
    """Descriptions, sources and weights each used to parse every answer again."""
    parsed = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            parsed.add(batch.num_rows)
            yield batch

    schema = "chunk_index int, record_index int, source_id string, src_id string, dst_id string, type string, description string, weight double"
    rows = [(i, 0, f"c{i}", "A", "B", "t", f"d{i % 3}", float(i)) for i in range(12)]
    (got,) = graph.merged_relations(spark.createDataFrame(rows, schema).mapInArrow(counted, schema)).collect()
    assert parsed.value == 12
    weight = 0.0
    for i in range(1, 12):
        weight = (weight + i) / 2
    assert (got["description"], got["source_id"], round(got["weight"], 9)) == ("d0\nd1\nd2", [f"c{i}" for i in range(12)], round(weight, 9))
