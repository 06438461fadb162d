"""The library's operators over whole tables, as named queries; their DuckDB SQL is in ``lorewell.oracles``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorewell import schemas
from lorewell.functions import prompts
from lorewell.functions import text as T
from lorewell.operators import catalog, communities, documents, fusion, graph, lexical, metrics, quality, resolution, split, vector
from lorewell.operators.text_index import TextIndex
from lorewell.operators.text_scan import TextScan
from lorewell.operators.vector_index import VectorIndex
from lorewell.plans import ingest as ingestion
from lorewell.plans.embedding import embedded
from lorewell.plans.retrieve import retrieve, retrieve_bases, shared_terms
from lorewell.sources import files, tables
from lorewell.sources.keyed import KeyedTable
from lorewell.sources.scratch import kept, shared_path
from lorewell.streaming import messages, outbox, retries, stateful

Query = Callable[[SparkSession, str], DataFrame]


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _chunks(spark: SparkSession, d: str, size: int = 400) -> DataFrame:
    """Texts cut at every ``size`` characters."""
    df = _t(spark, d, "documents").where("text is not null and text <> ''")
    at = F.sequence(F.lit(0), ((F.char_length("text") - 1) / size).cast("int"))
    df = df.select("doc_id", "source", "text", F.explode(at).alias("chunk_index"))
    piece = lambda i: F.substring("text", i * size + 1, F.lit(size))
    before = F.when(F.col("chunk_index") > 0, piece(F.col("chunk_index") - 1))
    return df.select("doc_id", "source", "chunk_index", piece(F.col("chunk_index")).alias("content"), before.alias("previous"))


# scalars


def sc_text(spark: SparkSession, d: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return _t(spark, d, "documents").select(
        "doc_id", F.char_length(T.trim(text)).alias("trimmed"), F.round(T.density(text), 6).alias("density"), T.token_estimate(text).alias("estimate"),
        F.size(T.tokens(text)).alias("n_tokens"), F.size(T.atoms(text)).alias("n_sentences"), T.title(text).alias("title"), T.occurrences(text, "the").alias("n_the"),
        T.chunk_id(text, F.col("doc_id")).alias("chunk_id"), F.char_length(T.cleaned(text)).alias("n_clean"),
    )


def sc_names(spark: SparkSession, d: str) -> DataFrame:
    model = F.concat_ws("@", "c_name", F.when(F.col("c_custkey") % 3 > 0, F.col("c_mktsegment")))
    name, kb = F.col("c_name"), F.col("c_nationkey").cast("string")
    return _t(spark, d, "customer").select(
        "c_custkey", T.model_name(model).alias("model"), T.model_factory(model).alias("factory"), T.masked(name).alias("masked"), T.space_name(F.concat(kb, F.lit("-a-b"))).alias("space"),
        T.entity_id(kb, name).alias("entity_id"), T.relation_id(kb, name, F.col("c_mktsegment")).alias("relation_id"), T.backoff_seconds(F.col("c_custkey") % 4).alias("wait"),
        T.is_email(F.concat(F.lower(F.replace("c_name", F.lit("#"), F.lit("."))), F.lit("@mail.example"))).alias("email"),
    )


def src2_urls(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "pages").select("page_id", T.is_url(F.col("url")).alias("is_url"), T.host(F.col("url")).alias("host"), T.is_markdown(F.col("url")).alias("is_markdown"), T.is_pdf(F.col("url")).alias("is_pdf"))


def sc13_json(spark: SparkSession, d: str) -> DataFrame:
    df = _t(spark, d, "events").withColumn("meta", F.from_json("props", "map<string,string>"))
    return df.select("event_id", F.from_json("props", "k long")["k"].alias("k"), catalog.number_of("meta", "k").alias("as_double"))


# splitting and quality


def c3_headers(spark: SparkSession, d: str) -> DataFrame:
    df = split.headers(_t(spark, d, "documents").select("doc_id", "text"))
    return split.exploded(df.select("doc_id", "headers"), "headers", "k", "h").select("doc_id", "h.*")


def c4_sections(spark: SparkSession, d: str) -> DataFrame:
    df = split.sections(_t(spark, d, "documents"))
    return df.withColumn("content", F.md5("content"))


def c6_structure_split(spark: SparkSession, d: str) -> DataFrame:
    return split.structure_split(_t(spark, d, "documents"), size=500, overlap=50)


def c2_markdown(spark: SparkSession, d: str) -> DataFrame:
    marked = F.regexp_replace("text", r"(?m)^([A-Za-z]{4}) ", "## $1 ")  # the documents hold next to no headers of their own
    return split.markdown_sections(_t(spark, d, "documents").select("doc_id", marked.alias("text"))).select("doc_id", "section_index", "h1", "h2", "h3", "h4", F.md5("content").alias("content"))


def c7_sentence_windows(spark: SparkSession, d: str) -> DataFrame:
    df = split.sentence_windows(_t(spark, d, "documents"))
    return df.select("doc_id", "window_index", "first", F.size("sentences").alias("n"), F.md5(F.array_join("sentences", "|")).alias("digest"))


def c8_topic_split(spark: SparkSession, d: str) -> DataFrame:
    df = _t(spark, d, "documents").select("doc_id", T.atoms(F.coalesce("text", F.lit(""))).alias("sentences")).where(F.size("sentences") > 0)
    cut = F.transform(F.slice("sentences", F.lit(2), F.greatest(F.size("sentences") - 1, F.lit(0))), lambda s: F.struct((F.char_length(s) % 7 == 0).alias("is_boundary"), F.left(s, F.lit(8)).alias("header")))
    return split.topic_split(df.withColumn("boundaries", cut), most=300, overlap=20)


def c11_ingest(spark: SparkSession, d: str) -> DataFrame:
    docs = _t(spark, d, "documents").withColumn("path", F.concat("source", F.when(F.col("doc_id") % 2 == 0, ".md").otherwise(".txt")))
    item = lambda c, n: F.concat(F.lit('{"question": "'), F.md5(F.concat(c, F.lit(n))), F.lit('", "answer": "a"}'))
    ask = lambda c: F.concat(F.lit("Here: ["), item(c, "1"), F.lit(", "), item(c, "2"), F.lit("]"))
    out = ingestion.ingest(docs, "path", F.lit("kb"), F.lit(0.0), ask=ask)
    return out.select("id", "doc_id", "chunk_index", "content", "available_int", F.round("total", 6).alias("total"), F.array_join("suggestions", ",").alias("suggestions"))


def q1_chunk_scores(spark: SparkSession, d: str) -> DataFrame:
    df = quality.scored(_chunks(spark, d), previous_col="previous")
    return df.select("doc_id", "chunk_index", "length", "structure", F.round("content_score", 6).alias("content_score"), "semantic", "qa", F.round("total", 6).alias("total"), F.array_join("issues", ",").alias("issues"), F.array_join("suggestions", ",").alias("suggestions"))


def q6_qa_scores(spark: SparkSession, d: str) -> DataFrame:
    """Chunks with none to four questions, some of which begin alike; the texts hold no Han runs to match."""
    ask = F.transform(F.sequence(F.lit(1), (F.col("chunk_index") % 4).cast("int")), lambda i: F.struct(F.concat(F.when(i > 1, "why ").otherwise(i.cast("string")), F.lit(" is it so")).alias("question"), F.lit("a").alias("answer")))
    df = _chunks(spark, d).withColumn("asked", F.when(F.col("chunk_index") % 4 > 0, ask).otherwise(F.array().cast(quality.QA)))
    return quality.scored(df, qa_col="asked", previous_col="previous").select("doc_id", "chunk_index", F.round("qa", 6).alias("qa"), F.array_contains("issues", "low_qa_coverage").alias("low"))


#: the 26 letters as characters of Chinese, so that the documents hold runs of them
HAN = "".join(chr(0x4E00 + 37 * i) for i in range(26))


def _han(spark: SparkSession, d: str) -> DataFrame:
    """Chunks whose small letters are Han characters; runs are as long as words."""
    return _chunks(spark, d).withColumn("content", F.translate("content", "abcdefghijklmnopqrstuvwxyz", HAN))


def sc7_han(spark: SparkSession, d: str) -> DataFrame:
    runs, tokens = T.han_runs(F.col("content")), T.tokens(F.col("content"))
    return _han(spark, d).select("doc_id", "chunk_index", F.size(runs).alias("n_runs"), F.md5(F.array_join(runs, "|")).alias("runs"), F.md5(F.array_join(F.sort_array(tokens), "|")).alias("tokens"))


def q6_han(spark: SparkSession, d: str) -> DataFrame:
    """Questions that name a run of Han characters; of every second chunk it is the chunk's own."""
    run = F.get(T.han_runs(F.col("content")), 0)
    named = F.when(F.col("chunk_index") % 2 == 0, run).otherwise(F.reverse(F.concat(run, F.lit(HAN[:3]))))
    ask = F.array(*[F.struct(F.concat(F.lit(f"{i} "), named).alias("question"), F.lit("a").alias("answer")) for i in range(2)])
    df = _han(spark, d).where(run.isNotNull()).withColumn("asked", ask)
    return quality.scored(df, qa_col="asked", previous_col="previous").select("doc_id", "chunk_index", F.round("qa", 6).alias("qa"))


def q7_needs_questions(spark: SparkSession, d: str) -> DataFrame:
    df = _chunks(spark, d).withColumn("qa", F.array_repeat(F.lit("q"), (F.col("chunk_index") % 4).cast("int")))
    return quality.needs_questions(df, "qa").select("doc_id", "chunk_index", F.size("qa").alias("n"))


def q10_statistics(spark: SparkSession, d: str) -> DataFrame:
    df = quality.statistics(quality.scored(_chunks(spark, d), previous_col="previous"))
    return df.withColumn("mean", F.round("mean", 6))


# retrieval


def _asked(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def _contents(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "documents").select(F.col("doc_id").alias("id"), "doc_id", F.coalesce("text", F.lit("")).alias("content"))


def v2_bm25(spark: SparkSession, d: str) -> DataFrame:
    return TextScan(_contents(spark, d), _asked(spark, d)).search(10)


def _text_index(spark: SparkSession, d: str, block: int = 64) -> TextIndex:
    """An index of five batches: the first four are merged, and the last one puts every seventh document, at first with another text, right."""
    rows, index = _contents(spark, d), TextIndex.create(spark, shared_path(spark, "text-index"), block)
    wrong = F.when(F.col("id") % 7 == 0, F.reverse("content")).otherwise(F.col("content"))
    for part in range(4):
        index.add(rows.withColumn("content", wrong).where(F.col("id") % 4 == part))
    index.add(rows.where("id % 7 = 0"))
    return index


def v2_bm25_index(spark: SparkSession, d: str) -> DataFrame:
    """From an index of four segments, before they are merged."""
    rows, index = _contents(spark, d), TextIndex.create(spark, shared_path(spark, "text-index"), 64, fan=9)
    for part in range(4):
        index.add(rows.where(F.col("id") % 4 == part))
    return index.search(_asked(spark, d), 10)


def v2_bm25_merged(spark: SparkSession, d: str) -> DataFrame:
    """From an index whose segments were merged after documents had been replaced."""
    index = _text_index(spark, d)
    for _ in range(3):  # three more segments of level 0, and all are merged
        index.add(_contents(spark, d).where("id % 7 = 0"))
    index.compact()
    return index.search(_asked(spark, d), 10)


def v5_postings(spark: SparkSession, d: str) -> DataFrame:
    df = lexical.postings(_contents(spark, d), "id")
    return df.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"), F.max("length").alias("longest"))


def v1_knn(spark: SparkSession, d: str) -> DataFrame:
    vectors = _t(spark, d, "embeddings")
    queries = vectors.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    return vector.knn(vectors, queries, 10, "vec_id")


def v1_knn_filtered(spark: SparkSession, d: str) -> DataFrame:
    vectors = _t(spark, d, "embeddings")
    queries = vectors.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"), "label")
    return vector.knn(vectors, queries, 10, "vec_id", same=("label", "label"))


def _vector_index(spark: SparkSession, d: str) -> VectorIndex:
    """An index of two batches; the second one adds half of the rows and replaces some of the first."""
    vectors = _t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    turned = F.when(F.col("id") % 10 == 0, F.reverse("embedding")).otherwise(F.col("embedding"))
    index = VectorIndex.build(vectors.where("id % 2 = 0").withColumn("embedding", turned), shared_path(spark, "vector-index"))
    index.add(vectors.where("id % 2 = 1 or id % 10 = 0"))
    return index


def _asked_vectors(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))


def v1_ann(spark: SparkSession, d: str) -> DataFrame:
    """Neighbours from the index; its recall against all vectors is in ``v1_ann_recall``."""
    return _vector_index(spark, d).search(_asked_vectors(spark, d), 10)


def v1_ann_recall(spark: SparkSession, d: str) -> DataFrame:
    """What a search of the index finds of the true neighbours, and whether it compared fewer vectors than there are."""
    index, asked = _vector_index(spark, d), _asked_vectors(spark, d)
    found, true = index.search(asked, 10), v1_knn(spark, d)
    compared = index.candidates(asked, 100).groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("compared"))
    both = true.select("query_id", "id").join(found.select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left")
    row = both.agg(F.countDistinct("query_id").alias("queries"), F.count(F.lit(1)).alias("wanted"), (F.count("hit") >= 0.9 * F.count(F.lit(1))).alias("recall_reached"))
    vectors = _t(spark, d, "embeddings").agg(F.count(F.lit(1)).alias("vectors"))
    return row.crossJoin(vectors).crossJoin(compared).select("queries", "wanted", "recall_reached", "vectors", "compared")  # a row each


def _index(spark: SparkSession, d: str) -> DataFrame:
    """Documents with the vector of their number, where there is one, and their source as base."""
    vectors = _t(spark, d, "embeddings").groupBy(F.col("vec_id").alias("id")).agg(F.first("embedding").alias("embedding"))  # grouped: Spark leaves the join out where no vector is read
    docs = _t(spark, d, "documents").select(F.col("doc_id").alias("id"), "doc_id", F.coalesce("text", F.lit("")).alias("content"), F.array("source").alias("kb_ids"))
    return docs.join(vectors, "id", "left")


def _hybrid_asked(spark: SparkSession, d: str) -> DataFrame:
    vectors = _t(spark, d, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    return _asked(spark, d).join(vectors, "query_id")


def _two_lists(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Of each query the 30 best hits of full text, and the 30 nearest vectors."""
    rows, asked = _index(spark, d), _hybrid_asked(spark, d)
    return TextScan(rows, asked).search(30), vector.knn(rows, asked, 30)


def v3_hybrid_sum(spark: SparkSession, d: str) -> DataFrame:
    return lexical.top_k(fusion.summed(*_two_lists(spark, d)).withColumn("score", F.round("score", 6)), 10)


def v6_rrf(spark: SparkSession, d: str) -> DataFrame:
    return fusion.reciprocal_ranks(*_two_lists(spark, d)).withColumn("score", F.round("score", 9))


def v13_weighted(spark: SparkSession, d: str) -> DataFrame:
    text, near = _two_lists(spark, d)
    return fusion.weighted((text, 0.3), (near, 0.7)).withColumn("score", F.round("score", 9))


def v9_rerank(spark: SparkSession, d: str) -> DataFrame:
    text = TextScan(_contents(spark, d), _asked(spark, d)).search(30)
    return fusion.reranked(text, _contents(spark, d), _asked(spark, d), shared_terms).withColumn("score", F.round("score", 6))


def v11_retrieve(spark: SparkSession, d: str) -> DataFrame:
    found = retrieve(_contents(spark, d), _asked(spark, d), mode="fulltext", k=10, least=0.6)
    return found.withColumn("score", F.round("score", 6))


def v7_hybrid(spark: SparkSession, d: str) -> DataFrame:
    found = retrieve(_index(spark, d), _hybrid_asked(spark, d), mode="hybrid", k=10, least=0.4)
    return found.withColumn("score", F.round("score", 6))


def v7_vector(spark: SparkSession, d: str) -> DataFrame:
    found = retrieve(_index(spark, d), _hybrid_asked(spark, d), mode="vector", k=10, least=0.4)
    return found.withColumn("score", F.round("score", 6))


def v12_bases(spark: SparkSession, d: str) -> DataFrame:
    found = retrieve_bases(_index(spark, d), _hybrid_asked(spark, d), ["src0", "src1", "src2"], k=5, least=0.2)
    return found.withColumn("score", F.round("score", 6))


def v14_doc_ids(spark: SparkSession, d: str) -> DataFrame:
    found = retrieve(_index(spark, d), _hybrid_asked(spark, d), mode="fulltext", k=5, least=0.1, doc_ids=list(range(0, 60, 3)))
    return found.withColumn("score", F.round("score", 6))


def v15_embedding(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of a stand-in model: length, vowels and blanks of a chunk."""
    model = lambda texts: [(len(t), sum(t.count(v) for v in "aeiou"), t.count(" ")) for t in texts]
    found = embedded(_chunks(spark, d), model)
    return found.select("doc_id", "chunk_index", F.md5("content").alias("content"), *[F.get("content_vector", i).alias(f"x{i}") for i in range(3)], "embed_error")


def v11_stored(spark: SparkSession, d: str) -> DataFrame:
    """``v11_retrieve`` from a stored text index."""
    index = TextIndex.create(spark, shared_path(spark, "text-index"), 64)
    index.add(_contents(spark, d))
    found = retrieve(_contents(spark, d), _asked(spark, d), mode="fulltext", k=10, least=0.6, text=index)
    return found.withColumn("score", F.round("score", 6))


def v7_stored(spark: SparkSession, d: str) -> DataFrame:
    """``v7_hybrid`` from stored indexes; all lists are probed and all codes re-ranked, so that the neighbours are exact."""
    rows = _index(spark, d)
    texts = TextIndex.create(spark, shared_path(spark, "text-index"), 64)
    texts.add(rows)
    vectors = VectorIndex.build(rows.where("embedding is not null"), shared_path(spark, "vector-index"))
    every = vectors.about()
    near = lambda q, n: vectors.search(q, n, candidates=every["n"], probes=every["lists"])
    found = retrieve(rows, _hybrid_asked(spark, d), mode="hybrid", k=10, least=0.4, near=near, text=texts)
    return found.withColumn("score", F.round("score", 6))


def v16_doc_chunks(spark: SparkSession, d: str) -> DataFrame:
    df = _chunks(spark, d).where(lexical.matches(F.col("content"), "the of"))
    return df.groupBy("doc_id").agg(F.count(F.lit(1)).alias("hits"), F.min("chunk_index").alias("first_hit"))


# graph: a part and its supplier, extracted from the text of an order


def _answers(spark: SparkSession, d: str) -> DataFrame:
    part, supp = F.concat(F.lit("part-"), F.col("l_partkey").cast("string")), F.concat(F.lit("supp-"), F.col("l_suppkey").cast("string"))
    entity = F.concat(F.lit('("entity"<|>"'), part, F.lit('"<|>"'), "l_returnflag", F.lit('"<|>"'), F.concat(F.lit("x"), F.repeat(F.col("l_linestatus"), F.col("l_linenumber").cast("int"))), F.lit('")'))
    relation = F.concat(F.lit('##("relationship"<|>"'), part, F.lit('"<|>"'), supp, F.lit('"<|>"'), "l_returnflag", F.lit('"<|>"'), "l_linestatus", F.lit('"<|>'), F.col("l_quantity").cast("int").cast("string"), F.lit(")"))
    place = F.struct("_metadata.file_path", "_metadata.row_index").alias("place")  # lines of one number stay in the table's order
    rows = _t(spark, d, "lineitem").select("l_orderkey", F.struct("l_linenumber", place, F.concat(entity, relation).alias("r")).alias("x"))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["r"]), "##")
    return rows.groupBy(F.col("l_orderkey").alias("chunk_index")).agg(joined.alias("answer")).withColumn("chunk_id", F.col("chunk_index").cast("string"))


def _relations(spark: SparkSession, d: str) -> DataFrame:
    return graph.merged_relations(graph.relations(graph.records(_answers(spark, d))))


def g2_parse(spark: SparkSession, d: str) -> DataFrame:
    df = graph.relations(graph.records(_answers(spark, d)))
    return df.select(F.col("source_id"), "src_id", "dst_id", "type", "description", "weight")


def g4_entities(spark: SparkSession, d: str) -> DataFrame:
    df = graph.merged_entities(graph.entities(graph.records(_answers(spark, d))))
    return df.withColumn("source_id", F.array_join("source_id", ","))


def g4_relations(spark: SparkSession, d: str) -> DataFrame:
    return _relations(spark, d).withColumns({"source_id": F.array_join("source_id", ","), "weight": F.round("weight", 6)})


def g6_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Two batches, one after the other, on an empty index; each id comes in both, and parts of even number are entities."""
    found = graph.relations(graph.records(_answers(spark, d)))
    kind = F.when(F.substring("src_id", -1, 1).cast("int") % 2 == 0, "entity").otherwise("relation")
    docs = found.groupBy("type", "src_id").agg(F.avg("weight").alias("weight"), F.max("description").alias("description"), F.sort_array(F.collect_set("dst_id")).alias("source_ids"))
    docs = docs.select(F.col("src_id").alias("id"), kind.alias("graph_type"), "weight", "description", "source_ids", F.when(F.col("type") == "R", 1).when(F.col("type") == "N", 2).otherwise(3).alias("updated_at"))
    docs = kept(docs, "graph-batches")  # two batches, parsed once
    out = graph.upsert_docs(docs.where("updated_at = 1"), docs.where("updated_at > 1"))
    return out.select("id", "graph_type", F.round("weight", 6).alias("weight"), "description", F.array_join("source_ids", ",").alias("source_ids"), "updated_at")


def snk2_graph_docs(spark: SparkSession, d: str) -> DataFrame:
    """The two batches of ``g6_upsert``, merged into a keyed table that holds documents of suppliers as well, which stay untouched."""
    found = graph.relations(graph.records(_answers(spark, d)))
    kind = F.when(F.substring("src_id", -1, 1).cast("int") % 2 == 0, "entity").otherwise("relation")
    docs = found.groupBy("type", "src_id").agg(F.avg("weight").alias("weight"), F.max("description").alias("description"), F.sort_array(F.collect_set("dst_id")).alias("source_ids"))
    docs = docs.select(F.col("src_id").alias("id"), kind.alias("graph_type"), "weight", "description", "source_ids", F.when(F.col("type") == "R", 1).when(F.col("type") == "N", 2).otherwise(3).alias("updated_at"))
    docs = kept(docs, "graph-batches")  # two batches, parsed once
    table = KeyedTable.create(spark, shared_path(spark, "graph-docs"), docs.schema, buckets=8)
    table.put(_t(spark, d, "supplier").select(F.concat(F.lit("supp-"), F.col("s_suppkey").cast("string")).alias("id"), F.lit("entity").alias("graph_type"), F.col("s_acctbal").cast("double").alias("weight"), F.col("s_name").alias("description"), F.array().cast("array<string>").alias("source_ids"), F.lit(0).alias("updated_at")))
    for batch in (docs.where("updated_at = 1"), docs.where("updated_at > 1")):
        tables.put_graph_docs(table, batch)
    out = table.read()
    return out.select("id", "graph_type", F.round("weight", 6).alias("weight"), "description", F.array_join("source_ids", ",").alias("source_ids"), "updated_at")


def _edges(spark: SparkSession, d: str) -> DataFrame:
    part, supp = F.concat(F.lit("part-"), F.col("l_partkey").cast("string")), F.concat(F.lit("supp-"), F.col("l_suppkey").cast("string"))
    return _t(spark, d, "lineitem").select(part.alias("src_id"), supp.alias("dst_id"), F.col("l_quantity").alias("weight")).groupBy("src_id", "dst_id").agg(F.max("weight").alias("weight"))


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    part = _t(spark, d, "part").select(F.concat(F.lit("part-"), F.col("p_partkey").cast("string")).alias("name"), F.col("p_brand").alias("type"))
    return part.unionByName(_t(spark, d, "supplier").select(F.concat(F.lit("supp-"), F.col("s_suppkey").cast("string")).alias("name"), F.lit("supplier").alias("type")))


def g9_graph_view(spark: SparkSession, d: str) -> DataFrame:
    nodes, _ = graph.graph_view(_nodes(spark, d), _edges(spark, d), 500)
    return nodes.select("name", "type", "val")


def g11_links(spark: SparkSession, d: str) -> DataFrame:
    """The links of a view of the graph."""
    _, links = graph.graph_view(_nodes(spark, d), _edges(spark, d), 500)
    return links.select("src_id", "dst_id", "weight")


def g1_gleaned(spark: SparkSession, d: str) -> DataFrame:
    """Up to three answers a document: an entity first, another one if the text is long, and then the mark that ends it."""
    entity = lambda n: F.concat(F.lit('("entity"<|>"'), F.md5(F.concat("content", F.lit(n))), F.lit('"<|>"T"<|>"d")'))
    done = F.lit("<|DONE|>")
    extract = lambda c, so_far: F.when(so_far == "", F.when(F.char_length(c) > 200, entity("1")).otherwise(F.concat(entity("1"), done))).when(~F.contains(so_far, F.lit("##")), entity("2")).otherwise(done)
    found = graph.gleaned(_contents(spark, d).select(F.col("id").alias("chunk_id"), F.col("id").alias("chunk_index"), "content"), extract)
    return graph.entities(graph.records(found)).select("source_id", "record_index", "name", "type", "description")


def g5_search_docs(spark: SparkSession, d: str) -> DataFrame:
    found = graph.merged_entities(graph.entities(graph.records(_answers(spark, d))))
    return graph.search_docs(F.lit("kb"), found).withColumn("source_ids", F.array_join("source_ids", ","))


def a7_degrees(spark: SparkSession, d: str) -> DataFrame:
    return graph.degrees(_edges(spark, d))


def j11_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return graph.neighbours(_edges(spark, d), "supp-1")


def g10_search_nodes(spark: SparkSession, d: str) -> DataFrame:
    return graph.search_nodes(_nodes(spark, d), "pp-1")


def g15_reachable(spark: SparkSession, d: str) -> DataFrame:
    return graph.reachable(_edges(spark, d), "supp-1", 2)


def g14_communities(spark: SparkSession, d: str) -> DataFrame:
    """Communities of parts and suppliers at every level."""
    return communities.communities(_edges(spark, d))


def g14_outline(spark: SparkSession, d: str) -> DataFrame:
    """Communities of nations, linked by the orders that customers of one place with suppliers of another, with their reports' inputs."""
    nation = lambda t, key, name: _t(spark, d, t).select(key, F.col(name).alias("nation"))
    lines = _t(spark, d, "lineitem").join(_t(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    lines = lines.join(nation("customer", "c_custkey", "c_nationkey").withColumnRenamed("nation", "a"), F.col("o_custkey") == F.col("c_custkey")).join(nation("supplier", "s_suppkey", "s_nationkey").withColumnRenamed("nation", "b"), F.col("l_suppkey") == F.col("s_suppkey"))
    edges = lines.groupBy(F.col("a").alias("src_id"), F.col("b").alias("dst_id")).agg(F.sum(F.col("l_quantity").cast("long")).cast("double").alias("weight")).withColumn("description", F.concat_ws(" to ", "src_id", "dst_id"))
    found = communities.communities(edges)
    told = communities.report_inputs(communities.outline(found, edges), found, _t(spark, d, "nation").select(F.col("n_nationkey").alias("name"), F.col("n_name").alias("description")), edges)
    answer = lambda prompt: F.concat(F.lit('Here: {"title": "'), F.md5(prompt), F.lit('", "rating": 5, "findings": []}'))
    out = communities.reports(told, answer)
    return out.select("level", "community", "parent", "n_members", F.round("inside", 3).alias("inside"), F.round("across", 3).alias("across"), F.array_join("members", ",").alias("members"), F.md5("entities").alias("entities"), F.md5("relations").alias("relations"), F.col("report.title").alias("title"))


def _mentions(spark: SparkSession, d: str) -> DataFrame:
    """Kinds of parts by names that are spelt in several ways, as suppliers of their order lines mention them."""
    full = F.concat_ws(" ", F.lower("p_type"), "p_name")
    spelt = F.when(F.col("l_linenumber") % 3 == 0, F.upper(full)).when(F.col("l_linenumber") % 3 == 1, F.replace(full, F.lit(" "), F.lit("-"))).otherwise(full)
    cut = F.when(F.col("l_orderkey") % 4 == 0, F.substring(spelt, F.lit(2), F.char_length(spelt))).otherwise(spelt)
    rows = _t(spark, d, "lineitem").join(_t(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return rows.select(
        F.col("l_orderkey").alias("chunk_index"), F.col("l_linenumber").alias("record_index"), F.col("l_orderkey").cast("string").alias("source_id"), cut.alias("src_id"), F.concat(F.lit("supp-"), F.col("l_suppkey").cast("string")).alias("dst_id"),
        F.col("l_returnflag").alias("type"), F.col("l_linestatus").alias("description"), F.col("l_quantity").cast("double").alias("weight"),
    )


def g14_names(spark: SparkSession, d: str) -> DataFrame:
    return resolution.resolved(_mentions(spark, d), "src_id")


def g14_resolved(spark: SparkSession, d: str) -> DataFrame:
    """Relations of parts, whatever their spelling, with suppliers."""
    found = _mentions(spark, d)
    out = resolution.resolved_relations(found, resolution.resolved(found, "src_id"))
    return out.select("src_id", "dst_id", "type", F.size("source_id").alias("n_sources"), F.md5(F.array_join("source_id", ",")).alias("sources"))


def snk3_keep_last(spark: SparkSession, d: str) -> DataFrame:
    df = _t(spark, d, "events").select("user_id", "event_type", "event_id", "value")
    return graph.keep_last(df, ["user_id", "event_type"], "event_id")


# metadata


def _bases(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "customer").select(
        F.col("c_custkey").alias("kb_id"), F.col("c_nationkey").alias("tenant_id"), (F.col("c_custkey") % 50).alias("created_by"),
        F.when(F.col("c_mktsegment") == "BUILDING", "team").otherwise("me").alias("permission"), F.when(F.col("c_custkey") % 5 > 0, 1).otherwise(0).alias("status"),
        F.col("c_name").alias("name"), F.concat("c_mktsegment", F.lit("@"), (F.col("c_nationkey") % 3).cast("string")).alias("embedding"),
    )


def _members(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "supplier").select(
        (F.col("s_suppkey") % 50).alias("user_id"), F.col("s_nationkey").alias("tenant_id"), F.when(F.col("s_suppkey") % 4 > 0, 1).otherwise(0).alias("status"), F.when(F.col("s_suppkey") % 2 > 0, "owner").otherwise("normal").alias("role")
    )


def f1_filter_page(spark: SparkSession, d: str) -> DataFrame:
    df = catalog.where_given(_t(spark, d, "orders"), o_orderstatus="F", o_orderpriority=None)
    return catalog.page(df.select("o_orderkey", "o_totalprice"), F.desc("o_totalprice"), F.asc("o_orderkey"), number=2, size=25)


def a1_count(spark: SparkSession, d: str) -> DataFrame:
    return catalog.counted(_t(spark, d, "orders"), o_orderstatus="F")


def f3_visible(spark: SparkSession, d: str) -> DataFrame:
    return catalog.visible(_bases(spark, d), _members(spark, d), 7)


def f4_keyword(spark: SparkSession, d: str) -> DataFrame:
    return catalog.keyword(_t(spark, d, "customer").select("c_custkey", "c_name"), "12", "c_name", "c_custkey")


def f5_in_base(spark: SparkSession, d: str) -> DataFrame:
    return catalog.alive(_t(spark, d, "orders"), "P", "o_orderstatus", o_custkey=1).select("o_orderkey", "o_orderstatus")


def f5_in_list(spark: SparkSession, d: str) -> DataFrame:
    return catalog.among(_t(spark, d, "orders"), "o_orderkey", list(range(1, 400, 7)), o_orderstatus="F").select("o_orderkey", "o_custkey")


def f18_name_contains(spark: SparkSession, d: str) -> DataFrame:
    return catalog.name_contains(_t(spark, d, "customer"), "R#0000000", "c_name").select("c_custkey", "c_name")


def f20_own(spark: SparkSession, d: str) -> DataFrame:
    """An update by id and tenant: of ten tries only those with the right tenant change a row."""
    rows = _t(spark, d, "customer").select("c_custkey", "c_nationkey", F.lit("old").alias("status"))
    for key in range(1, 11):
        rows = catalog.updated(rows, catalog.own(key, key, "c_custkey", "c_nationkey") | catalog.own(key * 10, 3, "c_custkey", "c_nationkey"), status="new")
    return rows


def f17_may_list(spark: SparkSession, d: str) -> DataFrame:
    docs = _t(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("kb_id"))
    return catalog.may_list(docs, _bases(spark, d), _members(spark, d), 7)


def f19_patch(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey")
    new = F.when(F.col("n_nationkey") % 2 > 0, F.lit("")).otherwise(F.concat(F.lit("new-"), "n_name"))
    return catalog.patched(rows, rows.where("n_nationkey < 10").select("n_nationkey", new.alias("n_name")), "n_nationkey")


def j1_names(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "customer").select("c_custkey", (F.col("c_nationkey") * 2).alias("nation"))
    return catalog.with_name(rows, _t(spark, d, "nation"), "nation", "n_nationkey", "n_name")


def j3_owners(spark: SparkSession, d: str) -> DataFrame:
    users = _t(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("name"))
    return catalog.owners(_members(spark, d), users)


def j6_models(spark: SparkSession, d: str) -> DataFrame:
    models = _t(spark, d, "nation").select(F.col("n_nationkey").alias("tenant_id"), (F.col("n_nationkey") % 3).cast("string").alias("llm_factory"), F.lit("BUILDING").alias("llm_name"), F.col("n_name").alias("api_key"))
    return catalog.models_of(_bases(spark, d), models).select("kb_id", "tenant_id", "llm_name", "llm_factory", "api_key")


def a3_grouped(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "nation").withColumn("base", F.when(F.col("n_nationkey") % 2 > 0, F.col("n_name")))
    df = catalog.grouped(rows, "n_regionkey", "base", "n_name", "n_nationkey")
    return df.select("n_regionkey", F.array_join(F.transform("items", lambda x: x["n_name"]), ",").alias("names"), "base")


def a12_histogram(spark: SparkSession, d: str) -> DataFrame:
    df = catalog.histogram(_t(spark, d, "events"), "value", [1.0, 5.0, 10.0, 50.0], "event_type")
    return df.withColumn("total", F.round("total", 2))


def a12_families(spark: SparkSession, d: str) -> DataFrame:
    """Every metric from events that stand for calls: of each kind of event another one."""
    events, kb = _t(spark, d, "events"), F.col("user_id") % 3
    of = lambda *kinds: events.where(F.col("event_type").isin(*kinds))
    mode, model, failed = F.when(F.col("event_id") % 2 == 0, "hybrid").otherwise("vector"), F.concat(F.lit("m"), (F.col("user_id") % 2).cast("string")), F.concat(F.lit("e"), (F.col("event_id") % 2).cast("string"))
    seconds = F.col("value") / 16
    seen = [
        metrics.observed(of("click", "view"), "rag_retrieval_duration_seconds", seconds, mode=mode, kb_id=kb), metrics.observed(of("click", "view"), "rag_retrieval_total", mode=mode, kb_id=kb),
        metrics.observed(of("error"), "rag_retrieval_errors_total", mode=mode, kb_id=kb, error_type=failed), metrics.observed(of("click"), "rag_rerank_duration_seconds", seconds, model=model),
        metrics.observed(of("purchase"), "rag_embedding_duration_seconds", seconds, model=model), metrics.observed(of("view"), "rag_chunks_returned", F.floor("value"), mode=mode),
        metrics.observed(of("signup", "purchase"), "rag_indexing_duration_seconds", F.col("value"), kb_id=kb, status=F.col("event_type")), metrics.observed(of("signup"), "rag_indexing_total", kb_id=kb),
        metrics.observed(of("error"), "rag_indexing_errors_total", kb_id=kb, error_type=failed), metrics.observed(of("signup"), "rag_chunks_indexed", F.floor(F.col("value") * 4), kb_id=kb),
    ]
    every = seen[0]
    for more in seen[1:]:
        every = every.unionByName(more)
    return metrics.exposed(every).withColumn("total", F.round("total", 6))


def a13_seq_ids(spark: SparkSession, d: str) -> DataFrame:
    df = catalog.numbered(_t(spark, d, "conversations"), "conv_id", "turn", "role", "text")
    return df.select("conv_id", "turn", "role", "seq_id", T.title(F.coalesce("text", F.lit(""))).alias("title"))


def sc30_parts(spark: SparkSession, d: str) -> DataFrame:
    df = _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber")
    return catalog.in_batches(catalog.in_parts(df, 3, "l_linenumber", by="l_orderkey"), 2, "l_linenumber", by="l_orderkey")


def a15_counters(spark: SparkSession, d: str) -> DataFrame:
    return catalog.counters(_chunks(spark, d), "source")


def t4_latest(spark: SparkSession, d: str) -> DataFrame:
    return catalog.latest(_t(spark, d, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id", 3)


def snk4_single(spark: SparkSession, d: str) -> DataFrame:
    df = tables.single_precision(_t(spark, d, "orders").select("o_orderkey", F.array(F.col("o_totalprice") / 3, F.lit(0.1)).alias("v")), "v")
    return df.select("o_orderkey", F.get("v", 0).cast("double").alias("x"), F.get("v", 1).cast("double").alias("y"))


def snk7_appended(spark: SparkSession, d: str) -> DataFrame:
    """Rows written with their times, more of them appended, and one of them read by its key."""
    path, rows = shared_path(spark, "nations"), _t(spark, d, "nation").select("n_nationkey", "n_name")
    tables.append(tables.audited(rows.where("n_nationkey < 10"), F.lit(100)), path)
    tables.append(tables.audited(rows.where("n_nationkey >= 10"), F.lit(200)), path)
    every = spark.read.parquet(path)
    return tables.without(every, F.col("n_nationkey") == 3).unionByName(tables.point(every, n_nationkey=3).withColumn("n_name", F.upper("n_name")))


def t8_point(spark: SparkSession, d: str) -> DataFrame:
    return tables.point(_t(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), o_orderkey=7)


def sc21_object_keys(spark: SparkSession, d: str) -> DataFrame:
    key = T.object_key((F.col("page_id") % 7).cast("string"), (F.col("page_id") % 3).cast("string"), F.md5("url"), F.regexp_replace("url", r"\?.*$", ""))
    return _t(spark, d, "pages").select("page_id", key.alias("key"))


def src1_files(spark: SparkSession, d: str) -> DataFrame:
    """Names written as a file each, and read as documents."""
    path = shared_path(spark, "files")
    _t(spark, d, "nation").select("n_nationkey", "n_name").write.partitionBy("n_nationkey").text(path)
    found = files.load_texts(spark, f"{path}/*")
    return found.select(F.regexp_extract("path", "n_nationkey=([0-9]+)", 1).cast("int").alias("n_nationkey"), T.trim(F.col("text")).alias("name"), (F.col("doc_id") == F.md5("path")).alias("own_id"))


def snk5_messages(spark: SparkSession, d: str) -> DataFrame:
    """Documents as messages of a topic; rows of nulls are none."""
    own = F.col("o_orderkey") % 5 > 0
    rows = _t(spark, d, "orders").select(*[F.when(own, F.col(c).cast("string")).alias(n) for c, n in (("o_orderkey", "document_id"), ("o_custkey", "knowledge_base_id"))])
    found = messages.as_messages(rows, "document_index")
    return found.select("topic", F.get_json_object("value", "$.document_id").alias("document_id"), F.get_json_object("value", "$.knowledge_base_id").alias("base"))


def snk6_marked(spark: SparkSession, d: str) -> DataFrame:
    """``w7_to_parse`` on a keyed table, of which only the buckets of the named documents are written."""
    table = KeyedTable.create(spark, shared_path(spark, "library"), _library(spark, d).schema, buckets=16)
    table.put(_library(spark, d))
    documents.mark_pending(table, 3, list(range(1, 2000, 2)))
    return table.read().select("id", "run_status", "progress")


def snk8_insert_ignore(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "orders").select("o_custkey")
    new = _t(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"))
    added, refused = catalog.insert_ignore(rows, new, ["o_custkey"])
    return added.withColumn("added", F.lit(True)).unionByName(refused.withColumn("added", F.lit(False)))


def _tasks(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("event_type")
    return _t(spark, d, "events").select(
        F.col("event_id").alias("id"), F.when(kind == "error", "fail").when(kind == "signup", "init").when(kind == "click", "retrying").otherwise("success").alias("status"),
        (F.col("event_id") % 5).cast("int").alias("retry_times"), F.lit(3).alias("max_retry_times"), F.col("ts").alias("next_retry_time"), F.col("ts").alias("created_time"),
    )


def f10_retryable(spark: SparkSession, d: str) -> DataFrame:
    return catalog.retryable(_tasks(spark, d), F.timestamp_seconds(F.lit(1705276800))).select("id", "status", "retry_times")


def st4_failed(spark: SparkSession, d: str) -> DataFrame:
    df = catalog.failed(_tasks(spark, d), F.col("status") == "retrying", F.timestamp_seconds(F.lit(1705276800)))
    return df.select("id", "status", "retry_times", F.unix_seconds("next_retry_time").alias("next_retry"))


def w3_default(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "customer").select("c_custkey", "c_nationkey", F.lit(1).alias("is_default"))
    return catalog.default_of(rows, F.col("c_nationkey") == 3, F.col("c_custkey") == 10)


def w2_compare_and_set(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    return catalog.compare_and_set(rows, F.col("o_orderkey") % 2 == 0, "o_orderstatus", "O", "X")[0]


def w4_cascade(spark: SparkSession, d: str) -> DataFrame:
    docs = _t(spark, d, "orders").select(F.col("o_custkey").alias("kb_id"), F.col("o_orderkey").cast("string").alias("key"))
    chunks = _t(spark, d, "lineitem").join(docs, F.col("l_orderkey") == F.col("key")).select("kb_id", F.concat_ws("-", "key", "l_linenumber").alias("key"))
    left = catalog.cascade_delete(1, _bases(spark, d).select("kb_id", F.col("name").alias("key")), docs, chunks)
    named = [df.select(F.lit(n).alias("name"), "kb_id", "key") for n, df in zip(("bases", "documents", "chunks"), left, strict=True)]
    return named[0].unionByName(named[1]).unionByName(named[2])


def j5_by_factory(spark: SparkSession, d: str) -> DataFrame:
    models = _t(spark, d, "customer").select(
        F.col("c_mktsegment").alias("llm_factory"), F.col("c_name").alias("llm_name"), F.when(F.col("c_custkey") % 2 == 0, "chat").otherwise("embedding").alias("model_type"),
        F.concat("c_name", "c_mktsegment").alias("api_key"), F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("https://host"), F.col("c_custkey").cast("string"), F.lit("/v1"))).alias("api_base"),
    )
    factories = _t(spark, d, "customer").where("c_mktsegment <> 'BUILDING'").select(F.col("c_mktsegment").alias("llm_factory"), F.lower("c_mktsegment").alias("logo")).distinct()
    out = catalog.models_by_factory(models, factories)
    return out.select("llm_factory", "logo", "api_base", F.md5(F.array_join(F.transform("models", lambda m: F.concat_ws(":", m["llm_name"], m["model_type"], m["api_key"])), ",")).alias("models"))


def j8_positions(spark: SparkSession, d: str) -> DataFrame:
    """Results that name hits by their place; places that no hit has are dropped."""
    hits = v1_knn(spark, d)
    results = hits.select("query_id", F.posexplode(F.array(*[F.lit(x) for x in (0.1, 0.2, 0.3)])).alias("k", "score"), F.col("rank").alias("r")).where("r = 1")
    return fusion.by_position(hits, results.select("query_id", (F.col("k") * 5).alias("index"), "score"))


def a14_graph_size(spark: SparkSession, d: str) -> DataFrame:
    return graph.size(_nodes(spark, d), _edges(spark, d))


def g12_name_vectors(spark: SparkSession, d: str) -> DataFrame:
    """A stand-in for a model that fails for some names."""
    embed = lambda name: F.when(name.endswith("7"), None).otherwise(F.array(F.char_length(name).cast("double"), F.octet_length(name).cast("double")))
    return graph.with_name_vectors(_nodes(spark, d), embed).select("name", F.coalesce(F.size("embedding"), F.lit(0)).alias("n"), F.coalesce(F.get("embedding", 0), F.lit(0.0)).alias("first"))


# documents of bases


def _library(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 20).alias("kb_id"), F.concat(F.lit("file"), F.col("o_orderkey").cast("string"), F.lit(".md")).alias("doc_name"), F.lit("md").alias("doc_type"), F.lit(10).cast("long").alias("doc_size"),
        F.when(F.col("o_orderkey") % 3 > 0, F.concat(F.lit("p/"), F.col("o_orderkey").cast("string"))).alias("storage_path"), F.when(F.col("o_orderkey") % 5 > 0, "local").otherwise("web").alias("source_type"), F.lit(1).alias("status"),
        F.when(F.col("o_orderstatus") == "F", "success").when(F.col("o_orderstatus") == "O", "pending").otherwise("indexing").alias("run_status"), F.lit(1.0).alias("progress"), F.lit(0).alias("chunk_num"), F.lit(0).alias("token_num"),
        F.lit(None).cast("string").alias("parser_config"), F.lit(7).alias("created_by"), F.col("o_orderdate").alias("created_time"), F.col("o_orderdate").alias("updated_time"),
    )


def _library_chunks(spark: SparkSession, d: str) -> DataFrame:
    own = _library(spark, d).select(F.col("id").alias("doc_id"), "kb_id")
    rows = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("chunk_index"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"), F.concat_ws(" ", "l_returnflag", "l_linestatus").alias("content"), F.lit(0.0).alias("create_timestamp_flt"))
    return rows.join(own, "doc_id")


def f16_listed(spark: SparkSession, d: str) -> DataFrame:
    df = documents.listed(documents.within_base(_library(spark, d), 3, list(range(1, 2000, 2))))
    return df.select("id", "kb_id", "doc_name", "storage_path", "parser_config", "run_status")


def v16_chunk_page(spark: SparkSession, d: str) -> DataFrame:
    return documents.chunk_page(_library_chunks(spark, d), 7, "R N", number=1, size=3).select("id", "chunk_index", "content")


def v17_deleted_chunks(spark: SparkSession, d: str) -> DataFrame:
    gone = _library(spark, d).where("id % 2 = 0").select(F.col("id").alias("doc_id"))
    return documents.deleted_chunks(_library_chunks(spark, d), 3, gone).select("kb_id", "id")


def w5_cleared(spark: SparkSession, d: str) -> DataFrame:
    rows, chunks, paths = documents.cleared(_library(spark, d), _library_chunks(spark, d), 3)
    named = [df.select(F.lit(n).alias("name"), F.col(c).cast("string").alias("key")) for n, df, c in (("documents", rows, "id"), ("chunks", chunks, "id"), ("paths", paths, "storage_path"))]
    return named[0].unionByName(named[1]).unionByName(named[2])


def w6_uploads(spark: SparkSession, d: str) -> DataFrame:
    """Orders as uploads, their lines as files."""
    files = _t(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("upload_id"), F.when(F.col("l_linenumber") == 5, " ").otherwise(F.concat(F.lit("a.b"), F.col("l_linenumber").cast("string"), F.when(F.col("l_linenumber") % 2 == 0, ".PDF").otherwise("x"))).alias("name"), (F.col("l_quantity") * 600000).cast("long").alias("size")
    )
    taken, refused = documents.admitted(files, {"kb_id": 5, "tenant_id": 2}, "u", F.lit(0))
    return taken.groupBy("doc_type", F.lit("").alias("reason")).agg(F.count(F.lit(1)).alias("n"), F.sum("doc_size").alias("bytes")).unionByName(refused.groupBy(F.lit("").alias("doc_type"), "reason").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes")))


def w7_to_parse(spark: SparkSession, d: str) -> DataFrame:
    rows, out = documents.to_parse(_library(spark, d), 3, list(range(1, 2000, 2)), "u", 2)
    return rows.select("id", "run_status", "progress").join(out.select(F.col("document_id").cast("long").alias("id"), F.lit(1).alias("sent")), "id", "left").fillna(0, "sent")


def st5_to_index(spark: SparkSession, d: str) -> DataFrame:
    out = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("document_id"))  # each document is named once a line
    return documents.to_index(out, _library(spark, d)).select("id", "run_status")


def st3_republished(spark: SparkSession, d: str) -> DataFrame:
    payload = F.when(F.col("id") % 11 == 0, "{broken").otherwise(F.to_json(F.struct(F.col("id").cast("string").alias("document_id"))))
    tasks = _tasks(spark, d).withColumns({"payload": payload, "task_type": F.when(F.col("id") % 3 == 0, "document_index").when(F.col("id") % 3 == 1, "graph_generate").otherwise("other")})
    after, out = catalog.republished(tasks, F.timestamp_seconds(F.lit(1705276800)), messages.TOPICS)
    return after.select("id", "status").join(out.select("id", "topic", F.get_json_object("value", "$.local_message_id").alias("message_id")), "id", "left")


def sc23_register(spark: SparkSession, d: str) -> DataFrame:
    mail = F.when(F.col("c_custkey") % 7 > 0, F.concat(F.lit("a"), F.col("c_custkey").cast("string"), F.lit("@x.org"))).otherwise("no mail")
    word = F.substring("c_name", 1, (F.col("c_custkey") % 12).cast("int"))
    rows = _t(spark, d, "customer").select("c_custkey", F.repeat(F.lit("n"), (F.col("c_custkey") % 60).cast("int")).alias("nick"), mail.alias("mail"), word.alias("word"), F.when(F.col("c_custkey") % 5 > 0, word).otherwise("other").alias("again"))
    return rows.select("c_custkey", T.may_register(F.col("nick"), F.col("mail"), F.col("word"), F.col("again")).alias("broken"), T.is_strong(F.col("word")).alias("strong"))


def sc25_times(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "events").select("event_id", T.millis(F.col("ts")).alias("millis"), T.shown_time(F.col("ts")).alias("shown"), T.rfc3339(F.col("ts")).alias("rfc"))


def sc28_prompts(spark: SparkSession, d: str) -> DataFrame:
    text = prompts.filled(prompts.QUESTIONS, base=F.col("source"), n=3, content=F.col("text"))
    return _t(spark, d, "documents").select("doc_id", F.md5(text).alias("prompt"), F.size(T.tags(F.regexp_replace(F.coalesce("text", F.lit("")), " ", ","))).alias("n_tags"))


def c9_agentic_split(spark: SparkSession, d: str) -> DataFrame:
    """A finder that answers a cut behind every sentence of a length that 7 divides, and nothing readable for some windows."""
    item = lambda s: F.concat(F.lit('{"is_boundary": '), F.when(F.char_length(s) % 7 == 0, "true").otherwise("false"), F.lit(', "header": ""}'))
    find = lambda s: F.when(F.size(s) % 5 == 4, "sorry").otherwise(F.concat(F.lit("["), F.array_join(F.transform(F.slice(s, F.lit(1), F.greatest(F.size(s) - 1, F.lit(0))), item), ", "), F.lit("]")))
    return split.agentic_split(_t(spark, d, "documents"), find, most=300)


def c10_preview(spark: SparkSession, d: str) -> DataFrame:
    marked = F.regexp_replace("text", r"(?m)^([A-Za-z]{4}) ", "## $1 ")
    return split.preview(_t(spark, d, "documents").select("doc_id", marked.alias("text")), "markdown").withColumn("content", F.md5("content"))


# streams


def st1_messages(spark: SparkSession, d: str) -> DataFrame:
    """Events as messages through a stream; malformed ones are dropped; batches are written by id."""
    events = spark.readStream.schema(_t(spark, d, "events").schema).parquet(f"{d}/events*.parquet")
    body = F.when(F.col("event_type") == "error", F.lit("{broken")).otherwise(F.to_json(F.struct(F.col("event_id").cast("string").alias("document_id"), F.col("event_type").alias("tenant_id"))))
    out, marks = shared_path(spark, "messages"), shared_path(spark, "messages-log")
    found = messages.parsed(events.select(body.alias("value")), schemas.INDEX_MESSAGE, "document_id")
    messages.run_batches(found, lambda df, n: df.write.mode("overwrite").parquet(f"{out}/batch={n}"), marks).awaitTermination()
    return spark.read.parquet(out).select("document_id", "tenant_id")


def st2_task_states(spark: SparkSession, d: str) -> DataFrame:
    """State of each user's task after all outcomes."""
    events = spark.readStream.schema(_t(spark, d, "events").schema).parquet(f"{d}/events*.parquet")
    kind = F.col("event_type")
    outcome = F.when(kind == "error", "fail").when(kind == "signup", "success").when(kind == "click", "retrying")
    outcomes = events.select(F.col("user_id").alias("id"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("at"), outcome.alias("outcome")).where("outcome is not null")
    out, marks = shared_path(spark, "states"), shared_path(spark, "states-log")
    write = lambda df, n: df.withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{out}/part={n}")
    messages.run_batches(outbox.task_states(outcomes), write, marks, mode="update").awaitTermination()
    return graph.keep_last(spark.read.parquet(out).drop("part"), ["id"], "batch").drop("batch")


def src7_folder(spark: SparkSession, d: str) -> DataFrame:
    """Events as lines of files in a folder, streamed from it; lines that can't be read are dropped."""
    path, out, marks = (shared_path(spark, n) for n in ("folder", "lines", "lines-log"))
    body = F.when(F.col("event_id") % 10 == 0, "{broken").otherwise(F.to_json(F.struct(F.col("event_id").cast("string").alias("document_id"), F.col("event_type").alias("tenant_id"))))
    _t(spark, d, "events").select(body.alias("value")).repartition(4).write.text(path)
    found = messages.parsed(messages.read_folder(spark, path, 1), schemas.INDEX_MESSAGE, "document_id")
    messages.run_batches(found, lambda df, n: df.write.mode("overwrite").parquet(f"{out}/batch={n}"), marks).awaitTermination()
    return spark.read.parquet(out).select("document_id", "tenant_id")


def st2_task_timers(spark: SparkSession, d: str) -> DataFrame:
    """State of each user's task after all outcomes, by keyed state with timers; those with tries left have become due by themselves."""
    events = spark.readStream.schema(_t(spark, d, "events").schema).parquet(f"{d}/events*.parquet")
    kind = F.col("event_type")
    outcome = F.when(kind == "error", "fail").when((kind == "signup") & (F.col("user_id") % 3 == 0), "success").when((kind == "click") & (F.col("user_id") % 3 == 1), "retrying")
    key = F.col("user_id") * 1000 + F.dayofyear("ts")  # a task a day, so that some have few failures
    outcomes = events.select(key.alias("id"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("at"), outcome.alias("outcome")).where("outcome is not null")
    out, marks = shared_path(spark, "timers"), shared_path(spark, "timers-log")
    write = lambda df, n: df.withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{out}/part={n}")
    messages.run_until_idle(stateful.timed_tasks(outcomes), write, marks, mode="update")
    found = graph.keep_last(spark.read.parquet(out).drop("part").select("id", F.struct("batch", "due").alias("at"), "status", "retry_times", "next_retry"), ["id"], "at")
    return found.select("id", "status", "retry_times", "next_retry", F.col("at.due").alias("due"))


def st3_scan(spark: SparkSession, d: str) -> DataFrame:
    """What three scans of the tasks send, the second of which is handled twice."""
    payload = F.when(F.col("id") % 11 == 0, "{broken").otherwise(F.to_json(F.struct(F.col("id").cast("string").alias("document_id"))))
    tasks = _tasks(spark, d).withColumns({"payload": payload, "task_type": F.when(F.col("id") % 3 == 0, "document_index").when(F.col("id") % 3 == 1, "graph_generate").otherwise("other")})
    table = KeyedTable.create(spark, shared_path(spark, "tasks"), tasks.schema, buckets=8)
    table.put(tasks)
    out = shared_path(spark, "sent")
    scan = retries.RetryScan(table, shared_path(spark, "scan"), lambda df: df.write.mode("append").parquet(out), now=lambda: F.timestamp_seconds(F.lit(1705276800)))
    for batch in (0, 1, 1, 2):
        scan.handle(None, batch)
    sent = spark.read.parquet(out).groupBy("id", "topic").agg(F.count(F.lit(1)).alias("times"))
    return sent.join(table.read().select("id", "status"), "id")


def st6_batches(spark: SparkSession, d: str) -> DataFrame:
    """Events of each kind in batches of 400 by count, the rest by time."""
    events = spark.readStream.schema(_t(spark, d, "events").schema).parquet(f"{d}/events*.parquet")
    out, marks = shared_path(spark, "batches"), shared_path(spark, "batches-log")
    write = lambda df, n: df.write.mode("overwrite").parquet(f"{out}/part={n}")
    messages.run_until_idle(stateful.count_or_time(events, "event_type", "event_id", 400, 1), write, marks, idle=4)
    found = spark.read.parquet(out)
    ids = found.select("key", "batch", "full", F.size("items").alias("n"), F.explode("items").alias("item"))
    return ids.groupBy("key", "batch", "full", "n").agg(F.countDistinct("item").alias("different")).select(F.col("key").alias("event_type"), "batch", "full", "n", "different")


def st5_pending_once(spark: SparkSession, d: str) -> DataFrame:
    """Messages of a stream that names documents many times: each that is pending is taken once."""
    events = spark.readStream.schema(_t(spark, d, "events").schema).parquet(f"{d}/events*.parquet")
    named = events.select(F.to_json(F.struct(F.col("user_id").cast("string").alias("document_id"), "ts")).alias("value"))
    found = messages.parsed(named, "document_id string, ts timestamp", "document_id")
    taken = messages.for_pending(messages.once(found, "document_id", "ts", "400 days"), _library(spark, d))
    out, marks = shared_path(spark, "taken"), shared_path(spark, "taken-log")
    messages.run_batches(taken, lambda df, n: df.write.mode("overwrite").parquet(f"{out}/part={n}"), marks).awaitTermination()
    return spark.read.parquet(out).groupBy("document_id").agg(F.count(F.lit(1)).alias("times"))


def snk1_put_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Two sets of documents' chunks, a third of the documents in both, put into the same bases one after the other and read again."""
    path = shared_path(spark, "chunks")
    part = F.coalesce(F.pmod("doc_id", F.lit(3)), F.lit(0))
    df = _chunks(spark, d).select(T.chunk_id(F.col("content"), F.col("doc_id")).alias("id"), F.col("source").alias("kb_id"), "content", F.col("chunk_index").cast("double").alias("create_timestamp_flt"), part.alias("part"))
    tables.put_chunks(df.where("part < 2").drop("part"), path)
    tables.put_chunks(df.where("part > 0").drop("part"), path)
    return spark.read.parquet(path).select("kb_id", "id", F.char_length("content").alias("chars"), "create_timestamp_flt")


def queries() -> dict[str, Query]:
    """Every query of this module by name."""
    return {k: f for k, f in globals().items() if callable(f) and getattr(f, "__module__", "") == __name__ and not k.startswith("_") and k != "queries"}
