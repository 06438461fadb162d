"""Documents into chunks: by structure, by Markdown headers, by size and by topic boundaries.

Structure is found inside a row with higher-order functions, so splitting needs no shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from lorewell.functions import text as T

#: Header names of parts that have none, the separators tried in order, and the patterns of headers.
NO_HEADER, PREAMBLE = "无标题", "前言/摘要"
SEPARATORS = ["\n\n", "\n", "。", "！", "？", ".", "!", "?", " "]
NUMBERED = r"^([0-9]+\.)+\s+(.+)$"
#: characters of rows that a task holds before they go on, and values of an Arrow batch that it holds as Python objects
OUT, BATCH = 1_000_000, 64
CHINESE = r"^第[一二三四五六七八九十百千0-9]+[章节部分条款]\s*(.*)$"


def header_of(line: Column) -> Column:
    """(level, title, kind) of a trimmed line; kind is null for plain text."""
    dots = F.regexp_count(F.substring_index(line, " ", 1), F.lit(r"\."))
    plain = (line == "") | (F.char_length(line) >= 50) | T.last_char(line).isin(T.NO_HEADER_ENDS)
    numbered, chinese = line.rlike(NUMBERED), line.rlike(CHINESE)
    return F.struct(
        F.when(numbered, F.greatest(dots, F.lit(1))).when(chinese, 1).otherwise(2).cast("int").alias("level"),
        F.when(numbered, F.regexp_extract(line, NUMBERED, 2)).otherwise(line).alias("title"),
        F.when(numbered, "numbered").when(chinese, "chinese").when(~plain, "heuristic").alias("kind"),
    )


def headers(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with lines and headers (line, level, title, kind) in order.

    A guessed header counts only on the last line or above a blank one.
    """
    lines = F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")
    df = docs.withColumn("lines", lines).withColumn("bare", F.transform("lines", T.trim))
    found = F.transform(
        "bare",
        lambda x, i: F.struct(i.alias("line"), header_of(x).alias("h"), (F.coalesce(F.get(F.col("bare"), i + 1), F.lit("")) == "").alias("open")),
    )
    true = F.filter(found, lambda x: x["h"]["kind"].isNotNull() & ((x["h"]["kind"] != "heuristic") | x["open"]))
    flat = F.transform(true, lambda x: F.struct(x["line"].alias("line"), x["h"]["level"].alias("level"), x["h"]["title"].alias("title"), x["h"]["kind"].alias("kind")))
    return df.withColumn("headers", flat).drop("bare")


def _sectioned(docs: DataFrame, id_col: str, text_col: str, *more: str) -> DataFrame:
    """doc_id, ``more``, sections: array of (header_context, header_level, header_type, content)."""
    df = headers(docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *more))
    part = lambda name, level, kind, content: F.struct(name.alias("header_context"), level.alias("header_level"), kind.alias("header_type"), content.alias("content"))
    between = lambda a, b: F.array_join(F.slice("lines", a + 1, b - a), "\n")
    implicit, zero = F.lit("implicit"), F.lit(0)
    first = F.get("headers", 0)["line"]
    before = between(F.lit(0), first)
    preamble = F.when((first > 0) & (T.trim(before) != ""), F.array(part(F.lit(PREAMBLE), zero, implicit, before))).otherwise(F.array())
    rest = F.transform(
        "headers",
        lambda h, k: part(h["title"], h["level"], h["kind"], T.trim(between(h["line"], F.coalesce(F.get(F.col("headers"), k + 1)["line"], F.size("lines"))))),
    )
    every = F.when(F.size("headers") == 0, F.array(part(F.lit(NO_HEADER), zero, implicit, F.col("text")))).otherwise(F.concat(preamble, rest))
    return df.select("doc_id", *more, every.alias("sections"))


def sections(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, section_index, header_context, header_level, header_type, content; one row per section.

    An empty or null text is one empty section.
    """
    return exploded(_sectioned(docs, id_col, text_col), "sections", "section_index", "s").select("doc_id", "section_index", "s.*")


def exploded(df: DataFrame, column: str, place: str, item: str) -> DataFrame:
    """A row for each item of a computed array, beside the other columns.

    Of a plain ``posexplode`` Spark infers that the array isn't empty, and pushes that filter below the projection that
    computes the array, which is then computed twice. The outer form gives no such filter.
    """
    others = [c for c in df.columns if c != column]
    return df.select(*others, F.posexplode_outer(column).alias(place, item)).where(F.col(place).isNotNull())


def pieces_of(text: str, separators: Sequence[str], size: int, overlap: int) -> list[str]:
    """Pieces of at most ``size`` characters: the coarsest separator first, finer ones for what is too long.

    Neighbours are joined again while they fit; a piece starts with up to ``overlap`` characters of its
    predecessor, as far as it has room. Without separators left, text is cut at ``size``.
    """
    if len(text) <= size:
        return [text] if text.strip() else []
    if not separators:
        step = max(1, size - overlap)
        return [text[i : i + size] for i in range(0, max(1, len(text) - overlap), step)]
    mark, out, held = separators[0], [], ""
    for part in text.split(mark):
        if not part.strip():
            continue
        if len(part) > size:
            out += [held] if held else []
            out += pieces_of(part, separators[1:], size, overlap)
            held = ""
        elif not held:
            held = part
        elif len(held) + len(mark) + len(part) <= size:
            held += mark + part
        else:
            out.append(held)
            tail = held[-overlap:] if overlap else ""
            held = tail + part if len(tail) + len(part) <= size else part
    return out + ([held] if held else [])


def by_document(df: DataFrame, cut: Callable[[dict], Iterable[dict]], kinds: str) -> DataFrame:
    """The rows that ``cut`` makes of each row of ``df``, in order, one row of ``df`` after another.

    Only one row of ``df`` is Python objects at a time, and rows go on once they hold ``OUT`` characters, so a task's memory
    is bounded by an Arrow batch and a document.
    """
    schema = to_arrow_schema(StructType.fromDDL(kinds))
    width = [f.name for f in schema if pa.types.is_string(f.type)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                for row in cut(batch.slice(i, 1).to_pylist()[0]):
                    held.append(row)
                    size += 32 + sum(len(row[c] or "") for c in width)
                    if size >= OUT:
                        yield pa.RecordBatch.from_pylist(held, schema)
                        held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, schema)

    return df.mapInArrow(run, kinds)


def by_value(values: pa.Array, cut: Callable[[object], list | None], kind: pa.DataType) -> pa.Array:
    """``cut`` of each value; Python objects of ``BATCH`` values are held at a time, not those of an Arrow batch."""
    done = [pa.array([cut(v) for v in values.slice(at, BATCH).to_pylist()], kind) for at in range(0, len(values), BATCH)]
    return pa.concat_arrays(done) if done else pa.array([], kind)


def recursive_split(text: Column, size: int, overlap: int = 0, separators: Sequence[str] = tuple(SEPARATORS)) -> Column:
    """array<string> of pieces, by Arrow batches."""

    @F.arrow_udf("array<string>")
    def split(texts: pa.Array) -> pa.Array:
        return by_value(texts, lambda t: pieces_of(t or "", separators, size, overlap), pa.list_(pa.string()))

    return split(text)


def _numbered(df: DataFrame, name: str, size: int, overlap: int) -> DataFrame:
    """Splits ``content``; short ones never leave the JVM."""
    short = F.char_length("content") <= size
    whole = df.where(short).withColumn("piece", F.lit(0))
    cut = df.where(~short).select(*[c for c in df.columns if c != "content"], F.posexplode(recursive_split(F.col("content"), size, overlap)).alias("piece", "content"))
    by = Window.partitionBy("doc_id").orderBy(name, "piece")
    return whole.unionByName(cut).withColumn("chunk_index", F.row_number().over(by) - 1).drop("piece")


def structure_split(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 500, overlap: int = 0) -> DataFrame:
    """Chunks of at most ``size`` characters, each with its section's header.

    Sections are cut and numbered inside their document's row, in one scan, so no text is shuffled; of documents of at
    most ``size`` characters nothing is handed to Python.
    """

    @F.arrow_udf("array<array<string>>")
    def cut(contents: pa.Array) -> pa.Array:
        pieces = lambda cs: None if cs is None else [[c] if len(c) <= size else pieces_of(c, SEPARATORS, size, overlap) for c in cs]
        return by_value(contents, pieces, pa.list_(pa.list_(pa.string())))

    def chunk(s: Column, content: Column) -> Column:
        return F.struct(*[s[c].alias(c) for c in ("section_index", "header_context", "header_level", "header_type")], content.alias("content"))

    fits = F.coalesce(F.char_length(text_col), F.lit(0)) <= size
    named = F.transform("sections", lambda s, i: F.struct(i.alias("section_index"), *[s[c].alias(c) for c in ("header_context", "header_level", "header_type", "content")]))
    df = _sectioned(docs.withColumn("_fits", fits), id_col, text_col, "_fits").select("doc_id", "_fits", named.alias("named"))
    df = df.withColumn("pieces", cut(F.when(~F.col("_fits"), F.transform("named", lambda s: s["content"]))))
    chunks = F.flatten(F.zip_with("named", "pieces", lambda s, ps: F.transform(ps, lambda p: chunk(s, p))))
    df = df.select("doc_id", F.when(F.col("_fits"), F.col("named")).otherwise(chunks).alias("c"))
    return exploded(df, "c", "chunk_index", "c").select("doc_id", "c.*", "chunk_index")


def markdown_sections(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, section_index, h1 to h4 and content; headers stay in their text, fenced code holds none."""
    lines = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")).alias("i", "line"))
    so_far = Window.partitionBy("doc_id").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    fences = F.sum(F.when(F.col("line").rlike(r"^\s*```"), 1).otherwise(0)).over(so_far)
    mark = F.when((F.col("fences") % 2 == 0) & F.col("line").rlike(r"^#{1,4}\s+\S"), F.length(F.regexp_extract("line", "^(#+)", 1)))
    df = lines.withColumn("fences", fences).withColumn("mark", mark)
    df = df.withColumn("section_index", F.sum(F.when(F.col("mark").isNotNull(), 1).otherwise(0)).over(so_far).cast("int"))
    name = T.trim(F.regexp_replace("line", r"^#+\s+", ""))
    at = {n: F.last(F.when(F.col("mark") == n, F.struct("i", name.alias("name"))), ignorenulls=True).over(so_far) for n in (1, 2, 3, 4)}
    df = df.withColumns({f"at{n}": x for n, x in at.items()})
    shown = lambda n: F.when(F.col(f"at{n}.i") > F.greatest(F.lit(-1), F.lit(-1), *[F.coalesce(F.col(f"at{m}.i"), F.lit(-1)) for m in range(1, n)]), F.col(f"at{n}.name"))
    df = df.withColumns({f"h{n}": shown(n) for n in (1, 2, 3, 4)})
    content = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "line"))), lambda x: x["line"]), "\n")
    out = df.groupBy("doc_id", "section_index").agg(*[F.max_by(f"h{n}", "i").alias(f"h{n}") for n in (1, 2, 3, 4)], T.trim(content).alias("content"))
    return out.where((F.col("content") != "") | (F.col("section_index") == 0))


def split_documents(docs: DataFrame, path_col: str, id_col: str = "doc_id", text_col: str = "text", size: int = 500, overlap: int = 0) -> DataFrame:
    """Markdown files by their headers, all others by structure."""
    md = F.coalesce(T.is_markdown(F.col(path_col)), F.lit(False))
    marked = markdown_sections(docs.where(md), id_col, text_col)
    level = sum((F.when(F.col(f"h{n}").isNotNull(), 1).otherwise(0) for n in (1, 2, 3, 4)), F.lit(0))
    deepest = F.coalesce(*[F.col(f"h{n}") for n in (4, 3, 2, 1)], F.lit(NO_HEADER))
    marked = marked.select("doc_id", "section_index", deepest.alias("header_context"), level.alias("header_level"), F.lit("markdown").alias("header_type"), "content")
    return _numbered(marked, "section_index", size, overlap).unionByName(structure_split(docs.where(~md), id_col, text_col, size, overlap))


def sentence_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 20) -> DataFrame:
    """doc_id, window_index, first, sentences: windows that share a sentence, as a boundary finder reads them."""
    df = docs.select(F.col(id_col).alias("doc_id"), T.atoms(F.coalesce(F.col(text_col), F.lit(""))).alias("s")).where(F.size("s") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("s") - 2, F.lit(0)), F.lit(size - 1))
    return df.select("doc_id", "s", F.posexplode(starts).alias("window_index", "first")).select("doc_id", "window_index", "first", F.slice("s", F.col("first") + 1, size).alias("sentences"))


BOUNDARY = "array<struct<is_boundary:boolean,header:string>>"


def found_boundaries(windows: DataFrame, find: Callable[[Column], Column]) -> DataFrame:
    """doc_id, sentences, boundaries: what ``find`` answers for each window, joined in order.

    ``find`` is an expression or pandas UDF from a window's sentences to a JSON list of (is_boundary, header). Where an
    answer can't be read, or is too short, every gap that it leaves is a boundary.
    """
    list_of = T.json_list(F.coalesce(find(F.col("sentences")), F.lit("")))
    gaps = F.size("sentences") - 1
    cut = F.transform(F.sequence(F.lit(0), gaps), lambda i: F.coalesce(F.get(F.coalesce(F.from_json(list_of, BOUNDARY), F.array().cast(BOUNDARY)), i), F.struct(F.lit(True).alias("is_boundary"), F.lit("").alias("header"))))
    df = windows.select("doc_id", "window_index", "sentences", F.slice(cut, F.lit(1), gaps).alias("cut"))
    part = F.struct("window_index", "sentences", "cut")
    df = df.groupBy("doc_id").agg(F.sort_array(F.collect_list(part)).alias("w"))
    # neighbouring windows share a sentence
    said = F.flatten(F.transform("w", lambda x, i: F.when(i == 0, x["sentences"]).otherwise(F.slice(x["sentences"], F.lit(2), F.greatest(F.size(x["sentences"]) - 1, F.lit(0))))))
    return df.select("doc_id", said.alias("sentences"), F.flatten(F.transform("w", lambda x: x["cut"])).alias("boundaries"))


def agentic_split(docs: DataFrame, find: Callable[[Column], Column], id_col: str = "doc_id", text_col: str = "text", most: int = 500, overlap: int = 0) -> DataFrame:
    """doc_id, chunk_index, chunk_id, content: topics that ``find`` tells apart; texts of one sentence or none stay as they are."""
    df = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    many = F.size(T.atoms(F.col("text"))) > 1
    whole = df.where(~many).select("doc_id", F.lit(0).alias("chunk_index"), F.col("doc_id").cast("string").alias("chunk_id"), F.col("text").alias("content"))
    return topic_split(found_boundaries(sentence_windows(df.where(many)), find), most, overlap).unionByName(whole)


def preview(docs: DataFrame, kind: str, id_col: str = "doc_id", text_col: str = "text", size: int = 500, overlap: int = 0) -> DataFrame:
    """doc_id, chunk_index, content as a document of type ``markdown`` or ``text`` would be cut."""
    if kind == "markdown":
        return markdown_sections(docs, id_col, text_col).select("doc_id", F.col("section_index").alias("chunk_index"), "content")
    if kind == "text":
        pieces = recursive_split(F.coalesce(F.col(text_col), F.lit("")), size, overlap)
        return docs.select(F.col(id_col).alias("doc_id"), F.posexplode(pieces).alias("chunk_index", "content"))
    raise ValueError(f"no preview of {kind!r}")


def topic_chunks(sentences: Sequence[str], cuts: Sequence[tuple[bool, str]], most: int, overlap: int) -> list[str]:
    """Sentences joined up to topic boundaries and ``most`` characters; missing boundaries count as cuts."""
    out, header = [], ""
    held = sentences[0] if len(sentences) else ""
    emit = lambda: out.append(f"【{header}】\n{held}" if header else held)
    for before, sentence, (topic, name) in zip(sentences, sentences[1:], [*cuts, *[(True, "")] * len(sentences)], strict=False):
        if not topic and len(held) + len(sentence) + 1 <= most:
            held += f" {sentence}"
            continue
        emit()
        carried = f"{before[-overlap:]} " if overlap and len(held) > overlap and not topic else ""
        header = name if topic else header
        held = carried + sentence
    if held:
        emit()
    return out


def topic_split(docs: DataFrame, most: int = 500, overlap: int = 0) -> DataFrame:
    """doc_id, chunk_index, chunk_id, content from (doc_id, sentences, boundaries: array of (is_boundary, header))."""

    def join(row: dict) -> Iterator[dict]:
        cuts = [(bool(x), header or "") for x, header in zip(row["cuts"], row["names"], strict=True)]
        for i, content in enumerate(topic_chunks(row["sentences"] or [], cuts, most, overlap)):
            yield {"doc_id": row["doc_id"], "chunk_index": i, "content": content}

    cuts = F.coalesce("boundaries", F.array().cast(BOUNDARY))
    rows = docs.select("doc_id", "sentences", F.transform(cuts, lambda x: x["is_boundary"]).alias("cuts"), F.transform(cuts, lambda x: x["header"]).alias("names"))
    out = by_document(rows, join, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, chunk_index int, content string")
    return out.select("doc_id", "chunk_index", F.concat(F.col("doc_id").cast("string"), F.lit("_chunk_"), (F.col("chunk_index") + 1).cast("string")).alias("chunk_id"), "content")
