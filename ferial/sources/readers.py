"""Readers: calendar CSV, JSON documents, scripture, HTML caches, XML, Markdown and text."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ferial import schemas
from ferial.functions.text import squash


def calendar_csv(spark: SparkSession, paths: str | list[str], fields: int = 5) -> DataFrame:
    """Rows of calendar CSV files with at least ``fields`` fields whose first begins like a date; ``src`` is the file.

    The files are multi-line CSV, without header, quotes doubled.
    """
    raw = spark.read.csv(paths, schema=schemas.CALENDAR_CSV, header=False, multiLine=True, quote='"', escape='"')
    names = schemas.CALENDAR_CSV.split(", ")
    needed = names[fields - 1].split()[0]
    return raw.withColumn("src", F.col("_metadata.file_path")).where(F.col("date").rlike(r"^\d{4}-\d{2}-\d{2}")).where(F.col(needed).isNotNull() | (F.lit(fields) <= 2))


def keep_last(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Of rows with equal keys the last in ``order``; later deliveries overwrite earlier ones. Partial aggregates before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    last = df.groupBy(*keys).agg(F.max(F.struct(*[c.alias(f"__o{i}") for i, c in enumerate(order)], F.struct(*rest).alias("__row"))).alias("__m"))
    return last.select(*keys, "__m.__row.*").select(*df.columns)


def json_by_key(spark: SparkSession, path: str, value: str, key: str = "key") -> DataFrame:
    """``key, value`` of documents that are one object keyed by strings; ``value`` is the DDL of the values.

    Files that cannot be read or parsed are skipped; ``malformed`` names them.
    """
    docs = spark.read.option("ignoreCorruptFiles", True).text(path, wholetext=True)
    parsed = F.from_json("value", f"map<string,{value}>")
    return docs.select(F.explode(parsed).alias(key, "value"))


def malformed(spark: SparkSession, path: str) -> DataFrame:
    """``file`` of every document that is no JSON object; files that cannot be read are errors here. ``json_by_key`` passes over them."""
    docs = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    return docs.where(F.coalesce(F.from_json("value", "map<string,string>").isNull(), F.lit(True))).select("file")


def days_on(days: DataFrame, date: str) -> DataFrame:
    """A point read of a table partitioned by ``month``: only that month's files are listed."""
    return days.where((F.col("month") == date[:7]) & (F.col("date") == F.lit(date).cast("date")))


def optional(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON source that may be missing: an empty table of its schema then."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(conf).globStatus(p):
        return spark.read.schema(schema).json(path, multiLine=True)
    return spark.createDataFrame([], schema)


def scripture(spark: SparkSession, root: str) -> DataFrame:
    """``translation, book, ch, v, text`` of ``root/translation/book.json`` files of ``{chapter: {verse: text}}``."""
    docs = spark.read.text(f"{root}/*/*.json", wholetext=True).withColumn("__p", F.col("_metadata.file_path"))
    parts = docs.select(
        F.regexp_extract("__p", r"([^/]+)/[^/]+\.json$", 1).alias("translation"),
        F.url_decode(F.regexp_extract("__p", r"([^/]+)\.json$", 1)).alias("book"),
        F.explode(F.from_json("value", "map<string,map<string,string>>")).alias("ch", "verses"),
    )
    out = parts.select("translation", "book", F.col("ch").try_cast("int").alias("ch"), F.explode("verses").alias("v", "text"))
    return out.select("translation", "book", "ch", F.col("v").try_cast("int").alias("v"), F.rtrim(F.regexp_replace("text", r"^[⁰¹²³⁴-⁹]+\s*", "")).alias("text"))


def chapter_arrays(docs: DataFrame, body: str, book: str) -> DataFrame:
    """``book, ch, v, text`` of bodies ``{chapters: [{chapter, verses: [{verse, text}]}]}``; markup in the text dropped."""
    shape = "struct<chapters:array<struct<chapter:int,verses:array<struct<verse:int,text:string>>>>>"
    chapters = docs.select(F.col(book).alias("book"), F.inline(F.from_json(body, shape).getField("chapters")))
    verses = chapters.select("book", F.col("chapter").alias("ch"), F.inline("verses"))
    return verses.select("book", "ch", F.col("verse").alias("v"), squash(F.regexp_replace("text", r"<[^>]*>", "")).alias("text"))


def usfx_paragraphs(spark: SparkSession, path: str) -> DataFrame:
    """``book, ch, first_v``: the first verse of every paragraph of USFX files."""
    books = spark.read.format("binaryFile").load(path).select(F.col("content").cast("string").alias("x"))
    book = books.select(F.explode(F.regexp_extract_all("x", F.lit(r'(?s)<book id="[^"]+".*?</book>'), F.lit(0))).alias("b"))
    named = book.select(F.regexp_extract("b", r'<book id="([^"]+)"', 1).alias("book"), F.posexplode(F.regexp_extract_all("b", F.lit(r"<(?:c|v)\s[^>]*>|<p(?:\s[^>]*)?>"), F.lit(0))).alias("i", "t"))
    kind = F.regexp_extract("t", r"^<([cpv])", 1)
    ident = F.regexp_extract("t", r'id="(\d+)"', 1).try_cast("int")
    w = Window.partitionBy("book").orderBy("i")
    rows = named.withColumn("kind", kind).withColumn("ch", F.last(F.when(kind == "c", ident), ignorenulls=True).over(w))
    rows = rows.withColumn("p", F.sum((F.col("kind") == "p").cast("int")).over(w)).withColumn("v", F.when(F.col("kind") == "v", ident))
    return rows.where("kind = 'v' AND p > 0").groupBy("book", "ch", "p").agg(F.min_by("v", "i").alias("first_v")).select("book", "ch", "first_v").distinct()


def html_by_id(df: DataFrame, html: str, ids: list[str]) -> DataFrame:
    """``df`` with the squashed text of the first element with each id; null without one. Void elements do not nest."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + "".join(f", `{i}` string" for i in ids)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [_texts(x, ids) for x in b[html]]
            for i in ids:
                b[i] = [f.get(i) for f in found]
            yield b

    return df.mapInPandas(run, schema)


_VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"))


class _Texts(HTMLParser):
    def __init__(self, ids: list[str]):
        super().__init__(convert_charrefs=True)
        self.ids, self.done, self.open = set(ids), {}, []

    def handle_starttag(self, tag, attrs):
        if tag in _VOID:
            for o in self.open:
                o[2].append(" " if tag == "br" else "")
            return
        for o in self.open:
            o[1] += 1
        name = dict(attrs).get("id")
        if name in self.ids and name not in self.done and all(o[0] != name for o in self.open):
            self.open.append([name, 1, []])

    def handle_endtag(self, tag):
        if tag in _VOID:
            return
        for o in self.open:
            o[1] -= 1
            if o[1] == 0:
                self.done[o[0]] = " ".join("".join(o[2]).split())
        self.open = [o for o in self.open if o[1] > 0]

    def handle_data(self, data):
        for o in self.open:
            o[2].append(data)


def _texts(html: str | None, ids: list[str]) -> dict[str, str]:
    p = _Texts(ids)
    p.feed(html or "")
    p.close()
    for name, _, parts in p.open:
        p.done.setdefault(name, " ".join("".join(parts).split()))
    return p.done


def fenced_blocks(df: DataFrame, doc: str, pos: str, line: str) -> DataFrame:
    """``doc, block, heading, body`` of fenced blocks in Markdown lines; the heading is the last one above."""
    w = Window.partitionBy(doc).orderBy(pos)
    fence = F.col(line).startswith("```")
    out = df.withColumn("__f", F.sum(fence.cast("int")).over(w)).withColumn("heading", F.last(F.when((F.col("__f") % 2 == 0) & F.col(line).rlike(r"^#+ "), F.regexp_replace(line, r"^#+\s+", "")), ignorenulls=True).over(w))
    body = out.where((F.col("__f") % 2 == 1) & ~fence)
    block = ((F.col("__f") + 1) / 2).cast("int")
    return body.groupBy(doc, block.alias("block")).agg(F.first("heading").alias("heading"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(pos, line))), lambda x: x[line]), "\n").alias("body"))


def table_rows(df: DataFrame, line: str) -> DataFrame:
    """The cells of pipe-table rows; separator rows are left out."""
    rows = df.where(F.col(line).rlike(r"^\s*\|.*\|\s*$") & ~F.col(line).rlike(r"^\s*\|[\s:|-]+\|\s*$"))
    return rows.withColumn("cells", F.transform(F.split(F.regexp_replace(line, r"^\s*\||\|\s*$", ""), r"\|"), lambda x: F.trim(x)))


def string_or_object(c: Column, field: str = "citation") -> Column:
    """The text of a variant that is a string or an object with ``field``."""
    return F.coalesce(F.try_variant_get(c, f"$.{field}", "string"), F.when(F.schema_of_variant(c) == "STRING", F.try_variant_get(c, "$", "string")))
