"""Readers: every format as a DataFrame of the document schema (model.DOCUMENT_DDL). Nothing is inferred; bad records don't stop a read.

Tagged text formats are read as whole records by Spark's own splitter and taken apart by expressions, so a
large file is many tasks. Archives are read as binary rows; each entry becomes a row.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import file_date, int_or_decimal, sentences
from ..model import DEFAULT_DATE, DOCUMENT_FIELDS, RIS_FIELDS, WOS_FIELDS

CSV_COLUMNS = ["title", "source", "publication_year", "publication_month", "publication_day", "abstract", "authors"]
HAL_COLUMNS = "title source publication_year publication_month publication_day abstract authors url isbn_s issue_s journalPublisher_s language_s doiId_s authId_i instStructId_i deptStructId_i labStructId_i rteamStructId_i docType_s".split()


def as_documents(df: DataFrame, **columns: Column) -> DataFrame:
    """The document schema from given columns; the others are null."""
    return df.select(*[columns.get(n, F.lit(None)).cast(t).alias(n) for n, t in DOCUMENT_FIELDS.items()])


def with_date(year: Column, month: Column, day: Column) -> dict[str, Column]:
    y, m, d = (F.coalesce(int_or_decimal(x), F.lit(k)) for x, k in zip((year, month, day), DEFAULT_DATE))
    return {"publication_year": y, "publication_month": m, "publication_day": d, "publication_date": F.concat_ws("-", y.cast("string"), F.lpad(m.cast("string"), 2, "0"), F.lpad(d.cast("string"), 2, "0"))}


def _csv(spark: SparkSession, path, names: list[str], sep: str) -> DataFrame:
    return spark.read.csv(path, header=True, sep=sep, multiLine=True, escape='"', quote='"')


def read_csv(spark: SparkSession, path) -> DataFrame:
    """A corpus as CSV: commas, or tabs where the comma gives none of the columns; headers in any case."""
    df = _csv(spark, path, CSV_COLUMNS, ",")
    low = {c.strip().lower().replace(" ", "_"): c for c in df.columns}
    if "title" not in low:
        df = _csv(spark, path, CSV_COLUMNS, "\t")
        low = {c.strip().lower().replace(" ", "_"): c for c in df.columns}
    missing = [c for c in ("title", "abstract") if c not in low]
    if missing:
        raise ValueError(f"columns missing: {missing}")
    c = lambda n: F.col(f"`{low[n]}`") if n in low else F.lit(None).cast("string")
    return as_documents(df, title=c("title"), source=c("source"), abstract=c("abstract"), authors=c("authors"), bdd=F.lit("CSV"), **with_date(c("publication_year"), c("publication_month"), c("publication_day")))


def read_csv_columns(spark: SparkSession, path, columns: list[str]) -> DataFrame:
    """(text): the chosen fields of each row of a corpus CSV, joined by spaces."""
    return read_csv(spark, path).select(F.concat_ws(" ", *columns).alias("text"))


def read_csv_hal(spark: SparkSession, path) -> DataFrame:
    df = _csv(spark, path, HAL_COLUMNS, "\t")
    c = lambda n: F.col(n) if n in df.columns else F.lit(None).cast("string")
    return as_documents(df, title=c("title"), source=c("source"), abstract=c("abstract"), authors=c("authors"), url=c("url"), doi=c("doiId_s"), institutes=c("instStructId_i"), language_iso2=c("language_s"), bdd=F.lit("HAL"), **with_date(c("publication_year"), c("publication_month"), c("publication_day")))


def read_csv_weighted(spark: SparkSession, path) -> DataFrame:
    """A tab-separated corpus with a weight for each document."""
    df = _csv(spark, path, [*CSV_COLUMNS, "weight"], "\t")
    dates = with_date(*(F.col(f"publication_{x}") for x in ("year", "month", "day")))
    return df.select("title", "source", "abstract", "authors", *[v.alias(k) for k, v in dates.items()], F.coalesce(F.col("weight").try_cast("double"), F.lit(1.0)).alias("weight"))


CORPUS_JSON = "documents array<struct<document:struct<id:long,hash:string,name:string,hyperdata:struct<bdd:string,doi:string,url:string,title:string,authors:string,institutes:string,source:string,abstract:string,publication_date:string,publication_year:int,publication_month:int,publication_day:int,language_iso2:string>>,ngrams:struct<ngrams:array<string>,hash:string>,hash:string>>, garg_version string"


def read_json(spark: SparkSession, path) -> DataFrame:
    """A corpus as one JSON object of documents with their terms and hashes."""
    h = spark.read.schema(CORPUS_JSON).json(path, multiLine=True).select(F.explode("documents").alias("d")).select("d.document.hyperdata.*")
    return as_documents(h, **{c: F.col(c) for c in h.columns})


def tagged_records(spark: SparkSession, path, end: str) -> DataFrame:
    """Texts of records that a line ends."""
    return spark.read.text(path, lineSep=end).select(F.regexp_replace("value", "\r", "").alias("record")).where(F.trim("record") != "")


def field_bag(record: Column, pattern: str, joiner: str) -> Column:
    """A map from tag to value: repeated tags are joined. pattern: group 1 the tag, group 2 the text up to the next tag."""
    tags, values = F.regexp_extract_all(record, F.lit(pattern), F.lit(1)), F.regexp_extract_all(record, F.lit(pattern), F.lit(2))
    pairs = F.arrays_zip(tags.alias("k"), F.transform(values, lambda v: F.regexp_replace(F.regexp_replace(v, r"^\s+|\s+$", ""), r"\s*\n\s*", joiner)).alias("v"))
    keys = F.array_distinct(tags)
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.array_join(F.transform(F.filter(pairs, lambda p: p["k"] == k), lambda p: p["v"]), joiner)))


def bag_documents(df: DataFrame, names: dict[str, str], bdd: str) -> DataFrame:
    """The document schema from a column `bag` of tags; dates are what can be parsed, else null."""
    value = lambda n: F.coalesce(*[F.element_at("bag", F.lit(t)) for t, x in names.items() if x == n], F.lit(None).cast("string"))
    date = file_date(F.coalesce(value("publication_date"), value("publication_year"), value("date")))
    year = F.coalesce(F.year(date), int_or_decimal(F.regexp_extract(F.coalesce(value("publication_year"), value("date"), F.lit("")), r"(\d{4})", 1)))
    return as_documents(
        df, title=value("title"), source=value("source"), authors=value("authors"), institutes=value("institutes"), doi=value("doi"), url=value("url"), abstract=value("abstract"), bdd=F.lit(bdd),
        publication_year=year, publication_month=F.month(date), publication_day=F.dayofmonth(date), publication_date=F.date_format(date, "yyyy-MM-dd"), language_iso2=value("language"),
    )


def read_wos(spark: SparkSession, path) -> DataFrame:
    """Tagged records that a line ER ends: two-letter tags at line starts, continuation lines indented."""
    r = tagged_records(spark, path, "\nER")
    bag = field_bag(F.col("record"), r"(?m)^([A-Z][A-Z0-9]) (.*(?:\n   .*)*)", " ")
    return bag_documents(r.select(bag.alias("bag")).where(F.map_contains_key("bag", "TI")), WOS_FIELDS, "WOS")


def read_ris(spark: SparkSession, path, *, press: bool = False) -> DataFrame:
    """Tagged records `TY  - ` to `ER  - `. In press records the date is dd/mm/yyyy, and the longer of title and summary is the abstract."""
    r = tagged_records(spark, path, "ER  -")
    bag = field_bag(F.col("record"), r"(?m)^([A-Z][A-Z0-9])  - ?(.*(?:\n(?![A-Z][A-Z0-9]  -).*)*)", "; ")
    df = r.select(bag.alias("bag")).where(F.size("bag") > 0)
    out = bag_documents(df.where(F.map_contains_key("bag", "TY")), RIS_FIELDS, "RIS")
    if not press:
        return out
    v = lambda t: F.element_at("bag", F.lit(t))
    date = F.try_to_timestamp(v("DA"), F.lit("dd/MM/yyyy"))
    longer = F.when(F.length(F.coalesce(v("TI"), F.lit(""))) > F.length(F.coalesce(v("N2"), F.lit(""))), v("TI")).otherwise(v("N2"))
    return as_documents(df, title=v("TI"), source=v("JF"), authors=v("AU"), abstract=longer, language_iso2=v("LA"), bdd=F.lit("RISPress"), publication_year=F.year(date), publication_month=F.month(date), publication_day=F.dayofmonth(date), publication_date=F.date_format(date, "yyyy-MM-dd"))


def read_iramuteq(spark: SparkSession, path) -> DataFrame:
    """Records that begin with **** and a line of *name_value marks: (marks map, text)."""
    r = spark.read.text(path, lineSep="**** ").where(F.trim("value") != "")
    head, body = F.split("value", "\n", 2)[0], F.get(F.split("value", "\n", 2), F.lit(1))
    marks = F.regexp_extract_all(head, F.lit(r"\*([^_\s]+)_(\S+)"), F.lit(1)), F.regexp_extract_all(head, F.lit(r"\*([^_\s]+)_(\S+)"), F.lit(2))
    return r.select(F.map_from_arrays(*marks).alias("marks"), F.regexp_replace(body, r"^\s+|\s+$", "").alias("text"))


def read_wikimedia(spark: SparkSession, path) -> DataFrame:
    """Pages of an XML dump: title and the plain text of the latest revision."""
    schema = "title string, revision array<struct<text:struct<_VALUE:string>>>"
    p = spark.read.format("xml").option("rowTag", "page").schema(schema).load(path)
    return as_documents(p.select("title", plain_wikitext(F.element_at("revision", -1)["text"]["_VALUE"]).alias("t")), title=F.col("title"), abstract=F.col("t"), bdd=F.lit("Wikimedia"))


def plain_wikitext(text: Column) -> Column:
    for pattern, new in ((r"(?s)<!--.*?-->", ""), (r"(?s)<ref[^>]*?(?:/>|>.*?</ref>)", ""), (r"(?s)\{\{[^{}]*\}\}", ""), (r"(?s)\{\{[^{}]*\}\}", ""), (r"(?s)\{\|.*?\|\}", ""), (r"\[\[(?:[^\]|]*\|)?([^\]]*)\]\]", "$1"), (r"\[https?://\S+ ?([^\]]*)\]", "$1"), (r"'{2,}", ""), (r"(?m)^=+\s*(.*?)\s*=+$", "$1"), (r"<[^>]+>", "")):
        text = F.regexp_replace(text, pattern, new)
    return F.trim(text)


def read_questionnaires(spark: SparkSession, path) -> DataFrame:
    """An array of questionnaires with titled answers: those over ten characters, joined."""
    schema = "id string, reference string, title string, createdAt string, authorName string, responses array<struct<questionId:string,questionTitle:string,value:string,formattedValue:string>>"
    d = spark.read.schema(schema).json(path, multiLine=True)
    long = F.filter(F.transform("responses", lambda r: r["formattedValue"]), lambda x: F.length(x) > 10)
    date = F.try_to_timestamp(F.col("createdAt"))
    return as_documents(d, title=F.col("title"), authors=F.col("authorName"), abstract=F.array_join(long, " . "), publication_year=F.year(date), publication_month=F.month(date), publication_day=F.dayofmonth(date), publication_date=F.date_format(date, "yyyy-MM-dd"), bdd=F.lit("GrandDebat"))


def read_patents(spark: SparkSession, path) -> DataFrame:
    d = spark.read.schema("id string, title string, abstract string, year string").json(path, multiLine=True)
    return as_documents(d, title=F.col("title"), abstract=F.col("abstract"), source=F.col("id"), bdd=F.lit("Patents"), **with_date(F.col("year"), F.lit("1"), F.lit("1")))


def read_books(spark: SparkSession, path, *, size: int = 10) -> DataFrame:
    """Text files named authors_source: each cut into publications of so many sentences."""
    t = spark.read.text(path, wholetext=True).select("value", F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.[a-z]+)?$", 1).alias("name"))
    parts = t.select("name", sentences("value").alias("s")).where(F.size("s") > 0)
    rows = parts.select("name", F.posexplode(F.transform(F.sequence(F.lit(1), F.size("s"), F.lit(size)), lambda i: F.array_join(F.slice("s", i, size), " "))).alias("k", "text"))
    return as_documents(rows, title=F.concat("name", F.lit(" "), (F.col("k") + 1).cast("string")), authors=F.regexp_replace(F.split("name", "_")[0], "-", " "), source=F.get(F.split("name", "_"), F.lit(1)), abstract=F.col("text"), bdd=F.lit("Book"))


def read_notes(spark: SparkSession, path) -> DataFrame:
    """Collaborative notes: lines authors:, date:, source:, the first line as title, the rest as text."""
    t = spark.read.text(path, wholetext=True)
    field = lambda n: F.nullif(F.trim(F.regexp_extract("value", rf"(?mi)^\^?@@?{n}:?(.*)$|^{n}:(.*)$", 2)), F.lit(""))
    lines = F.filter(F.split("value", "\n"), lambda x: (F.trim(x) != "") & ~x.rlike("(?i)^(authors|date|source):"))
    date = file_date(field("date"))
    return as_documents(t, title=F.get(lines, F.lit(0)), authors=field("authors"), source=field("source"), abstract=F.array_join(F.slice(lines, 2, 1_000_000), " "), publication_year=F.year(date), publication_month=F.month(date), publication_day=F.dayofmonth(date), publication_date=F.date_format(date, "yyyy-MM-dd"), bdd=F.lit("Note"))


def read_contacts(spark: SparkSession, path) -> DataFrame:
    """A directory of contacts, tab-separated: nested who, where, touch."""
    d = spark.read.csv(path, header=True, sep="\t")
    c = lambda n: F.col(n) if n in d.columns else F.lit(None).cast("string")
    return d.select(F.struct(c("id").alias("id"), c("firstName").alias("firstName"), c("lastName").alias("lastName")).alias("who"), F.array(F.struct(c("organization").alias("organization"), c("lab").alias("lab"), c("role").alias("role"))).alias("where"), F.struct(c("mail").alias("mail"), c("phone").alias("phone"), c("url").alias("url")).alias("touch"))


def read_term_list(spark: SparkSession, path) -> DataFrame:
    """(term, size, list, root, parent, children) from status, label and forms parted by |&|."""
    d = spark.read.csv(path, header=True, sep="\t").select(F.lower(F.trim("status")).alias("status"), F.trim("label").alias("label"), "forms")
    kind = F.when(F.col("status") == "map", "MapTerm").when(F.col("status") == "stop", "StopTerm").otherwise("CandidateTerm")
    forms = F.filter(F.transform(F.split(F.coalesce("forms", F.lit("")), r"\|&\|"), lambda f: F.trim(f)), lambda f: f != "")
    d = d.withColumn("children", F.array_remove(forms, F.col("label"))).withColumn("list", kind)
    size = lambda c: F.size(F.split(c, " "))
    own = d.select(F.col("label").alias("term"), size(F.col("label")).alias("size"), "list", F.lit(None).cast("string").alias("root"), F.lit(None).cast("string").alias("parent"), "children")
    below = d.select(F.explode("children").alias("term"), "list", F.col("label").alias("root"))
    return own.unionByName(below.select("term", size(F.col("term")).alias("size"), "list", "root", F.col("root").alias("parent"), F.array().cast("array<string>").alias("children")))


def read_archive(spark: SparkSession, path, pattern: str = "") -> DataFrame:
    """(archive, entry, content) of every entry of ZIP files; an entry that can't be read fails the job."""
    b = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for p, content in zip(pdf["path"], pdf["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for info in z.infolist():
                        if not info.is_dir() and pattern in info.filename:
                            yield pd.DataFrame({"archive": [p], "entry": [info.filename], "content": [z.read(info).decode("utf-8", "replace")]})

    return b.mapInPandas(run, "archive string, entry string, content string")


#: The formats by name.
READERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "Csv": read_csv, "CsvHal": read_csv_hal, "CsvWeighted": read_csv_weighted, "Json": read_json, "WOS": read_wos, "RIS": read_ris, "RISPress": lambda s, p: read_ris(s, p, press=True), "Iramuteq": read_iramuteq,
    "Wikimedia": read_wikimedia, "GrandDebat": read_questionnaires, "Patents": read_patents, "Book": read_books, "Note": read_notes, "Contacts": read_contacts, "TermList": read_term_list, "Archive": read_archive,
}


def read(spark: SparkSession, kind: str, path) -> DataFrame:
    if kind not in READERS:
        raise ValueError(f"unknown format {kind}; known: {', '.join(READERS)}")
    return READERS[kind](spark, path)


def stream_csv(spark: SparkSession, path, *, sep: str = "\t") -> DataFrame:
    """The corpus CSV as a stream of its files."""
    schema = ", ".join(f"{c} string" for c in CSV_COLUMNS)
    d = spark.readStream.schema(schema).csv(path, header=True, sep=sep)
    return as_documents(d, title=F.col("title"), source=F.col("source"), abstract=F.col("abstract"), authors=F.col("authors"), bdd=F.lit("CSV"), **with_date(F.col("publication_year"), F.col("publication_month"), F.col("publication_day")))


def exploded(docs: DataFrame, *, size: int = 7) -> DataFrame:
    """Each abstract as titled paragraphs of so many sentences and half as many of the next."""
    from ..functions.text import titled_paragraphs

    p = docs.withColumn("_p", F.explode(titled_paragraphs("abstract", size)))
    return p.withColumn("title", F.col("_p.title")).withColumn("abstract", F.col("_p.text")).drop("_p")


def split_long(docs: DataFrame, *, most: int = 1000, size: int = 3) -> DataFrame:
    """Abstracts of more than so many characters cut into windows of sentences; others as they are."""
    s = sentences("abstract")
    parts = F.when(F.length("abstract") > most, F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(s)), F.lit(size)), lambda i: F.array_join(F.slice(s, i, size), " "))).otherwise(F.array("abstract"))
    return docs.withColumn("abstract", F.explode(parts))
