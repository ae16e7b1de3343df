"""Records of paged services as documents: answers are columns of text, taken apart by expressions, so each page is a row and pages are read in parallel.

An answer that can't be parsed gives no records. Dates are what can be read of them; missing fields are null.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .readers import as_documents

#: Fields of the services' answers that are read. Fixed values of their formats.
PUBMED = (
    "PubmedArticle array<struct<MedlineCitation:struct<PMID:string,Article:struct<Journal:struct<Title:string>,ArticleTitle:string,Abstract:struct<AbstractText:array<string>>,"
    "AuthorList:struct<Author:array<struct<LastName:string,ForeName:string,AffiliationInfo:array<struct<Affiliation:string>>>>>,ArticleDate:struct<Year:int,Month:int,Day:int>,Language:string>>>>"
)
ARXIV = "entry array<struct<id:string,title:string,summary:string,published:string,author:array<struct<name:string>>,doi:string>>"
HAL = "response struct<numFound:long,docs:array<struct<docid:string,title_s:array<string>,abstract_s:array<string>,source_s:string,authFullName_s:array<string>,instStructName_s:array<string>,submittedDate_s:string,uri_s:string,language_s:array<string>>>>"
ISTEX = "total long, hits array<struct<id:string,title:string,abstract:string,author:array<struct<name:string,affiliations:array<string>>>,publicationDate:string,host:struct<title:string>,language:array<string>>>"
ISIDORE = "response struct<replies:struct<content:struct<reply:array<struct<isidore:struct<url:string,title:string,abstract:string,creators:array<string>,date:string,source:string,language:string>>>>>>"
BINDINGS = "head struct<vars:array<string>>, results struct<bindings:array<map<string,struct<type:string,value:string>>>>"


def _dated(text: Column) -> dict[str, Column]:
    """A date from the beginning of a text: a year, with month and day if they are there."""
    parts = [F.nullif(F.regexp_extract(text, p, 1), F.lit("")).try_cast("int") for p in (r"^(\d{4})", r"^\d{4}-(\d{2})", r"^\d{4}-\d{2}-(\d{2})")]
    return _ymd(*parts)


def _ymd(year: Column, month: Column, day: Column) -> dict[str, Column]:
    m, d = F.coalesce(month, F.lit(1)), F.coalesce(day, F.lit(1))
    pad = lambda c, n: F.lpad(c.cast("string"), n, "0")
    return {"publication_year": year, "publication_month": F.when(year.isNotNull(), m), "publication_day": F.when(year.isNotNull(), d), "publication_date": F.when(year.isNotNull(), F.concat_ws("-", pad(year, 4), pad(m, 2), pad(d, 2)))}


def _flat(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def _each(answers: DataFrame, column: str, parsed: Column, path: str) -> DataFrame:
    return answers.select(parsed.alias("_a")).select(F.explode(F.col(f"_a.{path}")).alias("r"))


def pubmed(answers: DataFrame, column: str = "answer") -> DataFrame:
    r = _each(answers, column, F.from_xml(F.col(column), PUBMED), "PubmedArticle").select(F.col("r.MedlineCitation.PMID").alias("id"), "r.MedlineCitation.Article.*")
    name = lambda a: F.concat_ws(" ", a["ForeName"], a["LastName"])
    places = F.array_distinct(F.flatten(F.transform("AuthorList.Author", lambda a: F.coalesce(F.transform(a["AffiliationInfo"], lambda i: i["Affiliation"]), F.array().cast("array<string>")))))
    return as_documents(
        r, bdd=F.lit("PubMed"), doi=F.col("id"), title=_flat(F.col("ArticleTitle")), abstract=_flat(F.array_join("Abstract.AbstractText", " ")), source=F.col("Journal.Title"), authors=F.array_join(F.transform("AuthorList.Author", name), ", "),
        institutes=F.array_join(places, ", "), language_iso2=F.col("Language"), **_ymd(F.col("ArticleDate.Year"), F.col("ArticleDate.Month"), F.col("ArticleDate.Day")),
    )


def arxiv(answers: DataFrame, column: str = "answer") -> DataFrame:
    r = _each(answers, column, F.from_xml(F.col(column), ARXIV), "entry").select("r.*")
    return as_documents(r, bdd=F.lit("Arxiv"), doi=F.col("doi"), url=F.col("id"), title=_flat(F.col("title")), abstract=_flat(F.col("summary")), source=F.lit("Arxiv"), authors=F.array_join(F.transform("author", lambda a: a["name"]), ", "), **_dated(F.col("published")))


def hal(answers: DataFrame, column: str = "answer") -> DataFrame:
    r = _each(answers, column, F.from_json(F.col(column), HAL), "response.docs").select("r.*")
    first = lambda c: F.get(F.col(c), F.lit(0))
    return as_documents(r, bdd=F.lit("Hal"), doi=F.col("docid"), url=F.col("uri_s"), title=F.array_join("title_s", " "), abstract=F.array_join("abstract_s", " "), source=F.col("source_s"), authors=F.array_join("authFullName_s", ", "), institutes=F.array_join("instStructName_s", ", "), language_iso2=first("language_s"), **_dated(F.col("submittedDate_s")))


def istex(answers: DataFrame, column: str = "answer") -> DataFrame:
    r = _each(answers, column, F.from_json(F.col(column), ISTEX), "hits").select("r.*")
    places = F.array_distinct(F.flatten(F.transform("author", lambda a: F.coalesce(a["affiliations"], F.array().cast("array<string>")))))
    return as_documents(r, bdd=F.lit("Istex"), doi=F.col("id"), title=F.col("title"), abstract=F.col("abstract"), source=F.col("host.title"), authors=F.array_join(F.transform("author", lambda a: a["name"]), ", "), institutes=F.array_join(places, ", "), language_iso2=F.get("language", F.lit(0)), **_dated(F.col("publicationDate")))


def isidore(answers: DataFrame, column: str = "answer") -> DataFrame:
    r = _each(answers, column, F.from_json(F.col(column), ISIDORE), "response.replies.content.reply").select("r.isidore.*")
    return as_documents(r, bdd=F.lit("Isidore"), url=F.col("url"), title=F.col("title"), abstract=F.col("abstract"), source=F.col("source"), authors=F.array_join("creators", ", "), language_iso2=F.col("language"), **_dated(F.col("date")))


#: The services by name.
SERVICES: dict[str, Callable[..., DataFrame]] = {"pubmed": pubmed, "arxiv": arxiv, "hal": hal, "istex": istex, "isidore": isidore}


def documents(answers: DataFrame, service: str, column: str = "answer") -> DataFrame:
    """Documents of a service's answers."""
    if service not in SERVICES:
        raise ValueError(f"unknown service {service}; known: {', '.join(SERVICES)}")
    return SERVICES[service](answers, column)


def bindings(answers: DataFrame, *names: str, column: str = "answer") -> DataFrame:
    """Rows of an answer to a graph query (SPARQL results as JSON): the value of each name, null where it is optional and missing."""
    r = _each(answers, column, F.from_json(F.col(column), BINDINGS), "results.bindings")
    return r.select(*[F.col("r")[n]["value"].alias(n) for n in names])


def isidore_query(words: str, limit: int) -> str:
    """Documents of an archive of the humanities whose title holds the words, newest first, as a graph query."""
    word = words.replace("\\", "\\\\").replace('"', '\\"')
    return (
        "PREFIX dcterms: <http://purl.org/dc/terms/> PREFIX dc: <http://purl.org/dc/elements/1.1/> SELECT DISTINCT ?resource ?title ?date ?abstract ?agent ?source ?lang WHERE { "
        "?resource dcterms:title ?title ; dcterms:date ?date . OPTIONAL { ?resource dcterms:abstract ?abstract } OPTIONAL { ?resource dcterms:creator ?agent } "
        f'OPTIONAL {{ ?resource dcterms:source ?source }} OPTIONAL {{ ?resource dc:language ?lang }} FILTER contains(?title, "{word}") }} ORDER BY DESC(?date) LIMIT {int(limit)}'
    )


def wikidata_query(entity: str, limit: int) -> str:
    """Members of a class with their English page, as a graph query."""
    if not entity.startswith("Q") or not entity[1:].isdigit():
        raise ValueError("an entity is Q and a number")
    return f'SELECT DISTINCT ?uri ?itemLabel WHERE {{ ?item wdt:P31/wdt:P279* wd:{entity} . ?uri schema:about ?item ; schema:isPartOf <https://en.wikipedia.org/> . SERVICE wikibase:label {{ bd:serviceParam wikibase:language "en" }} }} LIMIT {int(limit)}'
