"""Network sources as Spark data sources. Each page of a paged service is a partition, so pages are fetched in parallel and lost ones again.

A fetcher turns (query, offset, size) into records of the document schema; it is given by the caller, as no network is assumed here.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import DOCUMENT, DOCUMENT_DDL

#: Records of a page by service. Fixed values.
PAGE_SIZES = {"pubmed": 200, "arxiv": 100, "hal": 100, "istex": 100, "isidore": 100, "searx": 10}
MAX_PAGES = {"searx": 100}


def istex_query(query: str, lang: str = "en") -> str:
    """A bare query as one over abstracts in a language; a query with fields stays."""
    return query if ":" in query else f'language:"{lang}" AND abstract:({query})'


def read_pages(spark: SparkSession, fetch: Callable[[str, int, int], list[dict]], query: str, *, service: str = "pubmed", limit: int | None = None, total: int | None = None) -> DataFrame:
    """Documents of a paged service: `total` is the number of hits that it states, `limit` bounds them by its own order. One of both is needed."""
    size = PAGE_SIZES.get(service, 100)
    if total is None and limit is None:
        raise ValueError("give the service's number of hits (total), or a limit")
    wanted = min(x for x in (total, limit) if x is not None)
    pages = min(-(-wanted // size), MAX_PAGES.get(service, 1 << 30))
    names = [f.name for f in DOCUMENT]

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for pdf in batches:
            for p in pdf["id"].tolist():
                records = fetch(query, p * size, min(size, wanted - p * size))
                if records:
                    yield pd.DataFrame([{n: r.get(n) for n in names} for r in records], columns=names).astype(object)

    return spark.range(0, pages, 1, max(1, min(pages, 64))).mapInPandas(run, DOCUMENT_DDL)


def article_text(pages: DataFrame, html: str = "html") -> DataFrame:
    """The text of a page's paragraphs, as a crawler of articles keeps it: native expressions only."""
    inner = F.regexp_extract_all(F.col(html), F.lit(r"(?is)<p\b[^>]*>(.*?)</p>"), F.lit(1))
    plain = F.transform(inner, lambda p: F.trim(F.regexp_replace(F.regexp_replace(p, r"<[^>]*>", ""), r"\s+", " ")))
    return pages.withColumn("text", F.array_join(F.filter(plain, lambda p: p != ""), "\n"))
