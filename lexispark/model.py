"""The data model: schemas and enumerations, declared by hand so that nothing is inferred from data."""

from __future__ import annotations

from pyspark.sql import types as T

#: A document as readers return it; all fields can be null.
DOCUMENT_FIELDS = {
    "bdd": "string", "doi": "string", "url": "string", "page": "int", "title": "string", "authors": "string", "institutes": "string", "source": "string", "abstract": "string",
    "publication_date": "string", "publication_year": "int", "publication_month": "int", "publication_day": "int", "language_iso2": "string",
}
DOCUMENT_DDL = ", ".join(f"{k} {v}" for k, v in DOCUMENT_FIELDS.items())
DOCUMENT = T.StructType([T.StructField(k, T.IntegerType() if v == "int" else T.StringType()) for k, v in DOCUMENT_FIELDS.items()])

CONTACT_DDL = "who struct<id:string,firstName:string,lastName:string,keywords:array<string>>, where array<struct<organization:array<string>,labTeamDepts:array<string>,role:string,office:string,country:string,city:string>>, touch struct<mail:string,phone:string,url:string>"

#: Nodes of the tree, documents of corpora, terms and their occurrences.
NODES_DDL = "id long, typename int, user_id long, parent_id long, name string, date timestamp, hyperdata string"
LINKS_DDL = "corpus string, context_id long, category int, score double"
OCCURRENCES_DDL = "context_id long, list string, term string, ngrams_type int, weight double, doc_count long"
LIST_STATE_DDL = "term string, size int, list string, root string, parent string, children array<string>"
PATCH_DDL = "version long, term string, old_list string, new_list string, add_children array<string>, remove_children array<string>"

#: Kinds of terms, list kinds by rank (greater wins), categories of a document in a corpus. Fixed values.
NGRAMS_TYPES = {"Authors": 1, "Institutes": 2, "Sources": 3, "NgramsTerms": 4}
LIST_TYPES = {"CandidateTerm": 0, "StopTerm": 1, "MapTerm": 2}
CATEGORIES = {"trash": 0, "neutral": 1, "favourite": 2}
NODE_TYPES = {
    "NodeUser": 1, "NodeFolder": 2, "NodeCorpus": 30, "NodeDocument": 4, "NodeAnnuaire": 31, "NodeContact": 41, "NodeGraph": 9, "NodePhylo": 90, "NodeDashboard": 71, "NodeList": 5, "NodeFolderPrivate": 20, "NodeFolderShared": 21, "NodeFolderPublic": 22, "NodeTeam": 210,
}

#: Default year, month and day of a document without a date.
DEFAULT_DATE = (1973, 1, 1)

#: Tags of the fields of bibliographic records, by format. Fixed values.
WOS_FIELDS = {"AF": "authors", "TI": "title", "SO": "source", "DI": "doi", "PD": "publication_date", "SP": "institutes", "AB": "abstract", "PY": "publication_year", "LA": "language"}
RIS_FIELDS = {"AU": "authors", "TI": "title", "T1": "title", "JF": "source", "T2": "source", "DO": "doi", "UR": "url", "AB": "abstract", "N2": "abstract2", "PY": "publication_year", "Y1": "publication_year", "LA": "language", "DA": "date"}
