"""Records of scholarly services from their responses, as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_WORK = "id STRING, title STRING, doi STRING, publication_year INT, abstract_inverted_index MAP<STRING, ARRAY<INT>>, authorships ARRAY<STRUCT<author: STRUCT<display_name: STRING>>>"
_ENTRY = "id STRING, title STRING, summary STRING, published STRING, author ARRAY<STRUCT<name: STRING>>"


def abstract_text(inverted: Column) -> Column:
    """The text of an inverted index (word to positions): words in the order of their positions."""
    pairs = F.flatten(F.transform(F.map_entries(inverted), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.array_join(F.transform(F.array_sort(pairs), lambda x: x["w"]), " ")


def works(raw: DataFrame) -> DataFrame:
    """source_id, title, authors, year, doi, abstract of JSON works (column ``json``);
    works without a title are left out."""
    w = raw.select(F.from_json("json", _WORK).alias("w")).select("w.*").where(F.trim(F.coalesce("title", F.lit(""))) != "")
    return w.select(F.col("id").alias("source_id"), F.trim("title").alias("title"), F.transform("authorships", lambda a: a["author"]["display_name"]).alias("authors"),
                    F.col("publication_year").alias("year"), F.lower(F.regexp_replace("doi", r"^https?://(dx\.)?doi\.org/", "")).alias("doi"),
                    abstract_text(F.col("abstract_inverted_index")).alias("abstract"))


def entries(raw: DataFrame) -> DataFrame:
    """The same of Atom entries (column ``xml``, one entry a row); a document type
    declaration makes a row unreadable, and it is left out."""
    e = raw.where(~F.contains("xml", F.lit("<!DOCTYPE"))).select(F.from_xml("xml", _ENTRY).alias("e")).select("e.*").where(F.col("id").isNotNull())
    tidy = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    return e.select(F.regexp_replace(F.regexp_extract("id", r"([^/]+)$", 1), r"v[0-9]+$", "").alias("source_id"), tidy("title").alias("title"),
                    F.transform("author", lambda a: a["name"]).alias("authors"), F.substring("published", 1, 4).try_cast("int").alias("year"),
                    F.lit(None).cast("string").alias("doi"), tidy("summary").alias("abstract"))


def distinct_papers(papers: DataFrame) -> DataFrame:
    """One row per paper: by DOI, else by title and year; the first source id counts."""
    key = F.coalesce(F.nullif(F.trim("doi"), F.lit("")), F.concat_ws("|", F.lower(F.trim("title")), F.coalesce(F.col("year").cast("string"), F.lit(""))))
    return papers.groupBy(key.alias("paper_key")).agg(F.min(F.struct("source_id", "title", "year", "doi")).alias("p")).select("p.*")
