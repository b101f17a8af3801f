"""Records from files: tables of any built-in format, article XML, feeds, scraped pages, nested JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenlit.functions.text import json_object, without_tags

RECORD = "pmid string, title string, abstract string, journal string, pub_date string, publication_types array<string>, doi string, pmc_id string, nct_ids array<string>, mesh_terms array<string>, authors array<string>, language string, raw_hash string"
_ARTICLE = """MedlineCitation struct<PMID: struct<_VALUE: string>, Article: struct<ArticleTitle: string, Abstract: struct<AbstractText: array<struct<_Label: string, _VALUE: string>>>,
  Journal: struct<Title: string, ISOAbbreviation: string, JournalIssue: struct<PubDate: struct<Year: string, Month: string, Day: string, MedlineDate: string>>>,
  ArticleDate: array<struct<Year: string, Month: string, Day: string>>, Language: array<string>, PublicationTypeList: struct<PublicationType: array<struct<_VALUE: string>>>,
  AuthorList: struct<Author: array<struct<LastName: string, Initials: string, CollectiveName: string>>>,
  DataBankList: struct<DataBank: array<struct<DataBankName: string, AccessionNumberList: struct<AccessionNumber: array<string>>>>>>,
  MeshHeadingList: struct<MeshHeading: array<struct<DescriptorName: struct<_VALUE: string>>>>>,
  PubmedData struct<ArticleIdList: struct<ArticleId: array<struct<_IdType: string, _VALUE: string>>>>"""
_MONTHS = {name: f"{i:02d}" for i, name in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split(), 1)}


def read(spark: SparkSession, path: str, kind: str = "parquet", schema: str | None = None, **options: str) -> DataFrame:
    """A table of any built-in file format; text formats need a schema, so that nothing is read twice to guess it."""
    if kind in ("csv", "json", "xml") and schema is None:
        raise ValueError(f"{kind} needs a schema")
    reader = spark.read.format(kind).options(**options)
    return (reader.schema(schema) if schema else reader).load(path)


def month_number(month: Column) -> Column:
    """Two digits of a month given as a number or an English name; null otherwise."""
    names = F.create_map(*(F.lit(x) for kv in _MONTHS.items() for x in kv))
    return F.coalesce(F.try_element_at(names, F.substring(F.lower(F.trim(month)), 1, 3)), F.when(month.rlike(r"^\s*\d{1,2}\s*$"), F.lpad(F.trim(month), 2, "0")))


def issue_date(year: Column, month: Column, day: Column, free: Column) -> Column:
    """A date of the precision given: year, year-month or year-month-day, else the free text."""
    number = month_number(month)
    padded = F.when(day.rlike(r"^\s*\d{1,2}\s*$"), F.lpad(F.trim(day), 2, "0"))
    full = F.when(number.isNull(), year).when(padded.isNull(), F.concat_ws("-", year, number)).otherwise(F.concat_ws("-", year, number, padded))
    return F.when(F.coalesce(F.trim(year), F.lit("")) != "", full).otherwise(free)


def articles(spark: SparkSession, path: str) -> DataFrame:
    """Article records of XML files; every file is split by its article elements."""
    rows = spark.read.format("xml").option("rowTag", "PubmedArticle").schema(_ARTICLE).load(path)
    article, ids = "MedlineCitation.Article", "PubmedData.ArticleIdList.ArticleId"
    sections = F.transform(F.col(f"{article}.Abstract.AbstractText"), lambda s: F.when(s["_Label"].isNotNull(), F.concat(s["_Label"], F.lit(": "), s["_VALUE"])).otherwise(s["_VALUE"]))
    by_kind = lambda kind: F.try_element_at(F.transform(F.filter(F.col(ids), lambda i: i["_IdType"] == kind), lambda i: i["_VALUE"]), F.lit(1))
    banks = F.filter(F.col(f"{article}.DataBankList.DataBank"), lambda b: b["DataBankName"] == "ClinicalTrials.gov")
    online = F.try_element_at(F.col(f"{article}.ArticleDate"), F.lit(1))
    printed = f"{article}.Journal.JournalIssue.PubDate"
    complete = F.when(online["Day"].isNotNull() & online["Month"].isNotNull(), issue_date(online["Year"], online["Month"], online["Day"], F.lit(None).cast("string")))
    names = F.transform(F.col(f"{article}.AuthorList.Author"), lambda a: F.coalesce(F.when(a["LastName"].isNotNull(), F.concat_ws(" ", a["LastName"], a["Initials"])), a["CollectiveName"]))
    listed = lambda c: F.coalesce(c, F.array().cast("array<string>"))
    return rows.select(
        F.col("MedlineCitation.PMID._VALUE").alias("pmid"), F.col(f"{article}.ArticleTitle").alias("title"), F.array_join(sections, "\n").alias("abstract"),
        F.coalesce(f"{article}.Journal.Title", f"{article}.Journal.ISOAbbreviation").alias("journal"),
        F.coalesce(complete, issue_date(F.col(f"{printed}.Year"), F.col(f"{printed}.Month"), F.col(f"{printed}.Day"), F.col(f"{printed}.MedlineDate")), F.lit("")).alias("pub_date"),
        listed(F.col(f"{article}.PublicationTypeList.PublicationType._VALUE")).alias("publication_types"), by_kind("doi").alias("doi"), by_kind("pmc").alias("pmc_id"),
        listed(F.flatten(F.transform(banks, lambda b: b["AccessionNumberList"]["AccessionNumber"]))).alias("nct_ids"), listed(F.col("MedlineCitation.MeshHeadingList.MeshHeading.DescriptorName._VALUE")).alias("mesh_terms"),
        listed(F.filter(names, lambda n: n.isNotNull())).alias("authors"), F.try_element_at(F.col(f"{article}.Language"), F.lit(1)).alias("language"), F.sha2(F.to_json(F.struct("*")), 256).alias("raw_hash"),
    )


def feed_items(spark: SparkSession, path: str) -> DataFrame:
    """title, url, summary and pub_date of the items of feed files, the first of each url."""
    rows = spark.read.format("xml").option("rowTag", "item").schema("title string, link string, description string, pubDate string").load(path)
    items = rows.select(F.trim("title").alias("title"), F.trim("link").alias("url"), without_tags(F.col("description")).alias("summary"), F.trim("pubDate").alias("pub_date"))
    return items.where("url is null or url = ''").unionByName(items.where("url <> ''").dropDuplicates(["url"]))


def table_rows(pages: DataFrame, markup: str, *kept: str) -> DataFrame:
    """url, title, description and date of the table rows (three cells or more) in pages of markup, with their place on the page."""
    rows = pages.select(*kept, F.posexplode(F.regexp_extract_all(markup, F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), 1)).alias("place", "row"))
    cells = rows.withColumn("cells", F.regexp_extract_all("row", F.lit(r"(?is)<td[^>]*>(.*?)</td>"), 1)).where("size(cells) >= 3")
    first = F.col("cells")[0]
    return cells.select(*kept, "place", F.regexp_extract(first, r"(?i)href=[\"']([^\"']+)", 1).alias("url"), without_tags(first).alias("title"), without_tags(F.col("cells")[1]).alias("description"), without_tags(F.col("cells")[2]).alias("date"))


def latest_submission(applications: DataFrame, status: str = "AP") -> DataFrame:
    """application, date and kind of the latest submission of the wanted status; applications without one are left out."""
    wanted = F.filter("submissions", lambda s: s["status"] == status)
    latest = F.array_max(F.transform(wanted, lambda s: F.struct(s["date"].alias("date"), s["kind"].alias("kind"))))
    return applications.select("application", latest.alias("l")).where("l is not null").select("application", "l.date", "l.kind")


def extracted(answers: DataFrame, text: str, schema: str, *kept: str) -> DataFrame:
    """Structured fields from free answers: the first JSON object of each, read with a schema; unreadable ones give nulls."""
    return answers.select(*kept, F.from_json(json_object(F.col(text)), schema).alias("fields"))


def merged(lanes: list[DataFrame], key: str) -> DataFrame:
    """Lanes joined in order of precedence; of each key the rows of the first lane that has it, and of these one."""
    numbered = [lane.withColumn("lane_ord", F.lit(i)) for i, lane in enumerate(lanes)]
    rows = numbered[0]
    for lane in numbered[1:]:
        rows = rows.unionByName(lane, allowMissingColumns=True)
    others = [c for c in rows.columns if c not in (key, "lane_ord")]
    named = rows.where(F.coalesce(F.col(key), F.lit("")) != "")
    best = named.groupBy(key).agg(F.min(F.struct("lane_ord", *others)).alias("b")).select(key, "b.*")
    return best.unionByName(rows.where(F.coalesce(F.col(key), F.lit("")) == ""), allowMissingColumns=True)


def with_fallback(primary: DataFrame, fallback: DataFrame) -> DataFrame:
    """The primary lane, or the fallback if the primary is empty; decided inside the plan."""
    count = primary.agg(F.count("*").alias("primary_rows"))
    return primary.unionByName(fallback.crossJoin(F.broadcast(count)).where("primary_rows = 0").drop("primary_rows"))
