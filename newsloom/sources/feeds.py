"""RSS 2.0, RSS 1.0 (RDF) and Atom files as records; web pages; tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.html import parse_articles, to_text

_LINKS = "array<struct<_url: string, _type: string>>"
#: Elements that are read of an item and of an entry.
ITEM = f"title string, link string, guid string, `_rdf:about` string, pubDate string, `dc:date` string, description string, `content:encoded` string, content string, summary string, excerpt string, `dc:description` string, `media:description` string, `media:content` {_LINKS}, `media:thumbnail` {_LINKS}, enclosure {_LINKS}"
ENTRY = f"title string, id string, link array<struct<_href: string, _rel: string>>, published string, updated string, `content:encoded` string, content string, description string, summary string, excerpt string, `dc:description` string, `media:description` string, `media:content` {_LINKS}, `media:thumbnail` {_LINKS}, enclosure {_LINKS}"
#: Fields that may hold the description, in the order in which they win ties.
DESCRIPTIONS = ["content:encoded", "content", "description", "summary", "excerpt", "dc:description", "media:description"]
#: Longest description, most records of an outlet, largest page.
DESCRIPTION_CHARS, PER_SOURCE, PAGE_CHARS = 2200, 30, 1_200_000


def _text(c: str) -> Column:
    return F.coalesce(F.trim(F.col(f"`{c}`")), F.lit(""))


def _first_of(*cs: Column) -> Column:
    return F.coalesce(*[F.when(c != "", c) for c in cs])


def atom_link(links: Column) -> Column:
    """The address of the first link that is the article's own, else of the first."""
    own = F.get(F.filter(links, lambda x: x["_rel"].isNull() | (x["_rel"] == "") | (x["_rel"] == "alternate")), F.lit(0))["_href"]
    return F.coalesce(own, F.get(links, F.lit(0))["_href"], F.lit(""))


def image_of() -> Column:
    """The first picture: media content, thumbnail, image enclosure, first img of the description."""
    http = lambda c: F.get(F.filter(F.transform(F.col(f"`{c}`"), lambda x: x["_url"]), lambda u: u.startswith("http")), F.lit(0))
    enclosed = F.get(F.filter("enclosure", lambda x: x["_type"].startswith("image/") & x["_url"].isNotNull()), F.lit(0))["_url"]
    img = F.regexp_extract(_text("description"), r"(?i)<img[^>]+src=[\"']([^\"']+)[\"']", 1)
    return F.coalesce(http("media:content"), http("media:thumbnail"), enclosed, F.when(img != "", img))


def best_description() -> Column:
    """The longest of the description fields once markup is gone, the first of equals, cut to length."""
    cleaned = [to_text(_text(c)) for c in DESCRIPTIONS]
    sized = F.array(*[F.struct(F.length(t).alias("n"), t.alias("t")) for t in cleaned])
    best = F.aggregate(sized, F.struct(F.lit(0).alias("n"), F.lit("").alias("t")), lambda a, x: F.when(x["n"] > a["n"], x).otherwise(a))
    return F.substring(best["t"], 1, DESCRIPTION_CHARS)


def _records(df: DataFrame, url: Column, date: Column, guid: Column) -> DataFrame:
    out = df.select(to_text(_text("title")).alias("title"), url.alias("url"), best_description().alias("description"), date.alias("pub_date"), image_of().alias("image_url"), guid.alias("guid"), F.col("_metadata.file_path").alias("file"))
    out = out.withColumn("guid", _first_of(F.coalesce("guid", F.lit("")), F.coalesce("url", F.lit("")), F.col("title")))
    return out.where((F.length("title") > 2) & (F.length("url") > 5))


def read_feeds(spark: SparkSession, path: str) -> DataFrame:
    """(title, url, description, pub_date, image_url, guid, file) of all feed files under a path, whatever their kind.

    A file that can't be parsed gives no rows. Records without a headline of 3 characters or an
    address of 6 are left out.
    """
    read = lambda tag, schema: spark.read.format("xml").option("rowTag", tag).option("mode", "DROPMALFORMED").schema(schema).load(path)
    items = _records(read("item", ITEM), _first_of(_text("link"), _text("guid"), _text("_rdf:about")), _first_of(_text("pubDate"), _text("dc:date")), _text("guid"))
    entries = _records(read("entry", ENTRY), F.trim(atom_link(F.col("link"))), _first_of(_text("published"), _text("updated")), _text("id"))
    return items.unionByName(entries)


def file_status(spark: SparkSession, path: str, records: DataFrame) -> DataFrame:
    """(file, ok, n, error) of all feed files under a path, those without a record included; ``records`` is what was read of them."""
    there = spark.read.format("binaryFile").load(path)
    plain = lambda c: F.regexp_replace(c, "^([A-Za-z0-9]+):/+", "$1:/")
    files = spark.createDataFrame([(f,) for f in there.inputFiles()], "file string").withColumn("_f", plain("file"))  # the list that Spark holds of them
    some = there.where("length > 0").select(plain("path").alias("_f"), F.lit(True).alias("some"))  # the contents are not read
    got = records.groupBy(plain("file").alias("_f")).agg(F.count("*").alias("n"))
    error = F.when(F.col("some").isNull(), "the file is empty").when(F.col("n").isNull(), "no record could be read")
    return files.join(some, "_f", "left").join(got, "_f", "left").select("file", error.isNull().alias("ok"), F.coalesce("n", F.lit(0)).alias("n"), error.alias("error"))


def first_records(raw: DataFrame, source: str, *order: Column, limit: int = PER_SOURCE) -> DataFrame:
    """The first ``limit`` records of each outlet."""
    return raw.withColumn("_n", F.row_number().over(Window.partitionBy(source).orderBy(*order))).where(F.col("_n") <= limit).drop("_n")


def read_pages(pages: DataFrame) -> DataFrame:
    """(url, text, via, image_url) of landed pages (url, content_type, html): those that say they are HTML, up to the largest size."""
    html = pages.where(F.contains(F.lower("content_type"), F.lit("html"))).select("url", F.substring("html", 1, PAGE_CHARS).alias("html"))
    return parse_articles(html).select("url", "text", "via", "image_url")


def with_pages(stories: DataFrame, pages: DataFrame) -> DataFrame:
    """Stories with what their pages (url, text, image_url) add: a picture if they have none, the text if it is longer and no pitch."""
    from ..functions.text import is_boilerplate

    longest = F.struct(F.coalesce(F.length("text"), F.lit(-1)).alias("n"), "text", "image_url")  # of several pages of an address
    p = pages.groupBy("url").agg(F.max(longest).alias("p")).select(F.col("url").alias("source_url"), F.col("p.text").alias("_t"), F.col("p.image_url").alias("_i"))
    longer = (F.length("_t") > F.length(F.coalesce("summary", F.lit("")))) & ~is_boilerplate(F.col("_t"))
    t = stories.join(p, "source_url", "left")
    return t.withColumn("summary", F.when(longer, F.col("_t")).otherwise(F.col("summary"))).withColumn("image_url", F.coalesce("image_url", "_i")).drop("_t", "_i")


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")

