"""Readers: landed files to DataFrames with declared schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from corrobora import vocab
from corrobora.functions import text

REVIEW_SCHEMA = ("evidence_id STRING, action STRING, old_pillar STRING, old_topic STRING, new_pillar STRING, "
                 "new_topic STRING, new_topic_name STRING, reason STRING, ew_hook STRING, claim STRING")
_ITEM = "ARRAY<STRUCT<title STRING, link STRING, description STRING, pubDate STRING>>"
_ENTRY = ("ARRAY<STRUCT<title STRING, link ARRAY<STRUCT<_href STRING>>, summary STRING, published STRING, "
          "updated STRING>>")
FEED_SCHEMA = f"channel STRUCT<item {_ITEM}>, item {_ITEM}, entry {_ENTRY}"
STIX_SCHEMA = ("objects ARRAY<STRUCT<type STRING, id STRING, name STRING, description STRING, revoked BOOLEAN, "
               "x_mitre_deprecated BOOLEAN, aliases ARRAY<STRING>, "
               "external_references ARRAY<STRUCT<source_name STRING, external_id STRING>>>>")
_METRIC = "ARRAY<STRUCT<cvssData STRUCT<baseScore DOUBLE>>>"
CVE_SCHEMA = ("keyword STRING, keyword_pos INT, vulnerabilities ARRAY<STRUCT<cve STRUCT<id STRING, published TIMESTAMP, "
              "descriptions ARRAY<STRUCT<lang STRING, value STRING>>, "
              f"metrics STRUCT<cvssMetricV31 {_METRIC}, cvssMetricV30 {_METRIC}, cvssMetricV2 {_METRIC}>>>>")


def spread(df: DataFrame) -> DataFrame:
    """Give every core a share of a small read.

    A text table in one small file arrives as one partition, and splitting text
    is CPU work.  Reads that already have a partition per core pass unchanged,
    so a large table is never shuffled for this.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def feed_entries(feeds: DataFrame) -> DataFrame:
    """Entries of ``feeds(feed, xml)``: RSS items or Atom entries, in feed order."""
    x = F.col("x")
    items = F.coalesce(x["channel"]["item"], x["item"], F.array().cast(_ITEM))
    rss = F.transform(items, lambda i: F.struct(
        i["title"].alias("title"), i["link"].alias("link"), i["description"].alias("summary"), i["pubDate"].alias("date")))
    atom = F.transform(F.coalesce(x["entry"], F.array().cast(_ENTRY)), lambda e: F.struct(
        e["title"].alias("title"), F.try_element_at(e["link"], F.lit(1))["_href"].alias("link"),
        e["summary"].alias("summary"), F.coalesce(e["published"], e["updated"]).alias("date")))
    rows = (feeds.select("feed", F.from_xml("xml", FEED_SCHEMA, {"ignoreNamespace": "true"}).alias("x"))
            .select("feed", F.posexplode(F.concat(rss, atom)).alias("pos", "e")).select("feed", "pos", "e.*"))
    plain = text.squash(text.unescape(F.regexp_replace(F.coalesce("summary", F.lit("")), "(?s)<[^>]+>", " ")))
    day = F.coalesce(
        F.try_to_timestamp(F.regexp_extract("date", r"(\d{1,2} [A-Z][a-z]{2} \d{4})", 1), F.lit("d MMM yyyy")),
        F.try_to_timestamp(F.left("date", F.lit(10)), F.lit("yyyy-MM-dd"))).cast("date")
    return rows.select("feed", "pos", text.strip(F.col("link")).alias("link"), text.strip(F.col("title")).alias("title"),
                       plain.alias("summary"), day.alias("published_on"))


def read_feed(spark: SparkSession, path: str) -> DataFrame:
    """Entries of feed files; a feed is one small file."""
    raw = spark.read.option("wholetext", "true").text(path)
    return feed_entries(raw.select(F.input_file_name().alias("feed"), F.col("value").alias("xml")))


def first_entries(entries: DataFrame, n: int, order: str = "pos", key: str = "feed") -> DataFrame:
    """First ``n`` entries per feed; the rank limit is applied before the shuffle."""
    from pyspark.sql import Window
    rank = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return entries.withColumn("rank", rank).where(F.col("rank") <= n).drop("rank")


def stix_groups(bundles: DataFrame) -> DataFrame:
    """Active intrusion sets of STIX bundles with the regional terms they mention.

    ``bundles`` holds a column ``objects``.  A set without any term is kept with
    an empty list; ``regional`` says which are of interest.
    """
    o = F.col("o")
    refs = F.filter(o["external_references"], lambda r: (r["source_name"] == "mitre-attack") & r["external_id"].isNotNull())
    low = F.lower(F.coalesce(o["description"], F.lit("")))
    terms = F.filter(F.array(*[F.lit(t) for t in vocab.REGIONAL_TERMS]), lambda t: F.contains(low, t))
    return (bundles.select(F.explode("objects").alias("o"))
            .where((o["type"] == "intrusion-set") & ~F.coalesce(o["revoked"], F.lit(False))
                   & ~F.coalesce(o["x_mitre_deprecated"], F.lit(False)))
            .select(F.try_element_at(refs, F.lit(1))["external_id"].alias("attack_id"), o["name"].alias("name"),
                    o["aliases"].alias("aliases"), o["description"].alias("description"),
                    terms.alias("matched_terms"), (F.size(terms) > 0).alias("regional")))


def read_stix(spark: SparkSession, path: str) -> DataFrame:
    return stix_groups(spark.read.schema(STIX_SCHEMA).option("multiLine", "true").json(path))


def cve_records(payloads: DataFrame, as_of: Column, days: int = 120) -> DataFrame:
    """One row per CVE: first keyword that found it, first known score, English text.

    ``payloads(keyword, keyword_pos, vulnerabilities)``; the publication window
    of ``days`` days ends at ``as_of``.
    """
    c = F.col("v.cve")
    score = lambda m: F.try_element_at(c["metrics"][m], F.lit(1))["cvssData"]["baseScore"]
    english = F.try_element_at(F.filter(c["descriptions"], lambda d: d["lang"] == "en"), F.lit(1))["value"]
    rows = (payloads.select("keyword", "keyword_pos", F.explode("vulnerabilities").alias("v"))
            .where(c["id"].isNotNull())
            .select(c["id"].alias("cve_id"), c["published"].alias("published"), "keyword", "keyword_pos",
                    F.coalesce(score("cvssMetricV31"), score("cvssMetricV30"), score("cvssMetricV2")).alias("score"),
                    F.coalesce(english, F.lit("")).alias("description"))
            .where(F.col("published").between(as_of - F.make_dt_interval(F.lit(days)), as_of)))
    first = F.min_by(F.struct("keyword", "score", "description", "published"), "keyword_pos")
    return rows.groupBy("cve_id").agg(first.alias("r")).select("cve_id", "r.*")


def read_cves(spark: SparkSession, path: str, as_of: str, days: int = 120) -> DataFrame:
    payloads = spark.read.schema(CVE_SCHEMA).option("multiLine", "true").json(path)
    return cve_records(payloads, F.lit(as_of).cast("timestamp"), days)


def read_review(spark: SparkSession, path: str) -> DataFrame:
    """The edited review sheet; blanks around the editable cells are dropped."""
    raw = spark.read.schema(REVIEW_SCHEMA).option("header", "true").option("quote", '"').option("escape", '"') \
        .option("multiLine", "true").csv(path)
    return raw.withColumn("action", text.strip("action")).withColumn("new_topic", text.strip("new_topic"))


def seed_lines(lines: DataFrame) -> DataFrame:
    """``lines(value)``: uncommented urls with their tier, publisher, title and topics.

    The note behind ``#`` holds the four fields, separated by middle dots.
    """
    rows = lines.where(F.rlike("value", F.lit(r"^\s*https?://\S+")))
    note = F.regexp_extract("value", r"\s#\s*(.*)$", 1)
    parts = F.transform(F.split(note, "·"), text.strip)
    part = lambda i: F.nullif(F.coalesce(F.try_element_at(parts, F.lit(i)), F.lit("")), F.lit(""))
    return rows.select(F.regexp_extract("value", r"^\s*(\S+)", 1).alias("url"), part(1).alias("tier"),
                       part(2).alias("publisher"), part(3).alias("title"), part(4).alias("topics"))


def read_seed(spark: SparkSession, path: str) -> DataFrame:
    return seed_lines(spark.read.text(path))
