"""Inputs of the operators, derived from the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LIVE = "v2"
ASKED_TAGS = ("alcohol", "gambling", "vaping", "junk_food")
EVAL_TAGS = ASKED_TAGS + ("dog",)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def numbered(tags: tuple[str, ...]) -> Column:
    """(ord, tag) pairs to explode: each row meets a fixed short list."""
    return F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(t).alias("tag")) for i, t in enumerate(tags)])


# --------------------------------------------------------------- dimensions


def tags(spark: SparkSession) -> DataFrame:
    return spark.sql("""
        SELECT * FROM VALUES
          ('alcohol', 'Alcoholic content', 'Drinks and bars', 'active', 1),
          ('gambling', 'Gambling and betting', '', 'active', 2),
          ('vaping', 'Vaping products', '', 'active', 3),
          ('junk_food', 'Junk food', 'Fast food', 'active', 4),
          ('dog', 'dog', '', 'active', 5),
          ('saloon', 'Saloon and barber', '', 'retired', 6)
        AS t(slug, label, description, status, sort_order)""")


def active_tags(spark: SparkSession) -> DataFrame:
    return tags(spark).filter("status = 'active'").select("slug")


def thresholds(spark: SparkSession) -> DataFrame:
    return spark.sql("""
        SELECT slug, calibrated, packs_version_seen, CAST(p AS DOUBLE) AS precision, CAST(r AS DOUBLE) AS recall
        FROM VALUES ('alcohol', true, 'v2', 0.69, 0.93), ('gambling', true, 'v1', 0.80, 0.90),
                    ('vaping', true, NULL, 0.75, 0.60), ('junk_food', false, 'v2', NULL, NULL)
        AS t(slug, calibrated, packs_version_seen, p, r)""")


def catalog(spark: SparkSession, sf: str) -> DataFrame:
    """A catalog with one tag per part."""
    p = table(spark, sf, "part")
    return p.select(
        F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("_"), F.col("p_partkey")).alias("slug"),
        F.concat("p_name", F.when(F.col("p_type") == "PROMO", F.concat(F.lit(" "), "p_brand")).otherwise("")).alias("label"),
        F.when(F.col("p_size") < 10, "").otherwise(F.col("p_type")).alias("description"),
        F.when(F.col("p_size") > 40, "retired").otherwise("active").alias("status"),
        F.col("p_size").alias("sort_order"))


def part_thresholds(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").filter("p_type <> 'SMALL'")
    return p.select(
        F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("_"), F.col("p_partkey")).alias("slug"),
        (F.col("p_size") % 2 == 0).alias("calibrated"),
        F.when(F.col("p_size") < 15, "v2").when(F.col("p_size") < 30, "v1").alias("packs_version_seen"),
        (F.col("p_size") / 100.0).alias("precision"),
        F.when(F.col("p_size") <= 40, (F.lit(100) - F.col("p_size")) / 100.0).alias("recall"))


def order_catalogs(spark: SparkSession, sf: str) -> DataFrame:
    """Many small catalogs: one per order, one tag per part in it."""
    li = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_partkey").agg(
        F.max("l_returnflag").alias("flag"), F.min("l_linenumber").alias("line"))
    p = table(spark, sf, "part").select("p_partkey", "p_name")
    return li.join(p, li["l_partkey"] == p["p_partkey"]).select(
        F.col("l_orderkey").alias("catalog_id"),
        F.concat(F.lit("tag_"), F.col("l_partkey")).alias("slug"), F.col("p_name").alias("label"),
        F.when(F.col("flag") == "R", "retired").otherwise("active").alias("status"),
        F.col("line").cast("int").alias("sort_order"))


# --------------------------------------------------------------- answers


def raw_answers(spark: SparkSession, sf: str) -> DataFrame:
    return raw_from(table(spark, sf, "conversations"))


def raw_from(conversations: DataFrame) -> DataFrame:
    """One raw answer per turn and tag: creative = conversation, frame = turn."""
    x = conversations.select("conv_id", "turn", F.length("text").alias("n"), "role",
                             F.inline(numbered(ASKED_TAGS)))
    m = (F.col("n") + F.col("ord") * 5 + F.col("turn")) % 10
    score = ((F.col("conv_id") * 31 + F.col("turn") * 17 + F.col("ord") * 11) % 20).cast("double") / 20
    return x.select(
        F.col("conv_id").alias("creative_id"), F.col("turn").alias("frame_index"), "tag",
        F.when(m < 2, True).when(m < 4, None).otherwise(False).alias("present"), score.alias("score"),
        F.concat("role", F.lit(" turn")).alias("top_phrase"), F.lit("vlm").alias("decided_by"),
        (F.col("turn") * 0.5).alias("timestamp_s"))


def frames_sent(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select(
        F.col("conv_id").alias("creative_id"), F.col("turn").alias("frame_index"), "text", "role")


# --------------------------------------------------------------- traffic


def requests_from(events: DataFrame) -> DataFrame:
    csv = (F.when(F.col("event_type") == "click", "alcohol,vaping")
           .when(F.col("event_type") == "view", " vaping ,alcohol,,vaping")
           .when(F.col("event_type") == "purchase", "gambling")
           .when(F.col("event_type") == "signup", "alcohol,alcohool").otherwise("junk_food"))
    creative = F.floor("value").cast("int") % 50
    return events.select(
        F.col("event_id").alias("request_id"), F.col("user_id").alias("api_key_id"),
        F.col("ts").cast("timestamp").alias("created_at"), creative.alias("creative_id"),
        F.sha2(creative.cast("string").cast("binary"), 256).alias("image_hash"), csv.alias("tags_csv"),
        F.when(F.col("ts") < F.lit("2024-01-16").cast("timestamp_ntz"), "v1").otherwise("v2").alias("packs_version"),
        F.floor(F.col("value") * 10).cast("int").alias("latency_ms"),
        (1 + F.col("event_id") % 6).cast("int").alias("frames"),
        F.col("event_type").isin("click", "view").alias("cached"))


def requests(spark: SparkSession, sf: str) -> DataFrame:
    return requests_from(table(spark, sf, "events"))


def keys(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer")
    return c.select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name"),
        F.sha2(F.concat(F.lit("key"), F.col("c_custkey")).cast("binary"), 256).alias("key_hash"),
        F.md5(F.col("c_name").cast("binary")).alias("key_prefix"),
        (1 + F.col("c_custkey") % 3).cast("int").alias("rate_limit_per_min"),
        F.when(F.col("c_acctbal") < 500, F.lit("2024-01-10").cast("timestamp")).alias("revoked_at"),
        F.timestamp_seconds(F.lit(1672531200) + F.col("c_nationkey") * 86400).alias("created_at"))


def limits(spark: SparkSession, sf: str) -> DataFrame:
    return keys(spark, sf).select(F.col("id").alias("api_key_id"),
                                  F.col("rate_limit_per_min").cast("bigint").alias("limit"))


def hits_from(events: DataFrame) -> DataFrame:
    return events.select(F.col("user_id").alias("identity"), F.col("event_id").alias("id"),
                         F.col("ts").cast("timestamp").alias("ts"))


def access(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    xff = (F.when(F.col("event_id") % 11 == 0, None).when(F.col("event_id") % 7 == 0, "")
           .otherwise(F.concat(F.lit("10.9.9."), F.col("event_id") % 9, F.lit(" , 203.0.113."), F.col("user_id") % 7)))
    return e.select("event_id", F.lit("10.0.0.1").alias("peer"), xff.alias("xff"))


# --------------------------------------------------------------- evaluation


def owner_of(doc_id: Column) -> Column:
    names = ("alcohol", "gambling", "vaping", "junk_food", "education")
    return F.get(F.array(*[F.lit(n) for n in names]), (doc_id % 5).cast("int"))


def scored(spark: SparkSession, sf: str) -> DataFrame:
    """Two arms' scores of every labelled document, one row per arm and item."""
    d = table(spark, sf, "documents").select("doc_id", "n_chars", "source")
    lab = table(spark, sf, "labels").select("doc_id", (F.col("quality") == 1).alias("label"))
    owner = owner_of(F.col("doc_id"))

    def arm(name: str, step: int, modulus: int) -> Column:
        def band(ord_: int) -> Column:
            m = (F.col("n_chars") + ord_ * step) % modulus
            return F.when(m < 2, "present").when(m == 2, "uncertain").otherwise("absent")

        bands = F.create_map(*[x for i, t in enumerate(EVAL_TAGS) for x in (F.lit(t), band(i))])
        return F.struct(F.lit(name).alias("arm"), bands.alias("bands"))

    arms = F.inline(F.array(arm("baseline", 3, 7), arm("candidate", 5, 9)))
    return d.join(lab, "doc_id").select(
        F.concat(F.lit("eval/"), "doc_id").alias("path"), owner.alias("owner"), "label",
        F.create_map(owner, F.col("source")).alias("evidence"), F.col("n_chars").alias("latency_ms"), arms)


def eval_paths(spark: SparkSession, sf: str) -> DataFrame:
    lab = table(spark, sf, "labels")
    suffix = F.get(F.array(*[F.lit(s) for s in (".jpg", ".PNG", ".txt", ".webp")]), (F.col("doc_id") % 4).cast("int"))
    return lab.select(F.concat(F.lit("/data/eval/"), owner_of(F.col("doc_id")), F.lit("/"),
                               F.when(F.col("quality") == 1, "pos").otherwise("neg"), F.lit("/"),
                               F.col("doc_id"), suffix).alias("path"))


# --------------------------------------------------------------- media


def media(spark: SparkSession, sf: str) -> DataFrame:
    """Documents and pages as payloads behind real magic bytes."""
    def magic(hex_text: str) -> Column:
        return F.unhex(F.lit(hex_text))

    d = table(spark, sf, "documents")
    head = (F.when(F.col("lang") == "en", magic("FFD8FF")).when(F.col("lang") == "fr", magic("89504E470D0A1A0A"))
            .when(F.col("lang") == "de", magic("474946383961")).otherwise(magic("")))
    docs = d.select(F.concat(F.lit("doc/"), F.col("doc_id")).alias("path"),
                    F.concat(head, F.col("text").cast("binary")).alias("content"))
    pages = table(spark, sf, "pages").select(
        F.concat(F.lit("page/"), F.col("page_id")).alias("path"),
        F.concat(magic("1A45DFA3"), F.col("html").cast("binary")).alias("content"))
    return docs.unionByName(pages)


def frames(spark: SparkSession, sf: str) -> DataFrame:
    """Frame signatures: a creative is a label within a run of 250 vector ids."""
    e = table(spark, sf, "embeddings").select(
        (F.col("vec_id") - F.col("vec_id") % 250 + F.col("label")).alias("creative_id"),
        F.col("vec_id").alias("frame_id"), F.col("embedding").alias("signature"))
    nth = F.row_number().over(Window.partitionBy("creative_id").orderBy("frame_id"))
    return e.withColumn("timestamp_s", (nth - 1) * 0.2)


def fetch_urls(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "pages")
    url = (F.when(F.col("page_id") % 9 == 0, F.concat(F.lit("ftp://x.example/"), F.col("page_id")))
           .when(F.col("page_id") % 11 == 0, F.concat(F.lit("http://10.1.2."), F.col("page_id") % 200, F.lit("/a")))
           .otherwise(F.col("url")))
    second = F.when(F.col("page_id") % 5 == 0, F.concat(F.lit("192.168.0."), F.col("page_id") % 250)).otherwise(
        F.lit("2606:2800:220:1:248:1893:25c8:1946"))
    found = F.array(F.concat(F.lit("93.184.216."), F.col("page_id") % 250), second)
    # Some hosts resolve to nothing, for some nobody asked.
    addresses = F.when(F.col("page_id") % 13 == 0, F.lit(None)).when(F.col("page_id") % 7 == 0, F.array().cast("array<string>")).otherwise(found)
    return p.select("page_id", url.alias("url"), addresses.alias("addresses"))


def change_log(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """(snapshot, changes): every user keeps a little catalog and edits it."""
    e = table(spark, sf, "events")
    op = (F.when(F.col("event_type").isin("signup", "purchase"), "create")
          .when(F.col("event_type") == "view", "update")
          .when(F.col("event_type") == "click", "restore").otherwise("retire"))
    changes = e.select(
        F.col("user_id").alias("catalog_id"), F.col("event_id").alias("seq"),
        F.col("ts").cast("timestamp").alias("at"), op.alias("op"),
        F.concat(F.lit("tag_"), F.floor("value") % 7).alias("slug"),
        F.when(F.col("event_id") % 13 == 0, "  ").otherwise(F.concat(F.lit("Label "), F.col("event_id"))).alias("label"),
        F.col("event_type").alias("description"), F.lit("admin").alias("actor"))
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("catalog_id"), F.inline(F.array(
        F.struct(F.lit("tag_0").alias("slug"), F.lit("active").alias("status"), F.lit(1).alias("sort_order")),
        F.struct(F.lit("tag_1").alias("slug"), F.lit("retired").alias("status"), F.lit(2).alias("sort_order")))))
    return c.select("*", F.lit("Seeded").alias("label"), F.lit("").alias("description")), changes
