"""URL rules by a sort-merge range join (operator 5).  DataFrame functions only.

Method: a rule's canonical key is its host in reversed labels and its path
(``www.example.com/en/`` -> ``com.example.www./en/``), so the urls of one host
that it fits are one interval of keys, and intervals nest or are apart.  A url
asks once for its host and once for each host around it that rules may have,
each time with its own path.  Rules and questions are sorted together by key
over ranges; a sweep carries along the last rule with the lengths of the nested
rules that are active there (its stack), and a question pops those that don't
hold it any more: the longest prefix that it shares with the last rule tells
which are left.  The last rule of each range is handed on to the next ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from glyphsift.sources.tables import table

from .common import parallelism, stored

RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
#: What a page gets that no rule fits.
DEFAULT = "allow"


def host_of(url: Column) -> Column:
    found = F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://[^/?#]*([^?#]*)", 1)


def key_of(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, "\\.")), "."), F.lit("."))


def rules_frame(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """``verdict, host, path`` of each rule."""
    return spark.createDataFrame(rules, "verdict string, host string, path string")


def stacks(rules: DataFrame) -> DataFrame:
    """``__key, __best, __stack``: each rule's key with what it says, and the lengths of the rules that hold it, itself included.

    Two rules for the same key are one: that with the greater verdict.  The
    lengths that occur are few, so each rule is joined to its own prefixes.
    """
    fit = rules.where(F.startswith("path", F.lit("/")) | (F.col("path") == ""))  # no url has another path
    size = F.length(F.concat("host", "path"))
    own = fit.select(F.concat(key_of(F.col("host")), "path").alias("__key"), F.struct(size.alias("size"), F.length("host").alias("host_size"), F.concat("host", "path").alias("rule"), F.col("verdict").alias("verdict")).alias("__best"))
    own = own.groupBy("__key").agg(F.max("__best").alias("__best"))
    lengths = own.select(F.length("__key").alias("__l")).distinct().agg(F.array_sort(F.collect_list("__l")).alias("__ls"))  # one row, as long as the longest key at most
    inner = own.crossJoin(lengths).select("__key", F.explode(F.filter("__ls", lambda n: n < F.length("__key"))).alias("__l")).withColumn("__outer", F.col("__key").substr(F.lit(1), F.col("__l")))
    around = inner.join(own.select(F.col("__key").alias("__outer")), "__outer").groupBy("__key").agg(F.collect_list("__l").alias("__around"))
    return own.join(around, "__key", "left").select("__key", "__best", F.array_append(F.coalesce("__around", F.array().cast("array<int>")), F.length("__key")).alias("__stack"))


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = DEFAULT) -> DataFrame:
    """``page_id, host, path, rule, verdict``, one row per input row.

    The host is what stands between the first ``://`` and the next ``/``, ``?``,
    ``#`` or the end, A-Z lower-cased; the path goes on to ``?`` or ``#``; a null
    url, or one without ``://``, has neither and gets the default verdict with a
    null rule.  The rule with the most characters of host and path wins, then
    the longer host.  Repeated rows give repeated rows, an empty table none.
    """
    spark = pages.sparkSession
    held = stored(stacks(rules), "url-rules")
    most = held.agg(F.max(F.size(F.split(F.split_part("__key", F.lit("/"), F.lit(1)), "\\.")) - 1)).first()[0] or 0
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    labels = F.reverse(F.split("host", "\\."))
    # the host itself and those around it, as far as rules have so many labels
    hosts = F.transform(F.sequence(F.lit(1), F.greatest(F.least(F.size("__labels"), F.lit(most)), F.lit(1))), lambda n: F.concat(F.array_join(F.slice("__labels", 1, n), "."), F.lit(".")))
    asked = rows.withColumn("__labels", labels).select("page_id", "host", "path", F.posexplode(hosts).alias("__n", "__host"))
    asked = asked.select(F.concat("__host", "path").alias("__key"), F.lit(1).alias("__kind"), "page_id", "host", "path", "__n", F.lit(None).cast(held.schema["__best"].dataType).alias("__best"), F.lit(None).cast("array<int>").alias("__stack"))
    none = lambda c: F.lit(None).cast(asked.schema[c].dataType).alias(c)
    given = held.select("__key", F.lit(0).alias("__kind"), *map(none, ("page_id", "host", "path", "__n")), "__best", "__stack")
    # page_id as a further key lets a hot url spread over many ranges
    order = ["__key", "__kind", "page_id", "host"]
    swept = stored(asked.unionByName(given).repartitionByRange(parallelism(spark), *order).withColumn("__part", F.spark_partition_id()), "url-sweep")
    rule = F.when(F.col("__kind") == 0, F.struct("__key", "__stack"))
    last = F.last(rule, ignorenulls=True).over(Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    # one row for each range
    ends = swept.groupBy("__part").agg(F.max(rule).alias("__end"))
    carried = ends.select("__part", F.last("__end", ignorenulls=True).over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)).alias("__carried"))
    open_ = F.coalesce("__last", "__carried")
    active = F.array_max(F.filter(open_["__stack"], lambda n: F.col("__key").substr(F.lit(1), n) == open_["__key"].substr(F.lit(1), n)))
    asked = swept.withColumn("__last", last).where("__kind = 1").join(carried, "__part")
    asked = asked.select("page_id", "host", "path", "__n", F.col("__key").substr(F.lit(1), active).alias("__rule"))
    said = asked.join(held.select(F.col("__key").alias("__rule"), "__best"), "__rule", "left")
    # rows that repeat are counted and given back as often
    each = said.groupBy("page_id", "host", "path").agg(F.max("__best").alias("__best"), F.sum((F.col("__n") == 0).cast("int")).alias("__times"))
    each = each.withColumn("__one", F.explode(F.array_repeat(F.lit(0), F.col("__times").cast("int"))))
    return each.select("page_id", "host", "path", F.col("__best.rule").alias("rule"), F.coalesce("__best.verdict", F.lit(default)).alias("verdict"))


def query(spark, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), rules_frame(spark, RULES))


SQL = r"""
WITH u AS (
  SELECT page_id, url, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), p AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, row_number() OVER () AS rid FROM u
), rules(verdict, h, q) AS (
  VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')
), m AS (
  SELECT rid, arg_max(h || q, length(h || q)) AS rule, arg_max(verdict, length(h || q)) AS verdict
  FROM p JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q) GROUP BY rid
)
SELECT page_id, host, path, m.rule, coalesce(m.verdict, 'allow') AS verdict FROM p LEFT JOIN m USING (rid)
"""
