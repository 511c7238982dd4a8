"""URL filters by a sort-merge range join on canonical keys.

A rule (host, path) becomes the key `com.example.www/path`, its host reversed. Everything that the rule fits on
that very host is the interval of keys that begin with it; for subdomains, a url gets one key for each of its
host's suffixes, down to the number of labels that any rule has. Intervals of prefixes are nested or apart. The
rules' own ends are swept once: the depth of the stack is a running sum of +1 and -1, its top the rule last pushed
at that depth. What comes out are boundaries, each with the rule that holds from there on. The second sweep runs
over urls and boundaries sorted together. A long list of boundaries is cut into ranges of keys, BLOCK in each (about); a
range begins with a boundary, so that nothing has to be known of the ranges before it. A range that many urls fall into
is swept in several sorted runs, among which its urls are dealt evenly whatever their host, and each of which gets the
range's boundaries; runs are as many as shuffle partitions, and one for each range at least. The first sweep takes the
rules of one top-level label in one sort.

Null url, or one without `://`: host and path empty, no rule fits, the default verdict. Repeated rows each give a
row. Equal rules: one is kept, block before allow. Long urls: a key for each suffix of the host, up to the rules'
labels. No rules: the default. An empty table: none. Other columns of the input are left out.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import partitions, written

#: Boundaries of a range of keys, about.
BLOCK = 50_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; path: then up to `?` or `#`."""
    u = F.coalesce(url, F.lit(""))
    rest = F.when(F.instr(u, "://") > 0, F.substr(u, F.instr(u, "://") + F.lit(3))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    return F.translate(host, UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def _key(labels: Column, path: Column) -> Column:
    """Bytes, so that they sort as such; a label's end sorts before any continuation of the label."""
    return F.encode(F.concat(F.array_join(labels, "."), F.lit("\x00"), path), "utf-8")


def boundaries(rules: DataFrame) -> DataFrame:
    """(key, rule): from key on, up to the next one, rule (struct of rule, verdict, size) holds, or none."""
    first = Window.partitionBy("host", "path").orderBy(F.desc("verdict"))
    rules = rules.select(F.translate("host", UPPER, LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict").where("host is not null and verdict in ('allow', 'block')")
    rules = rules.withColumn("n", F.row_number().over(first)).where("n = 1")
    key = _key(F.reverse(F.split("host", r"\.")), F.col("path"))
    rule = F.struct(F.concat("host", "path").alias("rule"), "verdict", F.length(F.concat("host", "path")).alias("size"), F.length("host").alias("host_size"))
    ends = rules.select(F.split(F.reverse(F.col("host")), r"\.")[0].alias("root"), key.alias("low"), rule.alias("rule")).select(
        "root", F.explode(F.array(F.struct(F.col("low").alias("key"), F.lit(1).alias("step"), F.col("rule")), F.struct(F.concat("low", F.lit(b"\xff")).alias("key"), F.lit(-1).alias("step"), F.lit(None).cast("struct<rule:string,verdict:string,size:int,host_size:int>").alias("rule")))).alias("e")
    ).select("root", "e.*")
    run = Window.partitionBy("root").orderBy("key", "step").rowsBetween(Window.unboundedPreceding, 0)
    level = Window.partitionBy("root", "depth").orderBy("key", "step").rowsBetween(Window.unboundedPreceding, 0)
    swept = ends.withColumn("depth", F.sum("step").over(run)).withColumn("top", F.last("rule", ignorenulls=True).over(level))
    return swept.select("key", F.when(F.col("depth") > 0, F.col("top")).alias("rule"))


def _cuts(ruled: DataFrame, block: int) -> list[bytes]:
    """Keys of boundaries that part them into ranges of `block`, about; none for a short list."""
    n = ruled.count()
    if n <= block:
        return []
    dealt = ruled.select("key").repartitionByRange(-(-n // block), "key")
    return sorted(bytes(r.low) for r in dealt.groupBy(F.spark_partition_id()).agg(F.min("key").alias("low")).collect())


def _range_of(key: Column, cuts: list[bytes]) -> Column:
    """How many cuts are not above key, by halving."""

    def place(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(key < F.lit(cuts[mid]), place(low, mid)).otherwise(place(mid + 1, high))

    return place(0, len(cuts))


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", id_col: str = "page_id", url_col: str = "url", block: int = BLOCK) -> DataFrame:
    """page_id, host, path, rule, verdict for every row of pages; rules: host, path, verdict."""
    spark = pages.sparkSession
    n_rules, labels = rules.agg(F.count(F.lit(1)), F.max(F.size(F.split("host", r"\.")))).first()
    ruled = boundaries(rules)
    ruled = written(ruled, "boundaries") if 2 * n_rules > block else ruled
    cuts = _cuts(ruled, block) if 2 * n_rules > block else []
    host, path = host_and_path(F.col(url_col))
    reverse = F.reverse(F.split("host", r"\."))
    urls = pages.select(F.col(id_col).cast("long").alias("page_id"), host.alias("host"), path.alias("path"), F.monotonically_increasing_id().alias("row"))
    keys = urls.withColumn("n", F.explode(F.sequence(F.lit(1), F.least(F.size(reverse), F.lit(labels or 1))))).withColumn("key", _key(F.slice(reverse, 1, F.col("n")), F.col("path")))
    keys, ruled = keys.withColumn("range", _range_of(F.col("key"), cuts)), ruled.withColumn("range", _range_of(F.col("key"), cuts))
    runs = F.lit(partitions(spark))
    if cuts:
        many = {r["range"]: r["n"] for r in keys.groupBy("range").agg(F.count(F.lit(1)).alias("n")).collect()}
        total = max(1, sum(many.values()))
        runs = F.element_at(F.array(*[F.lit(max(1, -(-partitions(spark) * many.get(k, 0) // total))) for k in range(len(cuts) + 1)]), F.col("range") + 1)
    held = ruled.schema["rule"].dataType.simpleString()
    #: Every row says which rule holds from it on; a url says nothing of its own.
    marks = ruled.withColumn("salt", F.explode(F.sequence(F.lit(0), runs - 1))).select(
        "range", F.col("salt").cast("long"), "key", F.lit(0).alias("kind"), F.struct("rule").alias("mark"), F.lit(None).cast("long").alias("row"), F.lit(None).cast("long").alias("page_id"), F.lit(None).cast("string").alias("host"), F.lit(None).cast("string").alias("path")
    )
    both = marks.unionByName(keys.select("range", F.pmod(F.xxhash64("row"), runs).cast("long").alias("salt"), "key", F.lit(1).alias("kind"), F.lit(None).cast(f"struct<rule:{held}>").alias("mark"), "row", "page_id", "host", "path"))
    sweep = Window.partitionBy("range", "salt").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, 0)
    swept = both.withColumn("top", F.last("mark", ignorenulls=True).over(sweep)["rule"]).where("kind = 1")
    best = F.max_by("top", F.struct(F.coalesce(F.col("top.size"), F.lit(-1)), F.coalesce(F.col("top.host_size"), F.lit(-1))))
    # with one range, all keys of a url are in one run
    out = swept.groupBy(*([] if cuts else ["range", "salt"]), "row").agg(F.first("page_id").alias("page_id"), F.first("host").alias("host"), F.first("path").alias("path"), best.alias("top"))
    return out.select("page_id", "host", "path", F.col("top.rule").alias("rule"), F.coalesce("top.verdict", F.lit(default)).alias("verdict"))


#: The rules of the query, fixed values.
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))


def rules_frame(spark: SparkSession, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """Rows made on the JVM side, so that no Python runs on the executors."""
    rows = F.array(*[F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(v).alias("verdict")) for h, p, v in rules])
    return spark.range(1).select(F.explode(rows).alias("r")).select("r.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), rules_frame(spark))


SQL = r"""
WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r(rhost, rpath, verdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
f AS (SELECT page_id, host, path, rhost || rpath AS rule, verdict, row_number() OVER (PARTITION BY p.page_id ORDER BY length(rhost || rpath) DESC NULLS LAST) AS n
      FROM p LEFT JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM f WHERE n = 1
"""
