"""Package-catalog inputs derived from the relational and text tables, for the registered queries.

The derivations of plain input columns are SQL that Spark and the checking engine both run;
everything after that is the library's operators on one side and separate SQL on the other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cratewise.sources.snapshot import Snapshot, parse_lines

RUN_TS = "2024-01-01T00:00:00+00:00"
# Tasks a core that order lines are dealt to before they become records.
SPREAD = 4

# One row per order line: a package variant built for one system.
VARIANT_FACTS = """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_returnflag,
       p_name, p_brand, p_size, s_name, lower(n_name) AS nation,
       CASE WHEN l_partkey % 89 = 0 THEN ''
            WHEN l_partkey % 97 = 0 THEN 'unknown'
            WHEN l_partkey % 8 = 0 THEN replace(p_name, ' ', '-')
            WHEN l_partkey % 8 = 1 THEN concat(replace(p_name, ' ', '-'), '-v', p_size)
            WHEN l_partkey % 8 = 2 THEN concat(p_size, '-', replace(p_name, ' ', '-'))
            WHEN l_partkey % 8 = 3 THEN concat(replace(p_name, ' ', ''), p_size)
            WHEN l_partkey % 8 = 4 THEN concat(replace(p_name, ' ', '-'), '-', p_size, '.', l_partkey % 10, '-rc1')
            ELSE concat(replace(p_name, ' ', '-'), '-', p_size) END AS full_name,
       CASE WHEN n_nationkey % 5 = 4 THEN concat('n', n_nationkey, '-freebsd')
            ELSE concat('n', n_nationkey, '-linux') END AS system,
       CASE WHEN l_partkey % 50 = 1 THEN ''
            WHEN n_nationkey % 5 = 4 THEN concat('pkgs.', lower(p_type), '.p', l_partkey, '.n', n_nationkey, '-freebsd')
            ELSE concat('pkgs.', lower(p_type), '.p', l_partkey, '.n', n_nationkey, '-linux') END AS attr_path,
       concat('/store/', l_orderkey, '-', l_linenumber, '-', l_partkey, '-', l_suppkey, '.drv') AS drv_path
FROM lineitem JOIN part ON l_partkey = p_partkey
     JOIN supplier ON l_suppkey = s_suppkey
     JOIN nation ON s_nationkey = n_nationkey
"""

# A part depends on the part of the next line of the same order.
EDGES = """
SELECT DISTINCT CAST(a.l_partkey AS {text}) AS src, CAST(b.l_partkey AS {text}) AS dst
FROM lineitem a JOIN lineitem b
  ON a.l_orderkey = b.l_orderkey AND a.l_linenumber + 1 = b.l_linenumber
WHERE a.l_partkey <> b.l_partkey
"""

# A part depends on the part that most often stands on the line after it, the smallest of several.
PARTNERS = """
SELECT src, dst FROM (
  SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY n DESC, dst) AS place FROM (
    SELECT CAST(a.l_partkey AS {text}) AS src, CAST(b.l_partkey AS {text}) AS dst, count(*) AS n
    FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber + 1 = b.l_linenumber
    WHERE a.l_partkey <> b.l_partkey GROUP BY 1, 2) counted) placed
WHERE place = 1
"""

# All lines again, but from the smaller part to the larger, so nearly without cycles: only close parts keep their order.
LAYERED = """
SELECT DISTINCT CAST(CASE WHEN back THEN greatest(x, y) ELSE least(x, y) END AS {text}) AS src,
                CAST(CASE WHEN back THEN least(x, y) ELSE greatest(x, y) END AS {text}) AS dst
FROM (SELECT a.l_partkey AS x, b.l_partkey AS y, a.l_partkey > b.l_partkey AND a.l_partkey - b.l_partkey <= 20 AS back
      FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber + 1 = b.l_linenumber
      WHERE a.l_partkey <> b.l_partkey) pairs
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def run_sql(spark: SparkSession, sf_dir: str, text: str, tables: list[str], hints: dict[str, str] | None = None) -> DataFrame:
    hint = {t: f"/*+ {h} */ " for t, h in (hints or {}).items()}
    return spark.sql(
        "WITH " + ", ".join(f"{t} AS (SELECT {hint.get(t, '')}* FROM parquet.`{sf_dir}/{t}.parquet`)" for t in tables) + text
    )


def variant_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    # each given table is one file with one row group: spread its rows while they are a few numbers, before texts are made of them;
    # a given number, since by their bytes few rows would be put together that are much work
    tasks = SPREAD * spark.sparkContext.defaultParallelism
    return _facts(spark, sf_dir, {"lineitem": f"REPARTITION({tasks}, l_orderkey, l_linenumber)"})


def _facts(spark: SparkSession, sf_dir: str, hints: dict[str, str] | None = None) -> DataFrame:
    return run_sql(spark, sf_dir, VARIANT_FACTS, ["lineitem", "part", "supplier", "nation"], hints)


def part_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_sql(spark, sf_dir, EDGES.format(text="STRING"), ["lineitem"])


def partner_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_sql(spark, sf_dir, PARTNERS.format(text="STRING"), ["lineitem"])


def layered_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_sql(spark, sf_dir, LAYERED.format(text="STRING"), ["lineitem"])


def part_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("node_id"), "p_name", "p_size")


def _member(name: str, json: Column) -> Column:
    """``"name":json``, null when the member is left out."""
    return F.concat(F.lit(f'"{name}":'), json)


def _quoted(text: Column) -> Column:
    return F.concat(F.lit('"'), text, F.lit('"'))


def _object(*members: Column) -> Column:
    return F.concat(F.lit("{"), F.concat_ws(",", *members), F.lit("}"))  # nulls are left out


def _list(*items: Column) -> Column:
    # a function of higher order: it keeps Spark from making one method of the whole record, which at over 8000 bytes the JVM only interprets
    return F.concat(F.lit("["), F.array_join(F.filter(F.array(*items), lambda i: i.isNotNull()), ","), F.lit("]"))


def record_lines(facts: DataFrame, inputs: Column | None = None) -> DataFrame:
    """``value``: each variant as a JSON line in the many shapes that snapshots have."""
    part, supplier, line, brand = (F.col(c) for c in ["l_partkey", "l_suppkey", "l_linenumber", "p_brand"])
    license_json = (
        F.when(part % 5 == 0, _quoted(brand))
        .when(
            part % 5 == 1,
            _object(
                _member("shortName", _quoted(brand)),
                _member("fullName", _quoted(F.concat(brand, F.lit(" License")))),
                _member("free", F.when(line % 2 == 0, "true").otherwise("false")),
            ),
        )
        .when(part % 5 == 2, _list(_quoted(brand), F.lit('{"shortName":"MIT","free":true}'), F.lit("null")))
        .when(part % 5 == 4, F.col("p_size").cast("string"))
    )
    person = (
        F.when(
            supplier % 4 == 0,
            _object(
                _member("name", _quoted(F.col("s_name"))),
                _member("email", _quoted(F.concat(F.lit("s"), supplier, F.lit("@example.org")))),
                _member("github", _quoted(F.concat(F.lit("gh"), supplier))),
                _member("githubId", F.when(line % 2 == 0, supplier.cast("string"))),
            ),
        )
        .when(supplier % 4 == 1, _quoted(F.col("s_name")))
        .when(supplier % 4 == 2, _object(_member("name", _quoted(F.col("s_name"))), _member("email", F.lit('""'))))
        .otherwise(
            _object(
                _member("name", _quoted(F.concat(F.lit("Team "), supplier % 3))),
                _member("github", _quoted(F.concat(F.lit("gh"), supplier % 8))),
            )
        )
    )
    meta = _object(
        _member(
            "description",
            F.when(line == 1, _quoted(F.concat(F.lit("  A "), F.col("p_name"), F.lit(" from "), F.col("s_name"), F.lit(" "))))
            .when(line == 2, F.lit('["not a text"]')),
        ),
        _member("homepage", F.when(line % 2 == 0, _quoted(F.concat(F.lit("https://example.org/"), part)))),
        _member("license", license_json),
        _member(
            "platforms",
            F.when(line == 3, _quoted(F.col("system"))).otherwise(
                _list(_quoted(F.col("system")), F.lit('{"cpu":"any"}'), _quoted(F.col("nation")))
            ),
        ),
        _member("maintainers", _list(F.lit('{"name":""}'), person)),
        _member("category", F.when(part % 6 == 0, F.lit('"Tools.Text"')).when(part % 6 == 1, F.lit('"Misc.Other"'))),
        _member("broken", F.when(F.col("l_returnflag") == "R", "true").when(F.col("l_returnflag") == "A", "false")),
        _member("unfree", F.when(part % 9 == 0, "1").when(part % 9 == 1, "0").when(part % 9 == 2, F.lit('"yes"'))),
        _member("insecure", F.when(part % 40 == 0, F.lit("[1]")).when(part % 40 == 1, F.lit("[]"))),
        _member("available", F.when(line == 7, "null").when(line == 6, "false")),
        _member("mainProgram", F.when(part % 3 == 0, _quoted(F.concat(F.lit("run-"), part)))),
        _member("outputsToInstall", F.when(part % 2 == 0, F.lit('["out","dev"]')).when(part % 7 == 0, F.lit('"out"'))),
    )
    record = _object(
        _member("attrPath", F.when(F.col("attr_path") != "", F.to_json(F.split("attr_path", r"\.")))),
        _member("name", _quoted(F.col("full_name"))),
        _member("drvPath", _quoted(F.col("drv_path"))),
        _member("outputs", F.when(line % 2 == 0, _object(_member("out", _quoted(F.col("drv_path")))))),
        _member("meta", F.when(part % 31 == 0, "null").otherwise(meta)),
        *([] if inputs is None else [_member("inputDrvs", inputs)]),
    )
    return facts.select(record.alias("value"))


def raw_snapshot(spark: SparkSession, sf_dir: str) -> Snapshot:
    return parse_lines(record_lines(variant_facts(spark, sf_dir)))


def raw_snapshot_with_inputs(spark: SparkSession, sf_dir: str) -> Snapshot:
    """Records whose inputs are the lines after them in the same order (an order has few lines)."""
    after = Window.partitionBy("l_orderkey").orderBy("l_linenumber").rangeBetween(1, 1)
    facts = _facts(spark, sf_dir).withColumn("targets", F.collect_set("drv_path").over(after))
    entries = F.transform("targets", lambda t: F.concat(F.lit('"'), t, F.lit('":{"outputs":["out"]}')))
    missing = F.lit('"/store/missing.drv":{}')
    listed = F.concat(F.lit("{"), F.concat_ws(",", missing, F.array_join(entries, ",")), F.lit("}"))
    return parse_lines(record_lines(facts, F.when(F.size("targets") > 0, listed)))


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as a catalog of texts, with flags from ``labels``."""
    labels = table(spark, sf_dir, "labels")
    return (
        table(spark, sf_dir, "documents")
        .join(labels, "doc_id", "left")
        .select(
            F.col("doc_id").cast("string").alias("id"),
            F.col("source").alias("name"),
            F.col("text").alias("description"),
            F.col("lang").alias("category"),
            F.coalesce(F.col("toxic") == 1, F.lit(False)).alias("broken"),
            F.coalesce(F.col("quality") == 0, F.lit(False)).alias("unfree"),
        )
    )


def revised(corpus: DataFrame) -> DataFrame:
    """Documents in a new version: their texts from the second half on, with a word more."""
    half = F.expr("substring(description, CAST(length(description) / 2 AS INT) + 1)")
    return corpus.withColumns({"description": F.concat(F.lit("Revised in part "), half), "broken": ~F.col("broken")})


def corpus_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, short_name)`` links for the license filter."""
    return table(spark, sf_dir, "labels").select(
        F.col("doc_id").cast("string"), F.when(F.col("quality") == 1, "Good-1.0").otherwise("Poor-1.0").alias("short_name")
    )


def search_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One request map per event, with good, missing and invalid parameters."""
    user, event = F.col("user_id"), F.col("event_id")
    texts = ["in the", "license", '"the and" of', "einlich oder", "Thé OF", "", 'cionado "de de"', "c++/c#"]
    q = F.element_at(F.array(*[F.lit(t) for t in texts]), (user % len(texts) + 1).cast("int"))
    entries = F.array(
        F.struct(F.lit("q").alias("k"), F.when(event % 17 != 0, q).alias("v")),
        F.struct(F.lit("limit").alias("k"), (F.when(event % 5 == 0, "invalid").when(event % 5 == 1, "3").when(event % 5 == 2, "0").when(event % 5 == 3, "2")).alias("v")),
        F.struct(F.lit("offset").alias("k"), (F.when(event % 7 == 0, "not_a_number").when(event % 7 == 1, "2").when(event % 7 == 2, "-10")).alias("v")),
        F.struct(F.lit("category").alias("k"), (F.when(user % 6 == 0, "en").when(user % 6 == 1, "devel/libs")).alias("v")),
        F.struct(F.lit("license").alias("k"), (F.when(user % 10 == 3, "GOOD-1.0")).alias("v")),
        F.struct(F.lit("include_broken").alias("k"), (F.when(event % 3 == 0, "YES").when(event % 3 == 1, "no")).alias("v")),
        F.struct(F.lit("include_unfree").alias("k"), (F.when(event % 2 == 0, "1").when(event % 4 == 1, "True")).alias("v")),
    )
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("request_id"),
        F.map_from_entries(F.filter(entries, lambda e: e["v"].isNotNull())).alias("params"),
    )


# Searches with term options: required, any of, none of, prefix.
OPTION_TEXTS = [
    ("the", "einlich license", "cionado", "wh"),
    ("", "in oder", "the", ""),
    ('"the and"', "", "of", ""),
    ("of", "that nowhere", "", "un"),
    ("", "", "the", ""),
    ("in", "", "", "nosuchterm"),
    ("", "", "", "ab"),
]


def option_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One request with term options per event."""
    event, user = F.col("event_id"), F.col("user_id")
    chosen = (user % len(OPTION_TEXTS) + 1).cast("int")
    texts = [F.element_at(F.array(*[F.lit(t[i]) for t in OPTION_TEXTS]), chosen) for i in range(4)]
    names = ["q", "any_of", "none_of", "prefix"]
    return table(spark, sf_dir, "events").select(
        event.alias("request_id"),
        *[t.alias(n) for t, n in zip(texts, names, strict=True)],
        (event % 4 + 1).cast("int").alias("limit"),
        F.when(event % 3 == 0, 2).otherwise(0).alias("offset"),
        F.lit(None).cast("string").alias("license"),
        F.when(event % 5 == 0, "en").alias("category"),
        (event % 2 == 0).alias("include_broken"),
        F.lit(True).alias("include_unfree"),
    )
