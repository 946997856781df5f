"""One surviving record for each group of duplicates, by skyline selection (problem 4).

Dimensions of dominance: completeness (how many fields a record can give), trust, and recency; recency is a
total order, in which equal times fall back on the given ties and last on the record's own id. A record
dominates another if it is at least as good in all three. Of the records of a group that can give the same
fields and are trusted alike only the most recent can ever give one, so one combinable maximum per group
and such cell leaves at most 2 ** (fields + 1) records a group, however large the group is; only these are
gathered. Layer 1 holds those of them that none dominates, layer 2 those dominated by layer 1 alone, and
so on. Fields are filled layer by layer: what the records of a layer can't give comes from the next one,
and a field is settled where no record of a deeper layer goes before its giver by the policy: trusted
ones first, then by recency and ties. A deeper layer may hold the giver, where all above it lack the field.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.graph import connected_components
from ..session import table


def skyline_cells(df: DataFrame, group: str, ident: str, usable: dict[str, Column], trusted: Column, recency: Column, ties: list[Column], values: dict[str, Column]) -> DataFrame:
    """The most recent record of each group and cell of completeness and trust."""
    order = F.struct(recency.alias("recency"), *[t.alias(f"tie{i}") for i, t in enumerate(ties)], (-F.col(ident)).alias("low"))
    flags = [F.coalesce(c, F.lit(False)).alias(f"can_{f}") for f, c in usable.items()]
    rows = df.select(F.col(group).alias("grp"), F.col(ident).alias("ident"), *flags, F.coalesce(trusted, F.lit(False)).alias("trust"), order.alias("order"), F.struct(*[c.alias(f) for f, c in values.items()]).alias("value"))
    keys = ["grp", *[f"can_{f}" for f in usable], "trust"]
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.max_by(F.struct("ident", "value"), "order").alias("x"), F.max("order").alias("order"))


def gives(field: str):
    return lambda x: x[f"can_{field}"]


def layered(p: str, fields: list[str]) -> Column:
    """An array of points with their layer of dominance, 1 + the deepest layer of a point that dominates it.

    In the order of recency every point comes after those that dominate it, so one pass is enough.
    """
    full = lambda x: reduce(lambda a, b: a + b, [x[f"can_{f}"].cast("int") for f in fields])
    rising = F.array_sort(p, lambda a, b: F.when(a["order"] > b["order"], -1).when(a["order"] < b["order"], 1).otherwise(0))

    def beats(x: Column):
        return lambda y: (full(y) >= full(x)) & (y["trust"] | ~x["trust"])

    def add(done: Column, x: Column) -> Column:
        above = F.transform(F.filter(done, beats(x)), lambda y: y["layer"])
        return F.array_append(done, x.withField("layer", F.coalesce(F.array_max(above), F.lit(0)) + 1))

    none = F.transform(F.filter(p, lambda x: F.lit(False)), lambda x: x.withField("layer", F.lit(1)))
    return F.aggregate(rising, none, add)


def survivors(df: DataFrame, group: str, ident: str, usable: dict[str, Column], trusted: Column, recency: Column, ties: list[Column] = (), values: dict[str, Column] | None = None) -> DataFrame:
    """(grp, n, and of each field f: f_from = the giver's id or null, f_layer, f = its value).

    usable[f]: whether a record can give field f. values[f]: what it gives; the column of the same
    name by default. ident must be a unique number; a null recency comes last. A null group is one
    group. Null flags count as false. Repeated rows of one ident count in n each. An empty table gives
    an empty result.
    """
    fields = list(usable)
    cells = skyline_cells(df, group, ident, usable, trusted, recency, list(ties), values or {f: F.col(f) for f in fields})
    point = F.struct(*[f"can_{f}" for f in fields], "trust", "order", F.col("x.ident").alias("ident"), F.col("x.value").alias("value"))
    g = cells.groupBy("grp").agg(F.sum("n").alias("n"), F.collect_list(point).alias("p"))
    g = g.withColumn("p", layered("p", fields))
    for f in fields:
        best = F.aggregate(
            F.filter("p", gives(f)),
            F.lit(None).cast(g.schema["p"].dataType.elementType),
            lambda a, x: F.when(a.isNull() | (F.struct(x["trust"], x["order"]) > F.struct(a["trust"], a["order"])), x).otherwise(a),
        )
        g = g.withColumn(f"b_{f}", best)
    return g.select("grp", "n", *[c for f in fields for c in (F.col(f"b_{f}.ident").alias(f"{f}_from"), F.col(f"b_{f}.layer").alias(f"{f}_layer"), F.col(f"b_{f}.value.{f}").alias(f))])


SOUND = "lower(checksum_sha256) RLIKE '^[0-9a-f]{64}$'"


def manifest_groups(m: DataFrame) -> DataFrame:
    """The entries with their component: same id, or same well-formed checksum and a size above 0."""
    m = m.withColumn("own", F.coalesce("id", F.concat(F.lit("\U0010ffff"), F.col("entry_id").cast("string")))).withColumn("sound", F.expr(SOUND))
    linked = m.where("sound AND size_bytes > 0").select(F.lower("checksum_sha256").alias("c"), "own").distinct()
    first = linked.groupBy("c").agg(F.min("own").alias("low"))
    edges = linked.join(first, "c").where("own <> low").select(F.col("own").alias("src"), F.col("low").alias("dst")).distinct()
    comp = connected_components(edges).withColumnsRenamed({"node": "c_node"})
    return m.join(comp, F.col("own") == F.col("c_node"), "left").withColumn("group_id", F.coalesce("component", "own"))


def merged(spark: SparkSession, d: str) -> DataFrame:
    m = manifest_groups(table(spark, d, "manifest").select("entry_id", "id", "checksum_sha256", "size_bytes", "created_at_ms", "updated_at_ms", "received_at", "title", "tags"))
    on_time = F.expr("created_at_ms <= updated_at_ms AND updated_at_ms * 1000 <= unix_micros(received_at)")
    usable = {"checksum": F.col("sound"), "title": F.expr(r"title RLIKE '\\p{L}'"), "tags": F.expr("size(tags) > 0")}
    values = {"checksum": F.lower("checksum_sha256"), "title": F.col("title"), "tags": F.col("tags")}
    s = survivors(m, "group_id", "entry_id", usable, on_time, F.col("updated_at_ms"), [F.lower(F.coalesce("checksum_sha256", F.lit("")))], values)
    return s.where("n >= 2").withColumn("grp", F.when(~F.col("grp").startswith("\U0010ffff"), F.col("grp")))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    z = lambda f: F.coalesce(f"{f}_from", F.lit(0)).cast("long").alias(f"{f}_entry")
    return merged(spark, d).select(F.col("grp").alias("group_id"), z("checksum"), z("title"), z("tags"))


def p4_records(spark: SparkSession, d: str) -> DataFrame:
    """The surviving record of each group, with the number of entries it stands for."""
    return merged(spark, d).select(F.col("grp").alias("group_id"), F.col("n").alias("entries"), "checksum", "title", F.array_join("tags", "|").alias("tags"))


BASE = r"""
m AS (SELECT *, COALESCE(regexp_matches(lower(checksum_sha256), '^[0-9a-f]{64}$'), false) AS sound, lower(COALESCE(checksum_sha256, '')) AS c,
  COALESCE(created_at_ms <= updated_at_ms AND updated_at_ms * 1000 <= epoch_us(received_at), false) AS ok FROM manifest),
links AS (SELECT DISTINCT c, id FROM m WHERE sound AND size_bytes > 0),
pairs AS (SELECT DISTINCT a.id AS a, b.id AS b FROM links a JOIN links b ON a.c = b.c),
reach AS (SELECT DISTINCT id AS a, id AS b FROM m UNION SELECT r.a, p.b FROM reach r JOIN pairs p ON r.b = p.a),
grp AS (SELECT a AS id, min(b) AS group_id FROM reach GROUP BY 1),
g AS (SELECT m.*, group_id, row_number() OVER (PARTITION BY group_id ORDER BY ok DESC, updated_at_ms DESC NULLS LAST, c DESC, entry_id) AS pref FROM m JOIN grp ON m.id = grp.id)
"""

SQL = {
    "p4_found": rf"""WITH RECURSIVE {BASE} SELECT group_id,
  COALESCE(arg_min(entry_id, pref) FILTER (sound), 0) AS checksum_entry,
  COALESCE(arg_min(entry_id, pref) FILTER (regexp_matches(title, '\p{{L}}')), 0) AS title_entry,
  COALESCE(arg_min(entry_id, pref) FILTER (len(tags) > 0), 0) AS tags_entry FROM g GROUP BY 1 HAVING count(*) >= 2""",
    "p4_records": rf"""WITH RECURSIVE {BASE} SELECT group_id, count(*) AS entries,
  arg_min(c, pref) FILTER (sound) AS checksum,
  arg_min(title, pref) FILTER (regexp_matches(title, '\p{{L}}')) AS title,
  array_to_string(arg_min(tags, pref) FILTER (len(tags) > 0), '|') AS tags FROM g GROUP BY 1 HAVING count(*) >= 2""",
}
QUERIES = {"p4_found": p4_found, "p4_records": p4_records}
