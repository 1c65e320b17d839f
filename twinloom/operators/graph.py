"""Neighbours, reachability, paths, cards and inventories of the graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinloom import functions as fn
from twinloom.model import Twin
from twinloom.shared import written


def key_of(twin: Twin, name: str) -> DataFrame:
    """key of the first entity of that name; no row if there is none."""
    return twin.entities.where(F.col("name") == name).agg(F.min("key").alias("key")).where("key is not null")


def edges(twin: Twin, topology: str | None = None, at: int | None = None) -> DataFrame:
    """Live relations, of one topology, or valid at an instant."""
    out = twin.live()
    if topology is not None:
        out = out.where(F.col("topology") == topology)
    return out if at is None else out.where(fn.valid_at(F.col("valid_from"), F.col("valid_to"), at))


def neighbours(twin: Twin, keys: DataFrame, topology: str | None = None, out: bool = True, at: int | None = None) -> DataFrame:
    """key, other, topology, rel_type, idx for each relation that leaves (or enters) the given keys."""
    here, there = ("src", "dst") if out else ("dst", "src")
    return edges(twin, topology, at).join(keys.select(F.col("key")), F.col(here) == F.col("key")).select("key", F.col(there).alias("other"), "topology", "rel_type", "idx")


def reach(twin: Twin, start: DataFrame, hops: int, topology: str | None = None, out: bool = True, at: int | None = None) -> DataFrame:
    """key, hops of everything within so many relations of the start keys, which are left out.

    One frontier join and one anti-join with what has been seen a level; each
    level is written, so plans stay small and nothing comes to the driver.
    """
    here, there = ("src", "dst") if out else ("dst", "src")
    links = edges(twin, topology, at).select(F.col(here).alias("_from"), F.col(there).alias("key"))
    links = written(links, "links") if hops > 1 else links  # else every level would read all relations' sources again
    seen = frontier = written(start.select("key").distinct().withColumn("hops", F.lit(0)), "reach")
    for level in range(1, hops + 1):
        frontier = written(frontier.select(F.col("key").alias("_from")).join(links, "_from").select("key").distinct().join(seen, "key", "left_anti").withColumn("hops", F.lit(level)), "reach")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen.where("hops > 0")


def trace(twin: Twin, source: DataFrame, target: DataFrame, hops: int = 6) -> DataFrame:
    """path: the relations (idx) of the shortest path from one key to another, at most one row; [] if they are one.

    Breadth first over live relations of all topologies, whatever their
    validity. Of several shortest paths, that comes first whose relations are
    earliest, compared from the start: the order of a queue that takes
    relations by idx. Level by level, each new entity keeps the least path.
    """
    goals = [r["key"] for r in target.select("key").limit(1).collect()]
    found = twin.spark.createDataFrame([], "path array<bigint>")
    if not goals:
        return found
    links = written(twin.live().select(F.col("src").alias("_from"), F.col("dst").alias("key"), "idx"), "links")
    seen = frontier = written(source.select("key", F.expr("cast(array() as array<bigint>)").alias("path")), "trace")
    for level in range(hops + 1):
        size, path = frontier.agg(F.count(F.lit(1)), F.min(F.when(F.col("key") == goals[0], F.col("path")))).first()
        if path is not None:
            return twin.spark.createDataFrame([(path,)], found.schema)
        if not size or level == hops:
            break
        step = frontier.select(F.col("key").alias("_from"), "path").join(links, "_from").select("key", F.concat("path", F.array("idx")).alias("path"))
        frontier = written(step.groupBy("key").agg(F.min("path").alias("path")).join(seen.select("key"), "key", "left_anti"), "trace")
        seen = seen.unionByName(frontier)
    return found


def steps(twin: Twin, path: DataFrame) -> DataFrame:
    """The hops of a traced path: pos, from, relation_type, topology, to, provenance, relation_idx and the entities' keys."""
    hops = path.select(F.posexplode("path").alias("pos", "idx")).join(twin.relations, "idx")
    return named(twin, hops).select("pos", F.col("src_name").alias("from"), F.col("rel_type").alias("relation_type"), "topology", F.col("dst_name").alias("to"), fn.provenance_name(F.col("provenance")).alias("provenance"), F.col("idx").alias("relation_idx"), "src", "dst").orderBy("pos")


def named(twin: Twin, relations: DataFrame) -> DataFrame:
    """relations with src_name and dst_name; of an unknown key '<key:N>'."""
    names = twin.entities.select("key", "name")
    for end in ("src", "dst"):
        own = names.select(F.col("key").alias(f"_{end}"), F.col("name").alias(f"{end}_name"))
        relations = relations.join(own, F.col(end) == F.col(f"_{end}"), "left").withColumn(f"{end}_name", F.coalesce(f"{end}_name", F.concat(F.lit("<key:"), F.col(end).cast("string"), F.lit(">")))).drop(f"_{end}")
    return relations


def graph_edges(twin: Twin) -> DataFrame:
    """Live relations by name: idx, from, to, relation_type, valid_from, valid_to, provenance."""
    return named(twin, twin.live()).select("idx", F.col("src_name").alias("from"), F.col("dst_name").alias("to"), fn.joined_type(F.col("topology"), F.col("rel_type")).alias("relation_type"), "valid_from", "valid_to", fn.provenance_name(F.col("provenance")).alias("provenance"))


def cards(twin: Twin, keys: DataFrame) -> DataFrame:
    """Both ends' view of the live relations of the given keys: key, direction, idx, type, topology, other, provenance, valid_from, valid_to."""
    sides = None
    for direction, here, there in (("out", "src", "dst"), ("in", "dst", "src")):
        own = twin.live().join(keys.select("key"), F.col(here) == F.col("key"))
        own = own.select("key", F.lit(direction).alias("direction"), "idx", F.col("rel_type").alias("type"), "topology", F.col(there).alias("_other"), fn.provenance_name(F.col("provenance")).alias("provenance"), "valid_from", "valid_to")
        sides = own if sides is None else sides.unionByName(own)
    names = twin.entities.select(F.col("key").alias("_key"), F.col("name").alias("other"), F.col("type").alias("other_type"))
    return sides.join(names, F.col("_other") == F.col("_key"), "left").withColumn("other", F.coalesce("other", F.concat(F.lit("<key:"), F.col("_other").cast("string"), F.lit(">")))).withColumnRenamed("_other", "other_key").drop("_key")


def topology_summary(twin: Twin, keys: DataFrame) -> DataFrame:
    """key, topology, edge_count, relation_types (sorted) and first (position of the first relation, incoming before outgoing)."""
    rows = cards(twin, keys).withColumn("_at", F.struct((F.col("direction") == "out").alias("o"), F.col("idx").alias("i")))
    return rows.groupBy("key", "topology").agg(F.count(F.lit(1)).alias("edge_count"), F.array_sort(F.collect_set("type")).alias("relation_types"), F.min("_at").alias("first"))


def list_entities(twin: Twin, kind: str | None = None) -> DataFrame:
    rows = twin.entities.select("key", "name", "type")
    return rows if kind is None else rows.where(F.col("type") == kind)


def entity_types(twin: Twin) -> DataFrame:
    return twin.entities.select("type").distinct()


def topologies(twin: Twin) -> DataFrame:
    """All topologies, those of removed relations too."""
    return twin.relations.select("topology").distinct()


def provenance_relations(twin: Twin) -> DataFrame:
    """Live relations with provenance byte and class: relation_idx, src, dst, type, topology, provenance_byte, provenance, valid_from, valid_to."""
    return named(twin, twin.live()).select(F.col("idx").alias("relation_idx"), F.col("src_name").alias("src"), F.col("dst_name").alias("dst"), F.col("rel_type").alias("type"), "topology", F.col("provenance").alias("provenance_byte"), fn.provenance_name(F.col("provenance")).alias("provenance"), "valid_from", "valid_to")


def address_space(twin: Twin, discrete: DataFrame | None = None) -> DataFrame:
    """Nodes and references of the information model: kind, id, parent, name, detail.

    A folder for each type (ids from 100 on, types in order), an object for
    each entity (1000 + key), a reference for each live relation, a variable
    for each series (2000 + place among the sorted names) and a property for
    its unit (3000 + the same place). detail: a relation's type, a variable's
    data type, or a unit.
    """
    from pyspark.sql.window import Window

    from twinloom.operators.checks import units
    from twinloom.operators.windows import places

    folders = entity_types(twin).select("type", (99 + F.row_number().over(Window.orderBy("type"))).cast("bigint").alias("id"))  # types are few
    objects = twin.entities.join(folders.withColumnRenamed("id", "parent"), "type").select(F.lit("object").alias("kind"), (1000 + F.col("key")).alias("id"), "parent", "name", F.col("type").alias("detail"))
    refs = twin.live().select(F.lit("reference").alias("kind"), (1000 + F.col("dst")).alias("id"), (1000 + F.col("src")).alias("parent"), F.lit("HasComponent").alias("name"), fn.joined_type(F.col("topology"), F.col("rel_type")).alias("detail"))
    names = twin.series.select("name").distinct()
    owners = twin.entities.groupBy("name").agg(F.min("key").alias("key")).withColumnRenamed("name", "entity")
    variables = places(names, "name", "n").withColumn("entity", F.substring_index("name", ".", 1)).join(owners, "entity", "left")
    if discrete is not None:
        variables = variables.join(discrete.select(F.col("series").alias("name"), "discrete"), "name", "left")
    else:
        variables = variables.withColumn("discrete", F.lit(False))
    kinds = F.when(F.coalesce("discrete", F.lit(False)), "Boolean").otherwise("Double")
    nodes = variables.select(F.lit("variable").alias("kind"), (2000 + F.col("n")).cast("bigint").alias("id"), (1000 + F.col("key")).alias("parent"), "name", kinds.alias("detail"))
    props = variables.join(units(twin).withColumnRenamed("series", "name"), "name").select(F.lit("unit").alias("kind"), (3000 + F.col("n")).cast("bigint").alias("id"), (2000 + F.col("n")).cast("bigint").alias("parent"), "name", F.col("unit").alias("detail"))
    tops = folders.select(F.lit("folder").alias("kind"), "id", F.lit(1).cast("bigint").alias("parent"), F.col("type").alias("name"), F.lit("").alias("detail"))
    return tops.unionByName(objects).unionByName(refs).unionByName(nodes).unionByName(props)
