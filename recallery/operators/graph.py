"""The entity-memory graph of all samples at once: memories, entities, mentions and sequence edges."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from recallery.functions import text as X
from recallery.operators.extract import cleaned, rule_extractor


@dataclass
class Graph:
    """The four tables of a graph, each keyed by sample_id."""

    memory: DataFrame
    entity: DataFrame
    mention: DataFrame
    memory_edge: DataFrame


def turns(dialog: DataFrame) -> DataFrame:
    """Dialog turns with an id, the speaker before (of the same session, blanks passed over) and normalised text."""
    named = dialog.where(~X.blank("dia_id")).withColumn("dia_id", X.trimmed("dia_id"))
    said = F.when(~X.blank("speaker"), X.trimmed("speaker"))
    before = W.partitionBy("sample_id", "session_num").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    out = named.withColumns({"previous_speaker": F.last(said, ignorenulls=True).over(before), "_day": X.dialog_date("date_time")})
    return out.withColumn("text_normalized", X.normalized("text", F.col("speaker"), F.col("previous_speaker"), F.col("date_time"), anchor=F.col("_day"))).drop("_day")


def memories(spoken: DataFrame, on_duplicate: str = "first") -> DataFrame:
    """One memory for each dia_id of a sample; of repeats the first (or last) turn stands."""
    order = [F.col("session_num"), F.col("pos")]
    ranked = W.partitionBy("sample_id", "dia_id").orderBy(*(order if on_duplicate == "first" else [c.desc() for c in order]))
    one = spoken.withColumn("_k", F.row_number().over(ranked)).where("_k = 1")
    return one.select("sample_id", X.memory_id("dia_id").alias("memory_id"), "dia_id", "session_num", "date_time", "speaker", "text", "text_normalized", "query", "img_url", "blip_caption", F.create_map().cast("map<string,string>").alias("metadata"))


def extracted(spoken: DataFrame, extractor: Callable[[DataFrame, str], DataFrame] = rule_extractor, add_speaker: bool = True) -> DataFrame:
    """(sample_id, memory_id, order columns, key, value, type) of every entity of every turn. A turn
    without text and image has none; one whose extraction failed (null items) still has its speaker."""
    read = spoken.withColumn("_read", X.extraction_text("text_normalized", "query", "blip_caption")).where("_read <> ''")
    found = cleaned(extractor(read, "_read"))
    listed = F.transform("items", lambda x: F.struct(X.entity_key(x["value"]).alias("key"), x["value"].alias("value"), x["type"].alias("type")))
    found = found.withColumn("items", listed)
    if add_speaker:
        key, who = X.entity_key("speaker"), F.struct(X.entity_key("speaker").alias("key"), X.trimmed("speaker").alias("value"), F.lit("Who").alias("type"))
        fresh = ~X.blank("speaker") & ~F.exists("items", lambda x: x["key"] == key)
        found = found.withColumn("items", F.when(fresh, F.concat("items", F.array(who))).otherwise(F.col("items")))
    session, turn, _ = X.memory_order("dia_id", F.col("session_num"))
    found = found.withColumns({"_s": session, "_t": turn})
    # outer, since of an inner one the optimizer makes a filter that computes the items again, several times; its null rows have no key
    return found.select("sample_id", X.memory_id("dia_id").alias("memory_id"), "dia_id", "_s", "_t", "pos", F.posexplode_outer("items").alias("_i", "_x")).select("sample_id", "memory_id", "dia_id", F.struct("_s", "_t", "dia_id", "pos", "_i").alias("ord"), "_x.key", "_x.value", "_x.type").where("key <> ''")


def entities(found: DataFrame) -> DataFrame:
    """Merged by key: the first type, the longest value (the first of equals), and all values in order of arrival.
    A key's occurrences shrink to one row for each of its values before they are gathered."""
    typed = F.when(F.col("type") != "", F.col("ord"))
    each = found.groupBy("sample_id", "key", "value").agg(F.min("ord").alias("ord"), F.min(typed).alias("at"), F.min_by("type", typed).alias("type"))
    values = F.array_sort(F.collect_list(F.struct("ord", "value")))
    merged = each.groupBy("sample_id", "key").agg(F.min_by("type", "at").alias("type"), F.min_by("value", F.struct(-F.length("value"), F.col("ord"))).alias("value"), values.alias("v"))
    return merged.select("sample_id", X.entity_id("key").alias("entity_id"), "key", "value", "type", F.transform("v", lambda x: x["value"]).alias("merged_from"), F.create_map().cast("map<string,string>").alias("metadata"))


def mentions(found: DataFrame) -> DataFrame:
    pairs = found.select("sample_id", X.entity_id("key").alias("entity_id"), "memory_id", "dia_id").distinct()
    return pairs.select("sample_id", X.mention_id("entity_id", "memory_id").alias("edge_id"), "entity_id", "memory_id", F.lit("mentions").alias("edge_type"), F.lit(1.0).alias("weight"), F.create_map(F.lit("dia_id"), F.col("dia_id")).alias("metadata"))


def sequence_edges(memory: DataFrame) -> DataFrame:
    """next and prev between consecutive memories of a sample, across sessions; 2 (n - 1) edges."""
    order = W.partitionBy("sample_id").orderBy(*X.memory_order("dia_id", F.col("session_num")))
    pair = memory.select("sample_id", "memory_id", "dia_id", F.lead("memory_id").over(order).alias("m2"), F.lead("dia_id").over(order).alias("d2")).where("m2 is not null")
    return paired_edges(pair)


def paired_edges(pair: DataFrame) -> DataFrame:
    """Both edges of each memory (memory_id, dia_id) and the one after it (m2, d2)."""
    both = F.array(F.struct(F.lit("next").alias("kind"), F.col("memory_id").alias("src"), F.col("m2").alias("dst"), F.col("dia_id").alias("sd"), F.col("d2").alias("dd")), F.struct(F.lit("prev").alias("kind"), F.col("m2").alias("src"), F.col("memory_id").alias("dst"), F.col("d2").alias("sd"), F.col("dia_id").alias("dd")))
    one = pair.select("sample_id", F.explode(both).alias("e")).select("sample_id", "e.*")
    return one.select("sample_id", X.sequence_id("kind", "src", "dst").alias("edge_id"), F.col("src").alias("src_memory_id"), F.col("dst").alias("dst_memory_id"), F.col("kind").alias("edge_type"), F.lit(1.0).alias("weight"), F.create_map(F.lit("src_dia_id"), F.col("sd"), F.lit("dst_dia_id"), F.col("dd")).alias("metadata"))


def build(dialog: DataFrame, extractor: Callable[[DataFrame, str], DataFrame] = rule_extractor, add_speaker: bool = True) -> Graph:
    """A graph from dialog turns; takes no questions, so nothing of them can leak into it."""
    spoken = turns(dialog)
    found = extracted(spoken, extractor, add_speaker)
    memory = memories(spoken)
    return Graph(memory, entities(found), mentions(found), sequence_edges(memory))


def build_memories_only(dialog: DataFrame) -> Graph:
    """Memories and their sequence alone; of repeated turns the last stands."""
    spoken = turns(dialog)
    memory = memories(spoken, "last")
    none = extracted(spoken.limit(0))
    return Graph(memory, entities(none), mentions(none), sequence_edges(memory))


def degrees(mention: DataFrame) -> DataFrame:
    return mention.groupBy("sample_id", "entity_id").agg(F.count("*").alias("degree"))


def stats(graph: Graph, left: DataFrame | None = None) -> DataFrame:
    """Counts of each sample's tables, in one pass over each, and with ``left``, memories still to extract, whether the graph is partial."""
    parts = [graph.memory.select("sample_id", F.lit("memories").alias("k")), graph.entity.select("sample_id", F.lit("entities").alias("k")), graph.mention.select("sample_id", F.lit("mentions").alias("k")), graph.memory_edge.select("sample_id", F.lit("memory_edges").alias("k"))]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    kinds = ("memories", "entities", "mentions", "memory_edges")
    out = rows.groupBy("sample_id").agg(*(F.count(F.when(F.col("k") == k, 1)).alias(k) for k in kinds))
    if left is None:
        return out
    return out.join(left.select("sample_id", F.lit(True).alias("partial")).distinct(), "sample_id", "left").withColumn("partial", F.coalesce("partial", F.lit(False)))


def violations(graph: Graph) -> DataFrame:
    """(sample_id, edge_id, problem) of edges whose ends are missing or of the wrong kind, or whose type is not allowed."""
    memory = graph.memory.select("sample_id", F.col("memory_id").alias("m"))
    entity = graph.entity.select("sample_id", F.col("entity_id").alias("e"))

    def missing(edges: DataFrame, column: str, side: DataFrame, name: str, problem: str) -> DataFrame:
        gone = edges.join(side.withColumnRenamed(name, column), ["sample_id", column], "left_anti")
        return gone.select("sample_id", "edge_id", F.lit(problem).alias("problem"))

    kinds = graph.mention.where("edge_type <> 'mentions'").unionByName(graph.mention.limit(0)).select("sample_id", "edge_id", F.lit("type of mention").alias("problem"))
    others = graph.memory_edge.where(~F.col("edge_type").isin("next", "prev")).select("sample_id", "edge_id", F.lit("type of sequence edge").alias("problem"))
    out = [missing(graph.mention, "entity_id", entity, "e", "entity of mention"), missing(graph.mention, "memory_id", memory, "m", "memory of mention"), missing(graph.memory_edge, "src_memory_id", memory, "m", "source of sequence edge"), missing(graph.memory_edge, "dst_memory_id", memory, "m", "target of sequence edge"), kinds, others]
    whole = out[0]
    for o in out[1:]:
        whole = whole.unionByName(o)
    return whole


def pending(turns_: DataFrame, mention: DataFrame) -> DataFrame:
    """Memories to extract after an interruption: those without a mention."""
    return turns_.join(mention.select("sample_id", "memory_id").distinct(), ["sample_id", "memory_id"], "left_anti")
