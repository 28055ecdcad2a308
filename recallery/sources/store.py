"""Sources and sinks: conversation files, graphs, caches that are keyed by content, question keys and reports."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from recallery.functions import text as X
from recallery.operators.graph import Graph
from recallery.schema import ENTITY, ITEM, MEMORY, MEMORY_EDGE, MENTION
from recallery.sources.scratch import settle
from recallery.sources.versions import Versions

TABLES = ("memory", "entity", "mention", "memory_edge")


def _by_line(spark: SparkSession, path: str) -> bool:
    """Whether files hold a sample a line: the first line that isn't blank is a whole JSON value and no array."""
    value = X.trimmed("value")
    # splits in the middle of a file have no first line of it
    head = spark.read.text(path).where("_metadata.file_block_start = 0").where(value != "")
    first = head.select((F.substring(value, 1, 1) != "[").alias("other"), F.try_parse_json(value).isNotNull().alias("whole")).first()
    return first is not None and first["other"] and first["whole"]


def samples(spark: SparkSession, path: str, sample_id: str | None = None, lines: bool | None = None) -> DataFrame:
    """(sample_id, conversation, qa, observation, session_summary) of files with a JSON array of samples, or with one
    sample a line, as ``lines`` says or else the first line; the parts as JSON text. Files of lines are read by as many tasks as
    they have splits, an array file by one. With ``sample_id`` the first such sample; ValueError if there is none."""
    fields = "sample_id string, conversation string, qa string, observation string, session_summary string"
    df = spark.read.schema(fields).json(path, multiLine=not (_by_line(spark, path) if lines is None else lines))
    if sample_id is None:
        return df
    one = df.where(F.col("sample_id") == sample_id).limit(1)
    if one.isEmpty():
        raise ValueError(f"no sample {sample_id} in {path}")
    return one


def dialogs(df: DataFrame, session_num: int | None = None) -> DataFrame:
    """Turns of the sessions ``session_<n>``, with their time; entries that are no lists or no objects are passed over."""
    parts = F.from_json("conversation", "map<string,string>")
    entries = df.select("sample_id", parts.alias("c")).select("sample_id", "c", F.explode(F.map_entries("c")).alias("e"))
    number = F.expr(r"try_cast(regexp_extract(e.key, '(?i)^session_(\\d+)$', 1) as int)")
    listed = entries.withColumn("session_num", number).where(F.col("session_num").isNotNull() & F.col("e.value").startswith("["))
    if session_num is not None:
        listed = listed.where(F.col("session_num") == session_num)
    time = F.try_element_at("c", F.concat(F.col("e.key"), F.lit("_date_time")))
    turns = listed.select("sample_id", "session_num", F.coalesce(time, F.lit("")).alias("date_time"), F.posexplode(F.from_json("e.value", "array<string>")).alias("pos", "raw"))
    one = F.from_json("raw", "struct<dia_id:string,speaker:string,text:string,query:string,img_url:string,blip_caption:string,img_caption:string>")
    read = turns.where(F.ltrim("raw").startswith("{")).withColumn("d", one)
    caption = F.when(~X.blank(F.col("d.blip_caption")), F.col("d.blip_caption")).otherwise(F.col("d.img_caption"))
    url = F.coalesce(F.get(F.from_json("d.img_url", "array<string>"), 0), F.col("d.img_url"))
    some = lambda c: F.coalesce(F.col(f"d.{c}"), F.lit("")).alias(c)
    return read.select("sample_id", "session_num", "date_time", "pos", some("dia_id"), some("speaker"), some("text"), some("query"), F.coalesce(url, F.lit("")).alias("img_url"), F.coalesce(caption, F.lit("")).alias("blip_caption"))


def questions(df: DataFrame) -> DataFrame:
    """(sample_id, qa, question, answer, evidence, category), numbered from 1 by position; blank questions keep their number and are left out."""
    each = df.select("sample_id", F.posexplode(F.from_json("qa", "array<struct<question:string,answer:string,evidence:array<string>,category:int>>")).alias("i", "q"))
    return each.select("sample_id", (F.col("i") + 1).alias("qa"), "q.question", F.coalesce("q.answer", F.lit("")).alias("answer"), F.coalesce("q.evidence", F.array().cast("array<string>")).alias("evidence"), "q.category").where(~X.blank("question"))


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path, maybe with wildcards, names a file or folder of any file system that Spark reads."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = where.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(where)
    return found is not None and len(found) > 0


def question_keys(spark: SparkSession, *paths: str) -> DataFrame:
    """(sample_id, qa, qkey) of files ``<sample>_qkeys*.json``, each an object from question number to keys; empty lists give
    no rows. Of several paths the first that exists counts; no rows if none does."""
    path = next((p for p in paths if exists(spark, p)), None)
    if path is None:
        return spark.createDataFrame([], "sample_id string, qa int, qkey string")
    whole = spark.read.text(path, wholetext=True).select("value", F.regexp_extract(F.col("_metadata.file_name"), r"^(.+?)_qkeys", 1).alias("sample_id"))
    each = whole.select("sample_id", F.explode(F.map_entries(F.from_json("value", "map<string,array<string>>"))).alias("e"))
    return each.select("sample_id", F.expr("try_cast(e.key as int)").alias("qa"), F.explode("e.value").alias("qkey")).where("qa is not null")


#: Folders of a stored graph's table, by a hash of the sample: their number doesn't grow with the samples.
FOLDERS = 64


def _folder_of(sample) -> Column:
    return F.pmod(F.xxhash64(sample), F.lit(FOLDERS)).cast("int")


def _ends(graph: Graph, name: str) -> tuple[DataFrame, list]:
    """A table of a graph with columns that tell what is wrong with a row, and their names; nodes have none."""
    table = getattr(graph, name)
    if name not in ("mention", "memory_edge"):
        return table, []
    sides = (("entity_id", graph.entity, "entity_id"), ("memory_id", graph.memory, "memory_id")) if name == "mention" else (("src_memory_id", graph.memory, "memory_id"), ("dst_memory_id", graph.memory, "memory_id"))
    wrong = []
    for column, nodes, key in sides:
        known = nodes.select("sample_id", F.col(key).alias(column), F.lit(False).alias(f"_no_{column}"))
        table = table.join(known.distinct(), ["sample_id", column], "left").withColumn(f"_no_{column}", F.coalesce(f"_no_{column}", F.lit(True)))
        wrong.append(f"_no_{column}")
    kinds = ("mentions",) if name == "mention" else ("next", "prev")
    return table.withColumn("_kind", ~F.coalesce(F.col("edge_type").isin(*kinds), F.lit(False))), [*wrong, "_kind"]


def save_graph(graph: Graph, path: str) -> int:
    """Store a graph as the next version of ``path``; its number. Edges without their ends, or of other types, are counted while
    they are written; ValueError then, and the version before stays. All four tables become visible together, at the end."""
    spark = graph.memory.sparkSession
    versions = Versions(spark, path)
    place, wrong = versions.folder(), {}
    for name in TABLES:
        rows, flags = _ends(graph, name)
        dealt = rows.withColumn("folder", _folder_of("sample_id")).repartition("folder")
        told = Observation()
        if flags:
            dealt = dealt.observe(told, *(F.sum(F.col(f).cast("long")).alias(f) for f in flags)).drop(*flags)
        dealt.write.partitionBy("folder").parquet(f"{path}/{place}/{name}")
        if flags:
            wrong |= {f"{name}{f}": n for f, n in told.get.items() if n}
    if wrong:
        versions.delete(place)
        raise ValueError(f"the graph has broken edges: {wrong}")
    while not versions.commit(number := versions.latest()[0], {"folder": place}):
        pass  # another version came in between; this one is behind it
    return number + 1


def load_graph(spark: SparkSession, path: str, sample_id: str | None = None, version: int | None = None) -> Graph:
    """The last version of a stored graph, or the one of a number, or one sample of it (from its folder alone); a weight of 0 or null loads as 1.
    FileNotFoundError if nothing is stored."""
    versions = Versions(spark, path)
    number = version or versions.latest()[0]
    if number not in versions.numbers():
        raise FileNotFoundError(f"no graph in {path}")
    place, tables = versions.manifest(number)["folder"], {}
    for name, schema in zip(TABLES, (MEMORY, ENTITY, MENTION, MEMORY_EDGE), strict=True):
        one = spark.read.schema(f"{schema}, folder int").parquet(f"{path}/{place}/{name}")
        if sample_id is not None:
            one = one.where((F.col("folder") == _folder_of(F.lit(sample_id))) & (F.col("sample_id") == sample_id))
        tables[name] = one.drop("folder")
    for name in ("mention", "memory_edge"):
        w = F.coalesce("weight", F.lit(0.0))
        tables[name] = tables[name].withColumn("weight", F.when(w == 0, 1.0).otherwise(w))
    return Graph(**tables)


def clean_graph(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Delete the files of all versions but the last ``keep``, and of writes that never became one; how many folders those were.
    Not while a writer is at work."""
    versions = Versions(spark, path)
    named = {versions.manifest(n)["folder"] for n in versions.numbers()[-keep:]}
    gone = [f for f in versions.folders() if f not in named]
    for folder in gone:
        versions.delete(folder)
    return len(gone)


def to_json(graph: Graph) -> DataFrame:
    """(sample_id, graph): each sample's graph as one JSON object. For the edge of the system; a sample's graph must fit in a row."""
    parts = []
    for name in TABLES:
        table = getattr(graph, name)
        rest = [c for c in table.columns if c != "sample_id"]
        parts.append(table.groupBy("sample_id").agg(F.array_sort(F.collect_list(F.to_json(F.struct(*rest)))).alias(name)))
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, "sample_id", "left")
    body = F.concat_ws(",", *(F.concat(F.lit(f'"{n}":['), F.array_join(F.coalesce(n, F.array().cast("array<string>")), ","), F.lit("]")) for n in TABLES))
    return out.select("sample_id", F.concat(F.lit("{"), body, F.lit("}")).alias("graph"))


def from_json(df: DataFrame) -> Graph:
    """The graph of rows (sample_id, graph) that ``to_json`` gave; other edge types raise when read."""
    tables = {}
    for name, schema in zip(TABLES, (MEMORY, ENTITY, MENTION, MEMORY_EDGE), strict=True):
        body = schema.removeprefix("sample_id string, ")
        read = F.from_json(F.get_json_object("graph", f"$.{name}"), f"array<struct<{', '.join(f.strip().replace(' ', ':', 1) for f in _fields(body))}>>")
        one = df.select("sample_id", F.explode(read).alias("x")).select("sample_id", "x.*")
        if name in ("mention", "memory_edge"):
            legal = ("mentions",) if name == "mention" else ("next", "prev")
            kind = F.when(F.col("edge_type").isin(*legal), F.col("edge_type")).otherwise(F.raise_error(F.lit("edge type not allowed")).cast("string"))
            one = one.withColumns({"edge_type": kind, "weight": F.when(F.coalesce("weight", F.lit(0.0)) == 0, 1.0).otherwise(F.col("weight"))})
        tables[name] = one
    return Graph(**tables)


def _fields(body: str) -> list[str]:
    """The fields of a schema text, commas inside types left alone."""
    out, depth = [""], 0
    for ch in body:
        depth += (ch == "<") - (ch == ">")
        if ch == "," and not depth:
            out.append("")
        else:
            out[-1] += ch
    return out


def entity_cache(spark: SparkSession, path: str) -> Cache:
    """Extracted items by extractor version, model and text digest."""
    return Cache(spark, path, f"version string, model string, text_digest string, items {ITEM}", ["version", "model", "text_digest"])


def embedding_cache(spark: SparkSession, path: str) -> Cache:
    """Vectors by model, role, dimension and text digest, so that dimensions can't mix."""
    return Cache(spark, path, "text_digest string, model string, role string, dim int, vec array<float>", ["text_digest", "model", "role", "dim"])


#: Buckets of a cache, folders of files from which it is compacted, and keys asked up to which a read looks for them alone.
BUCKETS, PARTS, FEW = 64, 16, 500


class Cache:
    """A content-addressed table, in which a key stands once. Its rows lie in buckets by a hash of the key; each addition is a folder
    with a file for each bucket that it has rows for, in the order of the first key and with a Bloom filter on it. What counts is said by
    the last manifest (``sources.versions``), so an interrupted addition adds nothing, and of two writers with one key
    the second finds the first's row before it commits."""

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str], buckets: int = 0):
        self.spark, self.path, self.schema, self.keys = spark, path, schema, keys
        self.columns = StructType.fromDDL(schema).fieldNames()
        self.versions = Versions(spark, path)
        number, manifest = self.versions.latest()
        self.buckets = manifest["buckets"] if number else buckets or BUCKETS
        #: Buckets that the last read looked at, of all that hold rows.
        self.touched: tuple[int, int] = (0, 0)

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _parts(self) -> tuple[int, list[dict]]:
        number, manifest = self.versions.latest()
        return number, manifest["parts"] if number else []

    def _rows(self, parts: list[dict], buckets: set[int] | None = None) -> DataFrame:
        """The rows of parts, in some buckets only."""
        held = {b for p in parts for b in p["buckets"]}
        wanted = held if buckets is None else held & buckets
        self.touched = len(wanted), len(held)
        paths = [f"{self.path}/{p['folder']}/bucket={b}" for p in parts for b in p["buckets"] if b in wanted]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def read(self) -> DataFrame:
        """All rows."""
        return self._rows(self._parts()[1])

    def _asked(self, keys: DataFrame, parts: list[dict]) -> DataFrame:
        """The rows of parts in the buckets of keys, a settled table; of few keys, in files whose filters let them be there."""
        buckets = {r[0] for r in keys.select(self.bucket().alias("b")).distinct().collect()}  # at most as many as there are buckets
        rows = self._rows(parts, buckets)
        few = [r[0] for r in keys.select(self.keys[0]).distinct().limit(FEW + 1).collect()]
        return rows.where(F.col(self.keys[0]).isin(few)) if len(few) <= FEW else rows

    def get(self, df: DataFrame) -> DataFrame:
        """The rows of the keys of ``df``."""
        keys = settle(df.select(*self.keys).distinct())
        return self._asked(keys, self._parts()[1]).join(keys, self.keys, "left_semi")

    def misses(self, df: DataFrame) -> DataFrame:
        """The rows of ``df`` whose keys the cache doesn't have."""
        df = settle(df)
        return df.join(self._asked(df, self._parts()[1]).select(*self.keys), self.keys, "left_anti")

    def add(self, rows: DataFrame) -> int:
        """Add the rows whose keys are new; how many those were. Running it again adds nothing."""
        rows = settle(rows.dropDuplicates(self.keys).select(*self.columns))
        number, parts = self._parts()
        fresh = rows.join(self._asked(rows, parts).select(*self.keys), self.keys, "left_anti")
        while True:
            part = self._written(fresh)
            if not part["rows"]:
                return 0
            if self.versions.commit(number, {"buckets": self.buckets, "parts": [*parts, part]}):
                break
            # another writer was first: what it added is not new any more
            before = {p["folder"] for p in parts}
            number, parts = self._parts()
            fresh = self._rows([part]).join(self._rows([p for p in parts if p["folder"] not in before], set(part["buckets"])).select(*self.keys), self.keys, "left_anti")
        if len(parts) + 1 >= PARTS:
            self.compact()
        return part["rows"]

    def _written(self, rows: DataFrame) -> dict:
        """Write rows into a folder of their own: its name, its buckets and the number of rows."""
        folder, told = self.versions.folder(), Observation()
        dealt = rows.select(*self.columns, self.bucket().alias("bucket")).repartition("bucket").sortWithinPartitions("bucket", self.keys[0])
        masks = [F.bit_or(F.when(F.floor(F.col("bucket") / 32) == k, F.expr("shiftleft(1L, bucket % 32)")).otherwise(F.lit(0))).alias(f"m{k}") for k in range(-(-self.buckets // 32))]
        dealt = dealt.observe(told, F.count("*").alias("n"), *masks)
        bloom = f"parquet.bloom.filter.enabled#{self.keys[0]}"
        dealt.write.option(bloom, "true").partitionBy("bucket").parquet(f"{self.path}/{folder}")
        got = told.get
        if not got["n"]:
            self.versions.delete(folder)
        return {"folder": folder, "buckets": [b for b in range(self.buckets) if (got[f"m{b // 32}"] or 0) >> b % 32 & 1], "rows": got["n"]}

    def compact(self) -> bool:
        """Rewrite all parts as one; False if another writer came in between, which leaves everything as it was. What is replaced stays
        readable for those who read it now, until ``clean``."""
        number, parts = self._parts()
        if len(parts) < 2:
            return False
        return self.versions.commit(number, {"buckets": self.buckets, "parts": [self._written(self._rows(parts))]})

    def clean(self) -> int:
        """Delete the files that the last version doesn't name; how many folders those were. Not while a reader or writer is at work."""
        named = {p["folder"] for p in self._parts()[1]}
        gone = [f for f in self.versions.folders() if f not in named]
        for folder in gone:
            self.versions.delete(folder)
        return len(gone)


#: Format of a stored index of embeddings.
INDEX_FORMAT = 2


def save_index(index: DataFrame, path: str) -> None:
    """(sample_id, memory_id, model, text_digest, vec) with the format's number; ValueError if a row lacks its digest or vector."""
    if not index.where("text_digest is null or vec is null").isEmpty():
        raise ValueError("every memory needs a digest and a vector")
    index.withColumn("format", F.lit(INDEX_FORMAT)).write.mode("overwrite").parquet(path)


def load_index(spark: SparkSession, path: str) -> DataFrame | None:
    """A stored index; None if there is none, or one of another format or without digests."""
    if not exists(spark, f"{path}/*.parquet"):
        return None
    found = spark.read.parquet(path)
    need = {"sample_id", "memory_id", "model", "text_digest", "vec", "format"}
    if not need <= set(found.columns) or not found.where(~F.col("format").eqNullSafe(INDEX_FORMAT)).isEmpty():
        return None
    return found.drop("format")


def report_json(df: DataFrame, most: int = 1000) -> str:
    """A small aggregate as JSON text; for tables bounded by variants x cut-offs x categories."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError("a report holds a small aggregate only")
    return json.dumps([r.asDict(True) for r in rows], indent=1, default=str)


def report_markdown(df: DataFrame, most: int = 1000) -> str:
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError("a report holds a small aggregate only")
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows])
