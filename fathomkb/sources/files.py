"""Readers and writers of bundle files: repositories, JSON state, Markdown documents, graphs and RDF."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathomkb.functions.scalars import slugify
from fathomkb.sources.sinks import INDEX, read_packed

LANGUAGES = {"py": "python", "cbl": "cobol", "cob": "cobol", "cpy": "cobol"}
TYPES = {"md": "markdown", "txt": "text", "pdf": "pdf", "docx": "docx"}


def _by_suffix(path: Column, table: dict[str, str]) -> Column:
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)))


def source_type(path: Column) -> Column:
    return _by_suffix(path, TYPES)


def scan_repository(spark: SparkSession, root: str, skip: tuple[str, ...] = (".git", "node_modules", "__pycache__", ".venv")) -> DataFrame:
    """path, language, checksum, size_bytes, text of files under root, but for those below a skipped directory; an unknown suffix has a null language."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    parts = F.split("path", "/")
    keep = files.filter(~F.arrays_overlap(parts, F.array(*map(F.lit, skip))))
    return keep.select("path", _by_suffix(F.col("path"), LANGUAGES).alias("language"), F.sha2("content", 256).alias("checksum"), F.col("length").alias("size_bytes"), F.decode("content", "UTF-8").alias("text"))


def read_state(spark: SparkSession, path: str, schema: T.StructType | str, strict: bool = True) -> DataFrame:
    """JSON state of an explicit schema, never inferred; strict: broken files are errors, else they are rows of nulls."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST" if strict else "PERMISSIVE").json(path)


def read_states(spark: SparkSession, path: str, schema: str, missing: str = "default", corrupt: str = "default") -> DataFrame:
    """JSON files below path, each a document: file (its path), state (a struct of schema), corrupt (whether it couldn't be read).

    missing: what an absent path, or one without files, is: "default" (no rows) or "error". corrupt: what a file is that is no JSON, or no
    object: "default" (a row with a null state), "drop" (no row), or "error" as soon as it is read. Fields that schema doesn't name are
    not read, those that a file lacks are null, a field of another type makes that field null. Spark lists no file of zero bytes, so such a
    file is as one that is missing. Where sinks.write_packed has left the states, their files are path and name.
    """
    hadoop = spark._jvm.org.apache.hadoop.fs
    where = hadoop.Path(path)
    store = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(where):
        if missing == "error":
            raise FileNotFoundError(path)
        return spark.createDataFrame([], f"file string, state struct<{_struct(schema)}>, corrupt boolean")
    if store.exists(hadoop.Path(where, INDEX)):
        files = read_packed(spark, path).select(F.concat(F.lit(f"{path}/"), "document").alias("file"), F.col("text").alias("value"))
    else:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(F.col("path").alias("file"), F.decode(F.coalesce("content", F.lit(b"")), "UTF-8").alias("value"))
    if missing == "error" and files.isEmpty():
        raise FileNotFoundError(path)
    whole = files.withColumn("state", F.from_json("value", f"{schema}, corrupt_ string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "corrupt_"}))
    is_object = F.col("value").rlike(r"^\s*\{")
    # a field of another type leaves the record partly read and marked: only a text that is no object, or can't be read at all, is corrupt
    readable = is_object & F.expr("try_parse_json(value)").isNotNull()
    fields = T.StructType.fromDDL(schema).names
    state = F.when(readable, F.struct(*(F.col(f"state.{c}").alias(c) for c in fields)))
    out = whole.select("file", state.alias("state"), (~readable).alias("corrupt"))
    if corrupt == "drop":
        return out.filter(~F.col("corrupt"))
    if corrupt == "error":
        return out.withColumn("corrupt", F.when(F.col("corrupt"), F.raise_error(F.concat(F.lit("not a JSON object: "), "file")).cast("boolean")).otherwise(False))
    return out


def _struct(schema: str) -> str:
    return ", ".join(f"{f.name}: {f.dataType.simpleString()}" for f in T.StructType.fromDDL(schema))


def normalize_markdown(text: Column, plain: bool = False) -> Column:
    """Line ends as LF, trimmed, one line end at the end; plain text gets a heading."""
    body = F.concat(F.regexp_replace(F.regexp_replace(text, "\r\n?", "\n"), r"^[\s\x{FEFF}]+|\s+$", ""), F.lit("\n"))
    return F.concat(F.lit("# Document\n\n"), body) if plain else body


def graph(sources: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (first position, last value of an id) and edges (the first of each source, target, type)."""
    nodes = sources.select("seq", "id", F.lit("source").alias("type"), F.col("path").alias("label")).unionByName(items.select("seq", "id", F.lit("item").alias("type"), F.col("subject").alias("label"))).unionByName(items.select("seq", F.concat(F.lit("concept-"), slugify(F.col("subject"))).alias("id"), F.lit("concept").alias("type"), F.col("subject").alias("label")))
    nodes = nodes.groupBy("id").agg(F.min("seq").alias("position"), F.max_by(F.struct("type", "label"), F.struct("seq", "type")).alias("x")).select("id", "position", "x.type", "x.label")
    edges = items.select("seq", F.col("source_id").alias("source"), F.col("id").alias("target"), F.lit("contains").alias("type")).unionByName(items.select("seq", F.col("id").alias("source"), F.concat(F.lit("concept-"), slugify(F.col("subject"))).alias("target"), F.lit("about").alias("type")))
    return nodes, edges.groupBy("source", "target", "type").agg(F.min("seq").alias("position"))


def triples(relations: DataFrame, base: str = "urn:kb:") -> DataFrame:
    """A statement in RDF Turtle for each distinct triple, by IRIs; turtle.turtle_blocks makes whole documents."""
    iri = lambda c: F.concat(F.lit(f"<{base}"), F.replace(F.url_encode(c), F.lit("+"), F.lit("%20")), F.lit(">"))
    return relations.select("subject", "predicate", "object").distinct().select(F.concat_ws(" ", iri(F.col("subject")), iri(F.col("predicate")), iri(F.col("object")), F.lit(".")).alias("statement"))
