"""Where things of a line-structured source begin and end: control spans, nested data levels, programs and what lies in them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fathomkb.sources.spread import range_join

#: Words that are no paragraph though a full stop follows them.
KEYWORDS = """IDENTIFICATION ENVIRONMENT DATA PROCEDURE DIVISION SECTION PROGRAM-ID WORKING-STORAGE FILE LINKAGE STOP RUN END IF ELSE EVALUATE WHEN MOVE COMPUTE
    READ WRITE OPEN CLOSE CALL PERFORM COPY""".split()
#: Levels that stand by themselves, below nothing (77), or at whatever item is before them (66 renames, 88 conditions).
ALONE, ATTACHED = 77, (66, 88)


def logical_lines(files: DataFrame) -> DataFrame:
    """files (path, text) -> path, line (from 1), text (upper case, without sequence number), total (lines of the file): blank lines and comments go.

    A comment starts with *, or has * or / in its seventh column. The first six columns are a sequence number if they hold digits and
    blanks only. A line ends at a line feed, with or without a carriage return; what follows the last one is a line if it isn't empty.
    """
    body = F.regexp_replace(F.regexp_replace("text", "\r\n", "\n"), "\n$", "")
    lines = F.when(F.coalesce("text", F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(body, "\n"))
    rows = files.select("path", F.size(lines).alias("total"), F.posexplode(lines).alias("pos", "raw"))
    bare = F.regexp_replace("raw", r"^\s+|\s+$", "")
    comment = bare.startswith("*") | F.substring("raw", 7, 1).isin("*", "/")
    numbered = (F.length("raw") > 6) & F.substring("raw", 1, 6).rlike(r"^\s*[0-9]+\s*$")
    content = F.when(numbered, F.regexp_replace(F.expr("substring(raw, 7)"), r"^\s+|\s+$", "")).otherwise(bare)
    return rows.filter((bare != "") & ~comment).select("path", (F.col("pos") + 1).alias("line"), F.upper(content).alias("text"), "total").filter("text <> ''")


def control_spans(lines: DataFrame) -> DataFrame:
    """logical_lines -> path, kind (section, paragraph), name, line_start, line_end: each ends before the next control line of its file, the last with the file."""
    word = F.regexp_replace("text", r"\.+$", "")
    paragraph = F.col("text").endswith(".") & ~F.contains(word, F.lit(" ")) & ~word.isin(KEYWORDS) & ~word.rlike("^[0-9]+$") & (word != "")
    kind = F.when(F.col("text").endswith(" SECTION."), "section").when(paragraph, "paragraph")
    c = lines.select("path", "line", "total", kind.alias("kind"), F.when(kind == "section", F.regexp_replace("text", r"\s+SECTION\.$", "")).otherwise(word).alias("name")).filter("kind is not null")
    after = F.lead("line").over(Window.partitionBy("path").orderBy("line"))
    return c.select("path", "kind", "name", F.col("line").alias("line_start"), F.greatest("line", F.coalesce(after - 1, F.col("total"))).cast("int").alias("line_end"))


def nested(rows: DataFrame, scope: str, at: str, level: str, last: str) -> DataFrame:
    """rows with `parent` (at of the last row before with a smaller level) and `end` (before the next row whose level isn't larger, else `last`).

    What a stack does, as windows: a row of level v closes every open level from v on and opens every level beyond it, so it is an
    event for each of the levels that its scope has. Within (scope, level) the row before that opened the level is the parent, and the
    row after that closes it the end. Scopes have few levels (outline depths, indentations, item levels), and rows that many events.
    """
    levels = rows.groupBy(scope).agg(F.array_sort(F.collect_set(level)).alias("levels_"))
    events = rows.join(levels, scope).select(scope, at, level, last, F.explode("levels_").alias("of_"))
    w = Window.partitionBy(scope, "of_").orderBy(at)
    opener = F.when(F.col("of_") > F.col(level), F.col(at))
    closer = F.when(F.col("of_") >= F.col(level), F.col(at))
    before = F.last(opener, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first(closer, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    # a level that an earlier, smaller level has closed since: the last opener is that of the smaller level, as it opens this one too
    own = events.withColumns({"parent": before, "end": F.coalesce(after - 1, F.col(last))}).filter(F.col("of_") == F.col(level))
    return rows.join(own.select(scope, at, "parent", "end"), [scope, at])


def data_levels(lines: DataFrame) -> DataFrame:
    """Data items of logical_lines: path, line, level, name, parent (line of the item that holds it), end (its last line).

    An item is a level number (01 to 49, 66, 77, 88) and a name. Level 77 stands alone; 66 and 88 belong to the item before them and hold
    nothing. Items end at a division or section too.
    """
    found = F.regexp_extract("text", r"^([0-9]{1,2})\s+([A-Z0-9][A-Z0-9_-]*)", 1)
    name = F.regexp_extract("text", r"^[0-9]{1,2}\s+([A-Z0-9][A-Z0-9_-]*)", 1)
    number = F.nullif(found, F.lit("")).cast("int")
    stop = F.col("text").rlike(r"\s(DIVISION|SECTION)\b.*\.$")
    item = lines.select("path", "line", "total", F.when(stop, 0).when(number.between(1, 49) | number.isin(ALONE, *ATTACHED), number).alias("level"), F.when(~stop, name).alias("name")).filter("level is not null")
    depth = F.when(F.col("level") == ALONE, 1).when(F.col("level").isin(*ATTACHED), 99).otherwise(F.col("level"))
    rows = nested(item.withColumn("depth", depth), "path", "line", "depth", "total").filter("name is not null")
    heads = item.filter("level = 0").select(F.col("path").alias("of"), F.col("line").alias("head"))
    rows = rows.join(heads, (F.col("path") == F.col("of")) & (F.col("parent") == F.col("head")), "left")
    return rows.select("path", "line", "level", "name", F.when(F.col("head").isNull(), F.col("parent")).alias("parent"), F.col("end").cast("int").alias("end"))


def programs(files: DataFrame) -> DataFrame:
    """files (path, text) -> path, name, line_start, line_end, paragraphs, sections, data_items, copybooks, calls, external of each program.

    A program reaches from its PROGRAM-ID to the line before the next one of its file, or to the file's end; a file without any is
    one program of the file's name. What is found in lines is joined to programs by ranges of lines. calls are the names called, in
    order; those that no program of any file has are also in external. A name that several programs have counts as known.
    """
    lines = logical_lines(files)
    id_ = F.regexp_extract("text", r"^PROGRAM-ID\.\s+([A-Z0-9_-]+)\.", 1)
    stem = F.upper(F.regexp_extract("path", r"([^/]*?)(\.[^./]*)?$", 1))
    named = lines.select("path", "line", "total", id_.alias("name")).filter("name <> ''")
    after = F.lead("line").over(Window.partitionBy("path").orderBy("line"))
    spans = named.select("path", "name", F.col("line").alias("line_start"), F.coalesce(after - 1, F.col("total")).alias("line_end"))
    none = files.select("path", F.size(F.split("text", "\n")).alias("n")).join(named.select("path").distinct(), "path", "left_anti")
    spans = spans.unionByName(none.select("path", stem.alias("name"), F.lit(1).alias("line_start"), F.greatest(F.lit(1), F.col("n")).alias("line_end")))
    kinds = control_spans(lines).select("path", F.col("line_start").alias("at"), "kind", "name").unionByName(data_levels(lines).select("path", F.col("line").alias("at"), F.lit("data").alias("kind"), "name"))
    get = lambda pattern: F.regexp_extract("text", pattern, 1)
    copied, called = get(r"^COPY\s+([A-Z0-9_-]+)\."), get(r"\bCALL\s+[\"']([A-Z0-9_-]+)[\"']")
    uses = lines.select("path", F.col("line").alias("at"), F.explode(F.array(F.struct(F.lit("copy").alias("kind"), copied.alias("name")), F.struct(F.lit("call").alias("kind"), called.alias("name")))).alias("u"))
    facts = kinds.unionByName(uses.select("path", "at", "u.kind", "u.name").filter("name <> ''")).withColumnRenamed("name", "what")
    placed = range_join(facts, spans, "path", "at", "line_start", "line_end")
    known = spans.select(F.col("name").alias("what"), F.lit(True).alias("known")).distinct()
    placed = placed.join(known, "what", "left")
    n = lambda kind: F.count_if(F.col("kind") == kind)
    names = lambda when: F.array_sort(F.collect_set(F.when(when, F.col("what"))))
    found = placed.groupBy("path", "line_start").agg(n("paragraph").alias("paragraphs"), n("section").alias("sections"), n("data").alias("data_items"), names(F.col("kind") == "copy").alias("copybooks"), names(F.col("kind") == "call").alias("calls"), names((F.col("kind") == "call") & F.col("known").isNull()).alias("external"))
    none = F.array().cast("array<string>")
    zero = {c: F.coalesce(c, F.lit(0)).cast("long") for c in ("paragraphs", "sections", "data_items")} | {c: F.coalesce(c, none) for c in ("copybooks", "calls", "external")}
    return spans.join(found, ["path", "line_start"], "left").withColumns(zero)


def adopt(files: DataFrame, side: DataFrame, own: DataFrame, backend: str = "external") -> DataFrame:
    """Symbols of files (path, kind, text): those of an external parser where it has left a readable side file, else the own parser's.

    side: path, program, symbols (name, kind, line_start, line_end, signature; null ones are left out); own: path, line, kind, name. Returns path, module, kind, name,
    line_start, line_end, signature, backend. An adopted file has one root symbol over all of its lines: the program, or the copybook if that is its
    kind. A missing program is the file's name, a missing line 1, an end before 1 the start, a missing name UNKNOWN, kind data_item and
    signature the name as written. Of several side files of one path the first program counts.
    """
    stem = F.upper(F.regexp_extract("path", r"([^/]*?)(\.[^./]*)?$", 1))
    one = side.groupBy("path").agg(F.min_by(F.struct("program", "symbols"), F.coalesce("program", F.lit(""))).alias("s"))
    both = files.select("path", F.col("kind").alias("of"), F.size(F.split(F.regexp_replace(F.coalesce("text", F.lit("")), "\r?\n$", ""), "\n")).alias("total"), stem.alias("stem")).join(one, "path")
    both = both.withColumn("module", F.upper(F.coalesce(F.nullif("s.program", F.lit("")), "stem")))
    root = both.select("path", "module", F.when(F.col("of") == "copybook", "copybook").otherwise("program").alias("kind"), F.col("module").alias("name"), F.lit(1).alias("line_start"), F.col("total").alias("line_end"), F.concat(F.lit("PROGRAM-ID. "), "module", F.lit(".")).alias("signature"))
    node = both.select("path", "module", F.explode("s.symbols").alias("n")).filter("n is not null")
    text = lambda c: F.nullif(F.col(c), F.lit(""))
    start = F.when(F.col("n.line_start") > 0, F.col("n.line_start")).otherwise(1)
    end = F.when(F.col("n.line_end") > 0, F.col("n.line_end")).otherwise(start)
    node = node.select("path", "module", F.coalesce(text("n.kind"), F.lit("data_item")).alias("kind"), F.upper(F.coalesce(text("n.name"), F.lit("UNKNOWN"))).alias("name"), start.cast("int").alias("line_start"), end.cast("int").alias("line_end"), F.coalesce(text("n.signature"), text("n.name"), F.lit("UNKNOWN")).alias("signature"))
    rest = own.join(one.select("path"), "path", "left_anti").select("path", F.upper(F.regexp_extract("path", r"([^/]*?)(\.[^./]*)?$", 1)).alias("module"), "kind", "name", F.col("line").cast("int").alias("line_start"), F.col("line").cast("int").alias("line_end"), F.col("name").alias("signature"))
    return root.unionByName(node).withColumn("backend", F.lit(backend)).unionByName(rest.withColumn("backend", F.lit("lines")))
