"""Markdown documents with a block of YAML before them: read and checked row by row, and rendered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a checked document says is wrong.
UNTERMINATED, INVALID, NO_MAPPING = "unterminated YAML frontmatter", "invalid YAML frontmatter", "frontmatter must be a mapping"
NO_TYPE, NO_LIST, NO_RESOURCE = "missing required frontmatter key: type", "sources must be a list when present", "each sources entry must include resource"

KEY = r"""^(?:"([^"]*)"|'([^']*)'|([^\s"'\[\]{},#&*!|>%@`-][^:#]*?|-[^\s:#][^:#]*?))\s*:(?:\s+(.*))?$"""
TOKEN = "struct<level:int,item:boolean,key:string,value:string>"
NODE = "struct<path:string,parent:string,item:boolean,value:string>"


def _value(x: Column) -> Column:
    """A scalar as text: quotes and a comment behind it go, null and ~ are null; "" where there is none."""
    bare = F.regexp_replace(x, r"\s+#.*$", "")
    quoted = F.when(x.rlike(r'^".*"\s*(#.*)?$'), F.replace(F.replace(F.replace(F.regexp_extract(x, r'^"(.*)"', 1), F.lit("\\n"), F.lit("\n")), F.lit('\\"'), F.lit('"')), F.lit("\\\\"), F.lit("\\")))
    quoted = quoted.when(x.rlike(r"^'.*'\s*(#.*)?$"), F.replace(F.regexp_extract(x, r"^'(.*)'", 1), F.lit("''"), F.lit("'")))
    return F.coalesce(quoted, F.when(~F.lower(bare).isin("null", "~"), F.trim(bare)))


def _tokens(line: Column) -> Column:
    """A line as what it opens: a list item for each dash before it, then a key, or a bare value. Blank lines and comments open nothing."""
    indent = F.length(F.regexp_extract(line, "^( *)", 1))
    rest = F.regexp_replace(line, r"^\s+|\s+$", "")
    dashes = F.length(F.regexp_replace(F.regexp_extract(rest, r"^((?:-\s+)*(?:-$)?)", 1), "[^-]", ""))
    after = F.regexp_replace(rest, r"^(?:-\s+)*(?:-$)?", "")
    at = lambda i: indent + i * 2
    items = F.transform(F.sequence(F.lit(0), F.greatest(dashes, F.lit(1)) - 1), lambda i: F.struct(at(i) * 2 + 1, F.lit(True), F.lit(None), F.lit(None)).cast(TOKEN))
    key = F.coalesce(*(F.nullif(F.regexp_extract(after, KEY, g), F.lit("")) for g in (1, 2, 3)))
    named = F.struct(at(dashes) * 2, F.lit(False), key, F.regexp_extract(after, KEY, 4)).cast(TOKEN)
    bare = F.struct(at(dashes) * 2, F.lit(False), F.lit(None), after).cast(TOKEN)
    own = F.when(after == "", F.array().cast(f"array<{TOKEN}>")).when(after.rlike(KEY), F.array(named)).otherwise(F.array(bare))
    none = F.array().cast(f"array<{TOKEN}>")
    return F.when((rest == "") | rest.startswith("#"), none).otherwise(F.concat(F.when(dashes > 0, items).otherwise(none), own))


def _nodes(tokens: Column) -> Column:
    """Tokens as nodes in order: path (like sources[0].resource), its parent's path, whether it is a list item, its value.

    One pass with a stack of what is open; the block of a document is in its row, so nothing is shuffled.
    """
    state = f"struct<open:array<struct<level:int,path:string>>,out:array<{NODE}>>"
    start = F.struct(F.array().cast("array<struct<level:int,path:string>>").alias("open"), F.array().cast(f"array<{NODE}>").alias("out")).cast(state)

    def step(acc: Column, t: Column) -> Column:
        open_ = F.filter(acc["open"], lambda o: o["level"] < t["level"])
        parent = F.coalesce(F.try_element_at(open_, F.lit(-1))["path"], F.lit(""))
        n = F.size(F.filter(acc["out"], lambda o: o["item"] & (o["parent"] == parent)))
        under = F.when(parent == "", t["key"]).otherwise(F.concat(parent, F.lit("."), t["key"]))
        path = F.when(t["item"], F.concat(parent, F.lit("["), n.cast("string"), F.lit("]"))).when(t["key"].isNull(), parent).otherwise(under)
        node = F.struct(path, parent, t["item"], t["value"]).cast(NODE)
        return F.struct(F.concat(open_, F.array(F.struct(t["level"], path).cast("struct<level:int,path:string>"))).alias("open"), F.concat(acc["out"], F.array(node)).alias("out")).cast(state)

    return F.aggregate(tokens, start, step, lambda acc: acc["out"])


def read_documents(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with front (path -> value of the block before the body), body and error (null where there is nothing wrong).

    A text whose first line isn't --- is all body, and not checked. Else the block reaches to the next --- and holds mappings and lists by
    indentation, lists in brackets of plain values, and quoted values; list items are paths like tags[0]. Errors, the first that
    fits: no second ---; a line that is neither key, item nor value; a block that is a list or a value; no type; sources that
    are no list; a source without a resource. An erroneous block has a null front and an empty body. A null text is an empty
    one. Of equal keys the last counts. Anchors, tags, block scalars and mappings in braces are not read: they are invalid.
    """
    t = F.replace(F.coalesce(F.col(f"`{text}`"), F.lit("")), F.lit("\r\n"), F.lit("\n"))
    lines = F.split(F.regexp_replace(t, "\n$", ""), "\n")
    d = docs.withColumn("lines_", lines).withColumn("fenced_", F.trim(F.element_at("lines_", 1)) == "---")
    fences = F.filter(F.sequence(F.lit(1), F.size("lines_")), lambda i: (i > 1) & (F.trim(F.element_at("lines_", i)) == "---"))
    d = d.withColumn("end_", F.when(F.col("fenced_"), F.try_element_at(fences, F.lit(1))))
    tokens = F.flatten(F.transform(F.slice("lines_", F.lit(2), F.col("end_") - 2), _tokens))
    d = d.withColumn("tokens_", tokens).withColumn("nodes_", F.when(F.col("end_").isNotNull(), _nodes(F.col("tokens_"))))
    flow = r"^\[(.*)\]\s*(?:#.*)?$"
    in_list = lambda n: F.transform(F.filter(F.split(F.regexp_extract(n["value"], flow, 1), r"\s*,\s*"), lambda x: F.trim(x) != ""), lambda x, i: F.struct(F.concat(n["path"], F.lit("["), i.cast("string"), F.lit("]")).alias("path"), _value(F.trim(x)).alias("value")))
    leaves = F.flatten(F.transform(F.filter("nodes_", lambda n: F.coalesce(n["value"], F.lit("")) != ""), lambda n: F.when(n["value"].rlike(flow), in_list(n)).otherwise(F.array(F.struct(n["path"].alias("path"), _value(n["value"]).alias("value"))))))
    d = d.withColumn("leaves_", leaves)
    last = lambda path: F.element_at(F.filter("leaves_", lambda x: x["path"] == path), -1)["value"]
    get = lambda path: F.coalesce(F.when(F.exists("leaves_", lambda x: x["path"] == path), last(path)), F.lit(""))
    odd = F.exists("tokens_", lambda x: ~x["item"] & x["key"].isNull() & (x["value"].rlike(r"^[&*!|>%@`{}]") | x["value"].rlike(r":\s") | x["value"].rlike(r"^[^\s]+:$")))
    odd = odd | F.exists("nodes_", lambda n: F.coalesce(n["value"], F.lit("")).rlike(r"^(?:[|>][+-]?\d*$|[&*!{@`%]|\[[^\]]*$)"))
    top = F.element_at("nodes_", 1)
    top_bad = (F.size("nodes_") > 0) & (top["item"] | (top["path"] == ""))
    mixed = F.exists("nodes_", lambda n: (n["parent"] == "") & (n["item"] | (n["path"] == "")))
    items = F.filter("nodes_", lambda n: n["item"] & (n["parent"] == "sources"))
    inline = F.filter("leaves_", lambda x: x["path"].rlike(r"^sources\[\d+\]$"))
    has_sources = F.exists("nodes_", lambda n: n["path"] == "sources") & ((F.size(items) > 0) | (F.size(inline) > 0) | (get(F.lit("sources")) != "") | F.exists("nodes_", lambda n: n["path"].startswith("sources.")))
    lists = (F.size(items) > 0) | (F.size(inline) > 0)
    lacking = F.exists(items, lambda n: get(F.concat(n["path"], F.lit(".resource"))).isin("", "false", "0", "0.0")) | (F.size(inline) > 0)
    error = (
        F.when(~F.col("fenced_"), None).when(F.col("end_").isNull(), UNTERMINATED).when(odd, INVALID).when(top_bad, NO_MAPPING).when(mixed, INVALID)
        .when(get(F.lit("type")).isin("", "false", "0", "0.0") & ~F.exists("nodes_", lambda n: n["parent"] == "type") & ~F.exists("leaves_", lambda x: x["path"].startswith("type[")), NO_TYPE)
        .when(has_sources & ~lists, NO_LIST).when(has_sources & lacking, NO_RESOURCE)
    )
    d = d.withColumn("error", error)
    front = F.map_from_entries(F.transform(F.array_distinct(F.transform("leaves_", lambda x: x["path"])), lambda p: F.struct(p, last(p))))
    rest = F.regexp_replace(F.array_join(F.slice("lines_", F.col("end_") + 1, F.size("lines_")), "\n"), r"^\n+", "")
    body = F.when(~F.col("fenced_"), F.coalesce(F.col(f"`{text}`"), F.lit(""))).when(F.col("error").isNull(), rest).otherwise("")
    ok = F.col("fenced_") & F.col("error").isNull()
    return d.select(*(F.col(f"`{c}`") for c in docs.columns if c not in ("front", "body", "error")), F.when(ok, front).alias("front"), body.alias("body"), "error")


def plain_scalar(x: Column) -> Column:
    """A text as a YAML value: as it is where that reads back as the same text, else in double quotes."""
    text = F.replace(F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))
    odd = (x == "") | x.rlike(r"""^[\s"'\[\]{},#&*!|>%@`?:-]|\s$|:(\s|$)|\s#|\n""") | F.lower(x).isin("null", "~", "true", "false", "yes", "no", "on", "off") | x.rlike(r"^[-+.\d][\d_.eE+-]*$")
    return F.when(odd, F.concat(F.lit('"'), text, F.lit('"'))).otherwise(x)


def document_lines(rows: DataFrame, name: str, keys: list[str], lists: dict[str, list[str]], body: str) -> DataFrame:
    """Documents as lines for a sink: document, line, text. The keys stand in this order, then the lists, then the body.

    keys are columns of texts (null ones are left out), lists are columns of arrays of structs whose named fields each entry has; body
    is a column of text, whose lines follow a blank one. A row is a document; its lines are numbered within the row.
    """
    head = [F.when(F.col(k).isNotNull(), F.concat(F.lit(f"{k}: "), plain_scalar(F.col(k).cast("string")))) for k in keys]

    def block(key: str, fields: list[str]) -> Column:
        def entry(x: Column) -> Column:
            named = F.array_compact(F.array(*(F.when(x[f].isNotNull(), F.concat(F.lit(f"{f}: "), plain_scalar(x[f].cast("string")))) for f in fields)))
            return F.transform(named, lambda s, i: F.concat(F.when(i == 0, "- ").otherwise("  "), s))

        return F.when(F.size(key) > 0, F.concat(F.array(F.lit(f"{key}:")), F.flatten(F.transform(key, entry)))).otherwise(F.array().cast("array<string>"))

    blocks = [block(k, fields) for k, fields in lists.items()]
    tail = F.split(F.regexp_replace(F.coalesce(body, F.lit("")), "\n$", ""), "\n")
    all_ = F.concat(F.array(F.lit("---")), F.array_compact(F.array(*head)), *blocks, F.array(F.lit("---"), F.lit("")), tail)
    return rows.select(F.col(name).alias("document"), F.posexplode(all_).alias("line", "text")).withColumn("line", F.col("line") + 1)
