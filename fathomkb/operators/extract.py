"""From text to rows: sentences, sections, boilerplate, rules and claims; Python and COBOL sources."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Each start has one match to try: none inside a run, and a run without a mark is given up at once.
SENTENCE = r"(?<![^.!?\n])[^.!?\n]++[.!?]"
#: Terms that mark an obligation, and section roles by keyword.
OBLIGATIONS = ["must", "shall", "required", "requires", "should", "approve", "escalate", "document"]
ROLES = [("scope", "scope"), ("definition", "definitions"), ("responsib", "responsibilities"), ("procedure", "procedure"), ("exception", "exceptions"), ("overview", "overview")]


def matches(docs: DataFrame, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, pos (from 0), match, start (code points from 0) of every match of a pattern, without a UDF.

    The pieces between matches give the offsets: a match starts where all pieces up to it and all matches before it end.
    """
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).withColumn("m", F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).filter(F.size("m") > 0).withColumn("p", F.split("text", pattern, -1))
    rows = d.select("doc_id", F.posexplode(F.expr("transform(m, (x, i) -> struct(x as match, length(p[i]) as gap))"))).select("doc_id", "pos", "col.match", "col.gap")
    w = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("start", F.sum(F.col("gap") + F.length("match")).over(w) - F.length("match")).drop("gap")


def sentences(docs: DataFrame, terms: list[str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, pos, sentence (white space collapsed) of sentences that contain any of the terms; None: of all."""
    found = F.regexp_extract_all(text_col, F.lit(SENTENCE), F.lit(0))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(found)).select("doc_id", "pos", F.trim(F.regexp_replace("col", r"\s+", " ")).alias("sentence")).filter("sentence <> ''")
    if terms is None:
        return rows
    low = F.lower("sentence")
    return rows.filter(F.exists(F.array(*map(F.lit, terms)).cast("array<string>"), lambda t: F.contains(low, t)))


def mined_claims(docs: DataFrame, terms: list[str] = OBLIGATIONS) -> DataFrame:
    """Claims from obligation sentences: predicate by keyword, confidence 0.82, a number within the document."""
    low = F.lower("sentence")
    predicate = F.when(low.contains("should"), "should").when(low.contains("route"), "route").when(low.contains("record"), "record").otherwise("requires")
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("pos"))
    return sentences(docs, terms).withColumn("n", n).select("doc_id", F.format_string("ki-%s-%06d", F.col("doc_id").cast("string"), "n").alias("id"), predicate.alias("predicate"), F.col("sentence").alias("object"), F.lit(0.82).alias("confidence"))


def sections(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """ATX sections of Markdown: doc_id, n, level, heading, role, start, end (code points).

    A heading is one to six # and white space; a lone # takes the next line as its text; text before the first
    heading belongs to none; a text without headings is one section "Document".
    """
    lines = docs.select(F.col(id_col).alias("doc_id"), F.length(text_col).alias("total"), F.posexplode(F.split(text_col, "\n")))
    w = Window.partitionBy("doc_id").orderBy("pos")
    lines = lines.withColumn("start", F.sum(F.length("col") + 1).over(w) - F.length("col") - 1).withColumn("following", F.lead("col").over(w))
    heads = lines.filter(F.col("col").rlike(r"^#{1,6}(\s|$)"))
    text = F.trim(F.regexp_replace("col", r"^#{1,6}\s*", ""))
    heads = heads.select("doc_id", "total", F.length(F.regexp_extract("col", "^(#+)", 1)).alias("level"), F.when(text == "", F.trim(F.coalesce("following", F.lit("")))).otherwise(text).alias("heading"), "start")
    h = Window.partitionBy("doc_id").orderBy("start")
    heads = heads.select("doc_id", F.row_number().over(h).alias("n"), "level", "heading", "start", F.coalesce(F.lead("start").over(h), F.col("total")).alias("end"))
    none = docs.select(F.col(id_col).alias("doc_id"), F.length(text_col).alias("end")).join(heads.select("doc_id").distinct(), "doc_id", "left_anti")
    whole = none.select("doc_id", F.lit(1).alias("n"), F.lit(1).alias("level"), F.lit("Document").alias("heading"), F.lit(0).cast("long").alias("start"), "end")
    return heads.unionByName(whole).withColumn("role", section_role(F.col("heading")))


def section_role(heading: Column) -> Column:
    low, role = F.lower(heading), F.lit("general")
    for word, name in reversed(ROLES):
        role = F.when(low.contains(word), name).otherwise(role)
    return role


def html_headings(pages: DataFrame) -> DataFrame:
    """page_id, n, level, heading of the h1 to h6 elements of pages, tags inside dropped."""
    found = F.regexp_extract_all("html", F.lit(r"(?is)<h[1-6][^>]*>.*?</h[1-6]>"), F.lit(0))
    h = pages.select("page_id", F.posexplode(found))
    return h.select("page_id", (F.col("pos") + 1).alias("n"), F.regexp_extract("col", "(?i)^<h([1-6])", 1).cast("int").alias("level"), F.trim(F.regexp_replace("col", "<[^>]*>", "")).alias("heading"))


def boilerplate_key(line: Column) -> Column:
    return F.regexp_replace(F.trim(line), "[0-9]+", "#")


def repeated_lines(docs: DataFrame, group: str, share: float = 0.6, least: int = 4, edge: int = 5, text_col: str = "text") -> DataFrame:
    """group, key, pages: keys of lines among the first or last `edge` non-blank lines of at least `share` of a group's texts (of groups of `least` or more)."""
    rows = docs.select(F.col(group).alias("group"), F.monotonically_increasing_id().alias("page"), F.expr(f"filter(transform(split({text_col}, '\\n'), x -> regexp_replace(trim(x), '[0-9]+', '#')), x -> x <> '')").alias("lines"))
    size = rows.groupBy("group").agg(F.count("*").alias("total")).filter(F.col("total") >= least)
    edges = F.array_distinct(F.concat(F.slice("lines", 1, edge), F.slice("lines", F.greatest(F.size("lines") - edge + 1, F.lit(1)), F.lit(edge))))
    keys = rows.select("group", F.explode(edges).alias("key")).groupBy("group", "key").agg(F.count("*").alias("pages"))
    return keys.join(size, "group").filter(F.col("pages") >= share * F.col("total")).select("group", "key", "pages")


#: Keyword rules (rule, words in the text).
KEYWORD_RULES = [("approval_required", ("approv", "authori")), ("escalation", ("escalat", "route")), ("documentation", ("document", "record"))]


def decision_rules(items: DataFrame, text: str = "source_text", rules: list[tuple[str, tuple[str, ...]]] = KEYWORD_RULES, authored: str | None = None) -> DataFrame:
    """id, rule: authored rules win; else the keyword rules that fit; else one generic rule."""
    low = F.lower(text)
    found = F.array_compact(F.array(*(F.when(F.greatest(F.lit(False), *(low.contains(w) for w in words)), F.lit(name)) for name, words in rules)))
    found = F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("follow_guidance")))
    if authored:
        found = F.when(F.size(F.coalesce(F.col(authored), F.array().cast("array<string>"))) > 0, F.col(authored)).otherwise(found)
    return items.select("id", F.explode(found).alias("rule"))


def grounded(candidates: DataFrame, section_text: str = "section_text", claim: str = "claim", start: str = "section_start") -> DataFrame:
    """Claimed text found verbatim in its section gets exact offsets; else it is llm_claimed with null offsets."""
    at = F.expr(f"locate({claim}, {section_text})")
    return candidates.withColumn("span_status", F.when(at > 0, "exact").otherwise("llm_claimed")).withColumn("start_pos", F.when(at > 0, F.col(start) + at - 1)).withColumn("end_pos", F.when(at > 0, F.col(start) + at - 1 + F.length(claim)))


SYMBOLS = "path string, module string, qualified_name string, title string, kind string, line_start int, line_end int, bases array<string>, decorators array<string>, calls array<string>, imports array<string>, env array<string>, files array<string>, raises array<string>, route string, error string"
VERBS = {"get", "post", "put", "patch", "delete", "head", "options", "trace"}
#: Calls that read the environment.
ENVIRONMENT = {"os.environ.get", "environ.get", "os.getenv"}


def _dotted(node: ast.AST) -> str | None:
    if isinstance(node, ast.Call):
        return _dotted(node.func)
    if isinstance(node, ast.Attribute):
        return f"{base}.{node.attr}" if (base := _dotted(node.value)) else node.attr
    return node.id if isinstance(node, ast.Name) else None


def _own_nodes(body: list) -> Iterator[ast.AST]:
    """The nodes of a body, but for what nested functions, classes and lambdas hold."""
    todo = list(body)
    while todo:
        node = todo.pop()
        yield node
        if not isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef, ast.Lambda)):
            todo += ast.iter_child_nodes(node)


def _text(node: ast.AST | None) -> str | None:
    return node.value if isinstance(node, ast.Constant) and isinstance(node.value, str) else None


def _file_access(call: ast.Call, name: str) -> str | None:
    """"reads x" or "writes x" for a call that opens, reads or writes files."""
    if name == "open" or name.endswith(".open"):
        given = [_text(call.args[1])] if len(call.args) > 1 else []
        mode = next((m for m in [*(_text(k.value) for k in call.keywords if k.arg == "mode"), *given] if m), "r")
        return f"{'writes' if set(mode) & set('wa+') else 'reads'} file-open:{mode}"
    tail = name.rpartition(".")[2] if "." in name else ""
    return {"read_text": "reads file-read", "read_bytes": "reads file-read", "glob": "reads file-glob", "write_text": "writes file-write", "write_bytes": "writes file-write"}.get(tail)


def _facts(body: list) -> tuple[list[str], list[str], list[str], list[str]]:
    """calls, environment variables read, file accesses, exceptions raised in a body's own scope."""
    calls, env, files, raises = set(), set(), set(), set()
    for x in _own_nodes(body):
        if isinstance(x, ast.Call) and (name := _dotted(x.func)):
            calls.add(name)
            if name in ENVIRONMENT and x.args and (key := _text(x.args[0])):
                env.add(key)
            if access := _file_access(x, name):
                files.add(access)
        elif isinstance(x, ast.Raise) and x.exc is not None:
            raises.add(_dotted(x.exc) or ast.unparse(x.exc))
    return sorted(calls), sorted(env), sorted(files), sorted(raises)


def python_symbols(files: DataFrame) -> DataFrame:
    """files (path, text) of Python -> a row for each module, class, function, method, test and upper-case constant.

    Does not enter if, try or with bodies. Calls, environment reads, file accesses and exceptions are those of a
    function's own scope. A file that doesn't parse is one row with its error.
    """
    none: list = []

    def rows_of(path: str, text: str) -> Iterator[tuple]:
        module = path.removesuffix(".py").replace("/", ".").removesuffix(".__init__")
        title = module.rpartition(".")[2]
        try:
            tree = ast.parse(text or "")
        except (SyntaxError, ValueError) as e:
            yield path, module, module, title, "module", 1, 1, none, none, none, none, none, none, none, None, str(e)
            return
        top = tree.body
        imports = sorted({a.name for n in top if isinstance(n, ast.Import) for a in n.names} | {n.module for n in top if isinstance(n, ast.ImportFrom) and n.module and not n.level})
        yield path, module, module, title, "module", 1, len((text or "").splitlines()), none, none, none, imports, none, none, none, None, None

        def walk(body: list, parent: str, in_class: bool) -> Iterator[tuple]:
            for n in body:
                if isinstance(n, ast.ClassDef):
                    name = f"{parent}.{n.name}"
                    bases = [_dotted(b) or ast.unparse(b) for b in n.bases]
                    yield path, module, name, n.name, "class", n.lineno, n.end_lineno, bases, [d for d in map(_dotted, n.decorator_list) if d], none, none, none, none, none, None, None
                    yield from walk(n.body, name, True)
                elif isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)):
                    name = f"{parent}.{n.name}"
                    calls, env, files_, raises = _facts(n.body)
                    routes = [d for d in n.decorator_list if isinstance(d, ast.Call) and isinstance(d.func, ast.Attribute) and d.func.attr in VERBS]
                    route = ";".join(f"{d.func.attr.upper()} {_text(d.args[0]) if d.args and _text(d.args[0]) is not None else '(dynamic)'}" for d in routes) or None
                    kind = "test" if n.name.startswith("test_") else "method" if in_class else "function"
                    yield path, module, name, n.name, kind, n.lineno, n.end_lineno, none, [d for d in map(_dotted, n.decorator_list) if d], calls, none, env, files_, raises, route, None
                    yield from walk(n.body, f"{name}.<locals>", False)
                elif isinstance(n, ast.Assign) and not in_class and len(n.targets) == 1 and isinstance(n.targets[0], ast.Name) and n.targets[0].id.isupper():
                    yield path, module, f"{parent}.{n.targets[0].id}", n.targets[0].id, "constant", n.lineno, n.end_lineno, none, none, none, none, none, none, none, None, None

        yield from walk(tree.body, module, False)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            yield pd.DataFrame([r for p, t in zip(pdf["path"], pdf["text"]) for r in rows_of(p, t)], columns=[c.split()[0] for c in SYMBOLS.split(", ")])

    return files.select("path", "text").mapInPandas(run, SYMBOLS)


def _keyword(call: ast.Call, name: str) -> ast.AST | None:
    return next((k.value for k in call.keywords if k.arg == name), None)


def _methods(call: ast.Call) -> list[str]:
    """The HTTP methods that a route names; GET without any."""
    given = _keyword(call, "methods")
    return [m.upper() for m in map(_text, given.elts) if m] if isinstance(given, (ast.List, ast.Tuple)) else ["GET"]


def _slashed(*parts: str | None) -> str:
    return "".join("/" + p.strip("/") for p in parts if p and p.strip("/")) or "/"


def _module_entry_points(module: str, tree: ast.Module) -> Iterator[tuple[str, str, str, str | None]]:
    """(kind, verb, name, handler) of a module's routes, url patterns, commands, tasks and script."""
    calls = [x for x in ast.walk(tree) if isinstance(x, ast.Call)]
    made = {t.id: x.value for x in ast.walk(tree) if isinstance(x, ast.Assign) and isinstance(x.value, ast.Call) for t in x.targets if isinstance(t, ast.Name)}
    prefix = {v: _text(_keyword(c, "url_prefix")) for v, c in made.items() if (_dotted(c) or "").rpartition(".")[2] == "Blueprint"}
    for c in calls:  # the prefix given at registration wins
        if (_dotted(c) or "").endswith(".register_blueprint") and c.args and isinstance(c.args[0], ast.Name) and (given := _text(_keyword(c, "url_prefix"))):
            prefix[c.args[0].id] = given
    for f in ast.walk(tree):
        for d in getattr(f, "decorator_list", ()) if isinstance(f, (ast.FunctionDef, ast.AsyncFunctionDef)) else ():
            owner, _, last = (_dotted(d) or "").rpartition(".")
            call = d if isinstance(d, ast.Call) else None
            first = _text(call.args[0]) if call and call.args else None
            if last == "route" and owner and call:
                yield from (("http", verb, _slashed(prefix.get(owner), first), f.name) for verb in _methods(call))
            elif last in ("command", "group") and owner:
                yield "cli", "", first or (_text(_keyword(call, "name")) if call else None) or f.name.replace("_", "-"), f.name
            elif last == "shared_task" or (last == "task" and owner):
                yield "task", "", (_text(_keyword(call, "name")) if call else None) or f"{module}.{f.name}", f.name
    handlers = {c.func.value.id: _dotted(_keyword(c, "func")) for c in calls if isinstance(c.func, ast.Attribute) and c.func.attr == "set_defaults" and isinstance(c.func.value, ast.Name) and _keyword(c, "func")}
    parsers = {id(c): v for v, c in made.items()}
    for c in calls:
        owner, _, last = (_dotted(c.func) or "").rpartition(".")
        first = _text(c.args[0]) if c.args else None
        if last == "add_url_rule" and owner:
            view = _keyword(c, "view_func") or (c.args[2] if len(c.args) > 2 else None)
            yield from (("http", verb, _slashed(prefix.get(owner), first), _dotted(view) if view else None) for verb in _methods(c))
        elif last in ("path", "re_path", "url") and first is not None and len(c.args) > 1:
            yield "http", "ANY", first, _dotted(c.args[1])
        elif last == "add_parser" and owner and first:
            yield "cli", "", first, handlers.get(parsers.get(id(c), ""))
    guard = any(isinstance(x, ast.If) and "__name__" in ast.unparse(x.test) and "__main__" in ast.unparse(x.test) for x in tree.body)
    main = any(isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef)) and x.name == "main" for x in tree.body)
    if guard or main:
        yield "script", "", module, "main" if main else None


def _parsed_modules(pdf: pd.DataFrame) -> Iterator[tuple[str, str, ast.Module]]:
    for path, text in zip(pdf["path"], pdf["text"]):
        try:
            yield path, path.removesuffix(".py").replace("/", ".").removesuffix(".__init__"), ast.parse(text or "")
        except (SyntaxError, ValueError):
            continue  # python_symbols reports it


def entry_points(files: DataFrame) -> DataFrame:
    """files (path, text) of Python -> path, kind (http, cli, task, script), verb, name, handler.

    Routes by decorator (one row a method; GET by default) and by add_url_rule, with the prefix of their blueprint, which the
    one given at registration overrides; url patterns (ANY); commands and groups; sub-parsers with the function that
    set_defaults names; tasks (named module.function by default); a script where there is a main or a main guard.
    Files that don't parse give no rows.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            yield pd.DataFrame([(p, *e) for p, m, t in _parsed_modules(pdf) for e in _module_entry_points(m, t)], columns=["path", "kind", "verb", "name", "handler"])

    return files.select("path", "text").mapInPandas(run, "path string, kind string, verb string, name string, handler string")


COLUMN_CALLS = ("Column", "mapped_column", "relationship")


def _class_fields(c: ast.ClassDef) -> Iterator[tuple[str, str, str | None]]:
    """(field, how, type): columns and relations by the first argument's type, annotated fields by their annotation."""
    for n in c.body:
        target = n.targets[0] if isinstance(n, ast.Assign) and len(n.targets) == 1 else n.target if isinstance(n, ast.AnnAssign) else None
        if not isinstance(target, ast.Name) or target.id == "__tablename__":
            continue
        last = (_dotted(n.value.func) or "").rpartition(".")[2] if isinstance(n.value, ast.Call) else ""
        if last in COLUMN_CALLS:
            first = n.value.args[0] if n.value.args else None
            yield target.id, last, (_text(first) or _dotted(first)) if first is not None else None
        elif isinstance(n, ast.AnnAssign):
            yield target.id, "annotated", ast.unparse(n.annotation)


def data_models(files: DataFrame) -> DataFrame:
    """files (path, text) of Python -> path, name, bases and decorators (last segments), table_name, fields (name, how, type) of module-level classes."""

    def rows_of(pdf: pd.DataFrame) -> Iterator[tuple]:
        short = lambda nodes: [x.rpartition(".")[2] for x in map(_dotted, nodes) if x]
        for path, _, tree in _parsed_modules(pdf):
            for c in tree.body:
                if isinstance(c, ast.ClassDef):
                    table = next((_text(n.value) for n in c.body if isinstance(n, ast.Assign) and isinstance(n.targets[0], ast.Name) and n.targets[0].id == "__tablename__"), None)
                    yield path, c.name, short(c.bases), short(c.decorator_list), table, [dict(zip(("name", "how", "type"), f)) for f in _class_fields(c)]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            yield pd.DataFrame(rows_of(pdf), columns=["path", "name", "bases", "decorators", "table_name", "fields"])

    return files.select("path", "text").mapInPandas(run, "path string, name string, bases array<string>, decorators array<string>, table_name string, fields array<struct<name: string, how: string, type: string>>")


def excerpts(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """id, excerpt of symbols (id, path, line_start, line_end): the lines of their files from start to end."""
    lines = files.select("path", F.split("text", "\n").alias("lines"))
    return symbols.join(lines, "path").select("id", F.array_join(F.slice("lines", F.col("line_start"), F.col("line_end") - F.col("line_start") + 1), "\n").alias("excerpt"))


def cobol_symbols(files: DataFrame) -> DataFrame:
    """files (path, text) of COBOL -> path, line, kind, name: programs, sections, paragraphs, copies, files and data items, by native expressions."""
    lines = files.select("path", F.posexplode(F.split("text", "\n"))).select("path", (F.col("pos") + 1).alias("line"), F.upper(F.trim(F.regexp_replace("col", r"^[0-9]{6}", ""))).alias("t")).filter(~F.col("t").startswith("*") & (F.col("t") != ""))
    get = lambda pattern: F.nullif(F.regexp_extract("t", pattern, 1), F.lit(""))
    rules = [("program", r"^PROGRAM-ID\.\s+([A-Z0-9-]+)"), ("section", r"^([A-Z0-9-]+)\s+SECTION\."), ("copy", r"^COPY\s+([A-Z0-9-]+)"), ("file", r"^FD\s+([A-Z0-9-]+)"), ("record", r"^01\s+([A-Z0-9-]+)"), ("data_item", r"^[0-4][0-9]\s+([A-Z0-9-]+)"), ("paragraph", r"^([A-Z0-9-]+)\.$")]
    first = F.coalesce(*(F.when(get(p).isNotNull(), F.struct(F.lit(k).alias("kind"), get(p).alias("name"))) for k, p in rules))
    return lines.withColumn("s", first).filter("s is not null").filter("not (s.kind = 'section' and s.name in ('DATA', 'PROCEDURE'))").select("path", "line", "s.kind", "s.name")


def cobol_facts(files: DataFrame) -> DataFrame:
    """path, predicate, name: PERFORM, CALL, READ, WRITE and GO TO targets."""
    facts = [("performs", r"(?i)\bPERFORM\s+([A-Z0-9-]+)"), ("calls", r"(?i)\bCALL\s+[\"']([A-Z0-9-]+)"), ("reads", r"(?i)\bREAD\s+([A-Z0-9-]+)"), ("writes", r"(?i)\bWRITE\s+([A-Z0-9-]+)"), ("jumps_to", r"(?i)\bGO\s+TO\s+([A-Z0-9-]+)")]
    tagged = lambda kind, pattern: F.transform(F.regexp_extract_all("text", F.lit(pattern), F.lit(1)), lambda x: F.struct(F.lit(kind).alias("predicate"), F.upper(x).alias("name")))
    found = F.flatten(F.array(*(tagged(k, p) for k, p in facts)))
    return files.select("path", F.explode(found).alias("f")).select("path", "f.predicate", "f.name").distinct()


def all_symbols(python: DataFrame, cobol: DataFrame) -> DataFrame:
    """The symbols of all parsers as one: language, path, line, kind, name."""
    a = python.select(F.lit("python").alias("language"), "path", F.col("line_start").alias("line"), "kind", F.col("qualified_name").alias("name"))
    return a.unionByName(cobol.select(F.lit("cobol").alias("language"), "path", "line", "kind", "name"))
