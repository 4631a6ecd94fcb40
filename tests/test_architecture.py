from pyspark.sql import functions as F

from fathomkb.operators import architecture as A


def test_endpoints(spark):
    raw = spark.createDataFrame([(1, "app.users", "router", "GET", "/{id}", "h1"), (2, "app.users", "router", "GET", "/{id}", "gone"), (3, "app.other", "r2", "POST", None, "h1"), (4, "app.none", "x", "ANY", "", None)], "seq int, module string, var string, verb string, route string, handler string")
    routers = spark.createDataFrame([(1, "app.users", "router", "/users"), (2, "app.users", "router", "/late"), (3, "app.idle", "q", None)], "seq int, module string, var string, prefix string")
    includes = spark.createDataFrame([(1, "router", "users", "/api"), (2, "router", "users", "/second"), (3, "r2", None, "/v2/")], "seq int, router_var string, token string, prefix string")
    got = sorted(tuple(x) for x in A.resolve_endpoints(raw, routers, includes, spark.createDataFrame([("h1",)], "id string")).collect())
    assert [(i, p, h) for i, _, _, p, h in got] == [("endpoint-any-item", "", None), ("endpoint-get-api-users-id", "/api/users/{id}", "h1"), ("endpoint-get-api-users-id-1", "/api/users/{id}", None), ("endpoint-post-v2-dynamic", "/v2/(dynamic)", "h1")]
    assert [tuple(x) for x in A.router_view(routers, includes, raw).collect()] == [("app.users", "router", 2, True), ("app.idle", "q", 0, False)]


def test_layers(spark):
    rows = [("a", "app.routes.x", "h", False), ("b", "app.services.y", "f", False), ("c", "app.models", "User", None), ("d", "app.util", "u", False), ("e", "app.user_repo", "q", False), ("f", "app.schemas.models", "M", False), ("g", "app.util", "Row", True), ("h", "app.schemas", "S", False)]
    s = spark.createDataFrame(rows, "id string, module string, title string, is_model boolean")
    got = {x.id: x.l for x in s.select("id", A.layer(F.col("module"), F.col("is_model")).alias("l")).collect()}
    assert got == {"a": "route", "b": "service", "c": "model", "d": "other", "e": "repo", "f": "model", "g": "model", "h": "schema"}
    pairs = [("a", "calls", "b"), ("b", "calls", "a"), ("b", "calls", "c"), ("a", "calls", "d"), ("a", "reads", "c"), ("a", "calls", "b"), ("b", "calls", "e"), ("e", "calls", "g"), ("a", "calls", "h")]
    e = spark.createDataFrame(pairs, "subject string, predicate string, object string")
    assert {tuple(x) for x in A.layer_flow(s, e).collect()} == {("route", "app.routes.x", "service", "app.services.y"), ("service", "app.services.y", "model", "User"), ("service", "app.services.y", "repo", "app.user_repo"), ("repo", "app.user_repo", "model", "Row")}


def test_heading_ancestry(spark):
    s = spark.createDataFrame([(1, 1, 1, "A"), (1, 2, 3, "B"), (1, 3, 2, "C"), (1, 4, 3, "D"), (1, 5, 1, "E"), (1, 6, 3, "F"), (2, 1, 2, "G")], "doc_id int, n int, level int, heading string")
    got = {x.heading: x.ancestors for x in A.heading_ancestry(s).collect()}
    assert got == {"A": [], "B": ["A"], "C": ["A"], "D": ["A", "C"], "E": [], "F": ["E"], "G": []}


def test_trace_coverage(spark):
    expected = spark.createDataFrame([("s1", "source"), ("s2", "source"), ("t1", "target"), ("t2", "target")], "id string, side string")
    entries = spark.createDataFrame([("s1", "t1"), ("s3", None)], "source_id string, target_id string")
    assert {tuple(x) for x in A.trace_coverage(expected, entries).collect()} == {("s2", "untraced_source"), ("t2", "target_without_source")}
    assert A.layer(F.lit("a")) is not None
