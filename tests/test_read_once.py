"""Files are read once, and only for what is wanted of them."""

from tracequarry.operators import corpus, engineering

FILES = [("a", "package p.q; import static x.Y.z;\nclass A { B b; @GetMapping(\"/a\") int get() { return b.run(); } }"), ("b", "class B { int run() { return 1; } }\n// é"), ("c", None), ("d", "no class }}) é")]


def test_wanted_columns_alone(spark):
    files = spark.createDataFrame(FILES, "path string, content string")
    whole = corpus.symbols(files)
    assert whole.columns == ["path", "package", "imports", "classes", "fields", "methods"]
    some = corpus.symbols(files, "methods", "classes")
    assert some.columns == ["path", "classes", "methods"]
    assert sorted(some.collect()) == sorted(whole.select("path", "classes", "methods").collect())
    first = whole.where("path = 'a'").first()
    assert (first["package"], first["imports"], [tuple(c) for c in first["classes"]], [tuple(f) for f in first["fields"]], [tuple(m) for m in first["methods"]]) == ("p.q", ["x.Y.z"], [("A", 2)], [("b", "B")], [("get", 2, " return b.run(); ")])


def test_edges_read_no_file_again(spark):
    """What files are read for is stored: no plan of the edges reads sources a second time (endpoints were read for each of their two kinds of edges)."""
    files = spark.createDataFrame(FILES, "path string, content string")
    edges = engineering.engineering_edges(files, "p")
    assert "MapInArrow" not in edges._jdf.queryExecution().optimizedPlan().toString()
    assert {tuple(e) for e in edges.collect()} >= {("Endpoint|p|GET|/a", "Method|p|A|get", "INVOKES"), ("Project|p", "Endpoint|p|GET|/a", "EXPOSES"), ("Method|p|A|get", "Method|p|B|run", "CALLS")}
