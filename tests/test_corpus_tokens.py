"""Declarations read off tokens: literals and comments hold no braces, names stand where they are declared."""

from pyspark.sql import functions as F

from tracequarry.functions import text as tx
from tracequarry.operators import corpus

CODE = '''package a.b;
import c.D;
import static e.F.*;
/* class Ghost { void no() {} } */
@Table(name = "t{")
public class Order<T extends D> implements G {
    private static final String OPEN = "} {";
    @Column(name = "x") protected Map<String, List<T>> lines = new HashMap<>();
    int a, b = 2;
    char brace = '{';
    Order(int a) { this.a = a; }
    public <X> List<X> find(String s, int n) throws IOException, d.E {
        if (s.equals("}")) { return helper.load(s); } // }
        for (int i = 0; i < n; i++) { new Inner(i).go(); }
        return null;
    }
    abstract void later(int x);
    static class Inner { long id; void go() { setAge(getAge()); } }
}
'''


def test_declarations(spark):
    source = corpus.Source(CODE)
    assert source.package() == "a.b" and source.imports() == ["c.D", "e.F.*"]
    assert [n for n, _, _ in source.classes()] == ["Order", "Inner"]
    assert [(n, line) for n, line, _ in source.methods()] == [("find", 12), ("go", 18)]
    assert source.methods()[0][2].rstrip().endswith("return null;")
    assert {n for n, _ in source.fields()} >= {"OPEN", "lines", "a", "brace", "id"} and "later" not in {n for n, _ in source.fields()}
    assert set(corpus.Source(source.methods()[0][2]).calls()) == {("s", "equals"), ("helper", "load"), (None, "go")}
    odd = spark.createDataFrame([("a", None), ("b", "class X { void m() { {"), ("c", "}}}")], "path string, content string")
    assert [(r["path"], r["method"]) for r in corpus.methods(odd).collect()] == [("b", "m")]
    assert corpus.files(odd).count() == 3


def test_graph_and_test_methods(spark):
    files = spark.createDataFrame([("src/main/Order.java", CODE), ("src/test/OrderTest.java", "package a.b; class OrderTest { @Test public void keeps() { assertEquals(o.getAge(), 3); o.find(\"x\", 1); } public void none() { } }")], "path string, content string")
    (keeps, none) = corpus.test_methods(files).orderBy("test_method").collect()
    assert (keeps["test_class"], keeps["calls"], keeps["attributes"], keeps["assertion_count"]) == ("OrderTest", ["assertEquals", "find", "getAge"], ["age"], 1)
    assert (none["calls"], none["assertion_count"]) == ([], 0)
    nodes, edges = corpus.code_graph(files, "p")
    assert {(r["label"], r["name"]) for r in nodes.collect()} >= {("Project", "p"), ("Class", "a.b.Order"), ("Method", "find"), ("Attribute", "age")}
    assert ("method:a.b.OrderTest#keeps", "attribute:age", "USES_ATTRIBUTE") in {tuple(r) for r in edges.collect()}


def test_commit_tickets(spark):
    commits = spark.createDataFrame([("s", "ABC-1 and ABC-12, XABC-1x no-ABC-3, ABC-1"), ("t", None)], "sha string, message string")
    assert {tuple(r) for r in corpus.commit_tickets(commits).collect()} == {("s", "ABC-1"), ("s", "ABC-12")}


def test_paragraph_chunks_hold_the_whole_text_in_order(spark):
    texts = ["", None, "short", "".join(chr(200 + i) for i in range(95)), "".join(f"one{i} two\n\nfour{i} five\nsix " for i in range(9)), " ".join(f"w{i}" for i in range(60)) + "\n\n" + "".join(chr(500 + i) for i in range(70))]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string").select("k", "text", F.explode(tx.paragraph_chunks(F.col("text"), 40, 12)).alias("c"))
    for k, text in enumerate(texts):
        chunks = [r["c"]["chunk"] for r in df.where(F.col("k") == k).orderBy("c.number").collect()]
        assert all(0 < len(c) <= 40 for c in chunks) and bool(chunks) == bool((text or "").strip())
        at = 0
        for c in chunks:  # each chunk is a run of the text that begins at or before the end of the one before, blanks aside
            begin = (text or "").find(c, max(0, at - 13))
            assert begin >= 0 and not (text or "")[at:begin].strip()
            at = begin + len(c)
        assert not (text or "")[at:].strip()


def test_sections_paths_and_priorities(spark):
    one = lambda column, value: spark.createDataFrame([(value,)], "t string").select(column(F.col("t"))).first()[0]
    assert one(lambda t: tx.without_section(t, "Out of scope"), "1. Do\nx\n2. Out of scope:\nnot this\n3. More\ny") == "1. Do\nx\n3. More\ny"
    assert one(tx.is_test_path, "src\\test\\A.java") and one(tx.is_test_path, "a/OrderTest.java") and not one(tx.is_test_path, "src/main/Latest/A.java")
    assert one(tx.utc_timestamp, "2024-01-02T03:04:05+02:00") == one(tx.utc_timestamp, "2024-01-02T01:04:05") and one(tx.utc_timestamp, "soon") is None
    assert [one(lambda t: tx.change_priority(t, F.lit(b)), n) for n, b in (("getAge", "return a;"), ("check", "if (a) throw x;"), ("go", "run();"))] == ["ACCESSOR_ONLY", "VALIDATION", "RELATED"]
