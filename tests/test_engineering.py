"""What source text exposes and calls, business records on its endpoints, and the main component of homonyms."""

from tracequarry.operators import corpus, engineering, graph
from tracequarry.plans import catalogue

FILE = """
@RestController @RequestMapping("/api/v1/")
class Shop extends Base {
  private final Mapper mapper = new Mapper();
  protected String name;
  @GetMapping("/items/{id}") @Cached(value = "x", ttl = f(2))
  public List<Item> find(@PathVariable("no") String id) { return mapper.load(id).getName(); }
  @PostMapping
  void add(Item i) { i.setName(getOther()); this.find("a.getWrong()"); Util.check(i); lonely(); }
  // @DeleteMapping("/gone") void gone() {}
  @RequestMapping(path = "raw")
  void raw() { super.getBase(); i.isName(); }
  String plain() { return "@GetMapping(\\"/no\\") void no() {}"; }
}
"""


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_mapped_methods():
    assert engineering.mapped(corpus.Source(FILE)) == [("GET", "/api/v1/items/{id}", "find"), ("POST", "/api/v1/", "add"), ("ANY", "/api/v1/raw", "raw")]
    assert engineering.mapped(corpus.Source("@GetMapping(\"x\") interface I { @PutMapping String s(); }")) == [("PUT", "x/", "s")]
    for broken in ("", "@", "@GetMapping", "@GetMapping(", '@GetMapping("a") class', "@GetMapping @", "@GetMapping @A("):
        assert engineering.mapped(corpus.Source(broken)) == []


def test_edges(spark):
    files = spark.createDataFrame(
        [("a", FILE), ("b", "class Mapper { Item load(String s) { return load(s); } void lonely() {} }"), ("c", "class Util { static void check(Item i) {} void plain() {} }"), ("d", None), ("e", "// nothing")], "path string, content string"
    )
    got = set(rows(engineering.engineering_edges(files, "p")))
    m = lambda c, n: f"Method|p|{c}|{n}"
    assert {e for e in got if e[2] == "CALLS"} == {(m("Shop", "find"), m("Mapper", "load"), "CALLS"), (m("Shop", "add"), m("Shop", "find"), "CALLS"), (m("Shop", "add"), m("Util", "check"), "CALLS"), (m("Shop", "add"), m("Mapper", "lonely"), "CALLS")}
    assert {e for e in got if e[2] in ("READS", "WRITES")} == {
        (m("Shop", "add"), "Attribute|p|name", "WRITES"), (m("Shop", "raw"), "Attribute|p|Shop|name", "READS"),
    }
    assert {(e[0], e[1]) for e in got if e[2] == "INVOKES"} == {("Endpoint|p|GET|/api/v1/items/{id}", m("Shop", "find")), ("Endpoint|p|POST|/api/v1", m("Shop", "add")), ("Endpoint|p|ANY|/api/v1/raw", m("Shop", "raw"))}
    assert ("Project|p", "Class|p|Util", "CONTAINS") in got and ("Class|p|Shop", "Attribute|p|Shop|mapper", "DECLARES") in got and ("Project|p", "Endpoint|p|POST|/api/v1", "EXPOSES") in got
    assert engineering.engineering_edges(files.limit(0), "p").count() == 0


def test_business_edges(spark):
    scenarios = spark.createDataFrame([(1, "p", "get", "api//x/", " a-1;A-2,"), (2, None, "GET", "/y", "A-3"), (3, "p", None, None, None)], "scenario_id int, project string, http_method string, endpoint string, tickets string")
    tickets = spark.createDataFrame([("a-1 ", "p"), ("A-9", None), (" ", "p")], "ticket string, project string")
    baselines = spark.createDataFrame([(10, 1, "Sept", 1), (11, 1, None, 2), (12, 2, "x", 1)], "baseline_id int, scenario_id int, name string, version int")
    tests = spark.createDataFrame([(5, 1, 10, "own", ["a-1", ""]), (6, 1, None, "own", None), (7, 2, 10, "own", ["A-1"]), (8, 3, 11, None, None)], "test_id int, scenario_id int, baseline_id int, name string, tickets array<string>")
    assert rows(engineering.business_edges(scenarios, tickets, baselines, tests)) == sorted([
        ("Endpoint|p|GET|/api/x", "Scenario|1", "COVERED_BY"), ("Endpoint|p|ANY|/", "Scenario|3", "COVERED_BY"), ("Scenario|1", "Ticket|A-1", "CHANGED_BY"), ("Scenario|1", "Ticket|A-2", "CHANGED_BY"), ("Ticket|A-1", "Project|p", "BELONGS_TO_PROJECT"),
        ("Scenario|1", "Release|p|Sept", "RELEASED_IN"), ("Scenario|1", "Release|p|Baseline 2", "RELEASED_IN"), ("Scenario|1", "Test|5", "TESTED_IN"), ("Scenario|1", "Test|6", "TESTED_IN"), ("Scenario|3", "Test|8", "TESTED_IN"),
        ("Test|5", "Release|p|Sept", "BELONGS_TO"), ("Test|6", "Release|p|own", "BELONGS_TO"), ("Test|5", "Ticket|A-1", "VERIFIES_CHANGE"),
    ], key=str)


def test_data_flow_leaves_text_out(spark):
    bodies = spark.createDataFrame([("f", "m", 'a.setX(b.getY()); // c.getZ();\n log("d.getW();"); e.isOpen(); /* g.setV(1); */ h.setU(\'.\');')], "path string, method string, body string")
    assert {(r.attribute, r.event) for r in corpus.data_flow(bodies).collect()} == {("x", "TRANSFER"), ("y", "TRANSFER"), ("open", "READ"), ("u", "WRITE")}


def test_main_component_of_homonyms(spark):
    seeds = spark.createDataFrame([("n", "a", "p", 1), ("n", "b", "q", 1), ("n", "c", "p", 9), ("n", "d", "p", 9), ("one", "e", None, 0)], "name string, node string, project string, methods int")
    links = spark.createDataFrame([("a", "x"), ("x", "b"), ("c", "d")], "source string, target string")
    assert {(r["name"], r["node"]) for r in graph.keep_main_component(seeds, links).collect()} == {("n", "a"), ("n", "b"), ("one", "e")}


def test_attribute_impact_walks_callers(spark):
    m = lambda n: f"Method|p|{n}"
    code = [(m("A|r"), "Attribute|p|A|x", "READS"), (m("B|w"), "Attribute|p|x", "WRITES"), (m("B|w"), "Attribute|p|B|alone", "READS"), ("Endpoint|p|GET|/w", m("B|w"), "INVOKES"), (m("A|r"), m("C|not"), "CALLS"), ("Endpoint|p|GET|/not", m("C|not"), "INVOKES")]
    code += [(m("A|c1"), m("A|r"), "CALLS")] + [(m(f"A|c{i + 1}"), m(f"A|c{i}"), "CALLS") for i in range(1, 10)] + [("Endpoint|p|GET|/8", m("A|c8"), "INVOKES"), ("Endpoint|p|GET|/9", m("A|c9"), "INVOKES")]
    code += [("Class|p|A", "Attribute|p|A|x", "DECLARES"), ("Class|p|A", "Attribute|p|A|unused", "DECLARES")]
    business = [("Endpoint|p|GET|/8", "Scenario|1", "COVERED_BY"), ("Endpoint|p|GET|/9", "Scenario|9", "COVERED_BY"), ("Endpoint|p|GET|/not", "Scenario|9", "COVERED_BY"), ("Scenario|1", "Test|1", "TESTED_IN"), ("Test|1", "Release|p|R", "BELONGS_TO")]
    business += [("Scenario|1", "Ticket|A", "CHANGED_BY"), ("Test|1", "Ticket|A", "VERIFIES_CHANGE"), ("Test|1", "Ticket|B", "VERIFIES_CHANGE"), ("Ticket|A", "Project|p", "BELONGS_TO_PROJECT")]
    frame = lambda rows: spark.createDataFrame(rows, "source string, target string, type string")
    # nine calls away is too far, and a called method's endpoint does not come to its caller
    assert rows(engineering.attribute_impact(frame(code), frame(business))) == [("alone", 1, 1, 0, 0, 0, 0), ("x", 10, 2, 1, 2, 1, 1)]
    assert rows(engineering.attribute_impact(frame(code).limit(0), frame(business))) == []


def test_attribute_business_comes_from_callers(spark, tmp_path):
    write = lambda name, rows, shape: spark.createDataFrame(rows, shape).write.parquet(f"{tmp_path}/{name}.parquet")
    write("part", [(2, 1), (7, 2), (30, 3)], "p_partkey long, p_size int")  # getTotal of 2 calls run of 7; 7 calls 22, which is no part
    write("customer", [(2, 0)], "c_custkey long, c_nationkey int")
    write("supplier", [(1, 1, 0.0)], "s_suppkey long, s_nationkey int, s_acctbal double")
    write("orders", [(3, 2, "F")], "o_orderkey long, o_custkey long, o_orderstatus string")
    write("lineitem", [(3, 1, 5, "A", 50.0)], "l_orderkey long, l_linenumber int, l_partkey long, l_returnflag string, l_quantity double")
    got = {r["attribute"]: r["n_endpoints"] for r in catalogue.queries()["attribute_business"](spark, str(tmp_path)).collect()}
    # name1 is read by 2 alone, whose run nobody calls; before, the endpoint of the own class counted for it
    assert got == {"name1": 0, "name2": 1, "name3": 0, "open": 1, "total": 1, "code": 1}
