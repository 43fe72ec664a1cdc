"""Symbols of a source corpus (path, content) as tables, and changes between two snapshots.

One Arrow job reads each file once: comments and the insides of literals are blanked, the rest is cut into names and signs, and
declarations are read off these with the depth of braces and parentheses. Everything after it is DataFrame work.

Nulls: a null content is an empty file. Unbalanced braces end with the file. Repeated paths are read each.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracequarry.store import with_few

#: What is not code: comments, text blocks, strings and characters.
_BLANK = re.compile(r"/\*.*?(?:\*/|\Z)|//[^\n]*|\"{3}(?:\\.|[^\\])*?\"{3}|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'", re.DOTALL)
_TOKEN = re.compile(r"([^\W\d][\w$]*|\d[\w.]*|\S)")
#: The same for code of ASCII alone, in sets that are looked up at once.
_ASCII = re.compile(r"([A-Za-z_][A-Za-z0-9_$]*|[0-9][A-Za-z0-9_.]*|\S)")
_BRACKETS = frozenset("{}()")
_INSIDE = re.compile(r"[^\n]")
#: Words of the language that are no names of methods, types or receivers of calls.
_STATEMENTS = frozenset("if for while switch catch synchronized return new else throw case assert do try finally instanceof super this".split())
_KINDS = frozenset("class interface enum record".split())
_MODIFIERS = frozenset("public protected private static final abstract native transient volatile strictfp default sealed".split())


class Source:
    """A file as tokens: text, place, depth of braces before each, and the token that closes each bracket."""

    def __init__(self, content: str) -> None:
        self.content = content
        code = _BLANK.sub(lambda m: _INSIDE.sub(" ", m[0]) if "\n" in m[0] else " " * len(m[0]), content)
        cut = (_ASCII if code.isascii() else _TOKEN).split(code)  # what stands between tokens, and the tokens, by turns
        self.text = text = cut[1::2]
        self.at = list(accumulate(map(len, cut)))[0:-1:2]
        marks = [i for i, t in enumerate(text) if t in _BRACKETS]
        #: Tokens that are opening parentheses, in order.
        self.opened = [i for i in marks if text[i] == "("]
        self.depth: list[int] = []
        self.closes: dict[int, int] = {}
        braces: list[int] = []
        brackets: list[int] = []
        depth = 0
        for i in marks:
            t = text[i]
            if t == "(":
                brackets.append(i)
            elif t == ")":
                if brackets:
                    self.closes[brackets.pop()] = i
            else:
                self.depth += [depth] * (i + 1 - len(self.depth))
                if t == "{":
                    depth += 1
                    braces.append(i)
                else:
                    depth -= 1
                    if braces:
                        self.closes[braces.pop()] = i
        self.depth += [depth] * (len(text) - len(self.depth))
        self._names = [t[0].isalpha() or t[0] in "_$" for t in text]
        self._classes: list[tuple[str, int, int]] | None = None

    def is_name(self, i: int) -> bool:
        return 0 <= i < len(self._names) and self._names[i]

    def line(self, i: int) -> int:
        return self.content.count("\n", 0, self.at[i]) + 1

    def dotted(self, i: int) -> tuple[str, int]:
        """The dotted name that begins at a token, and the token after it."""
        parts = []
        while i < len(self.text) and (self.is_name(i) or self.text[i] in (".", "*")):
            parts.append(self.text[i])
            i += 1
        return "".join(parts), i

    def package(self) -> str | None:
        return self.dotted(self.text.index("package") + 1)[0] if "package" in self.text else None

    def imports(self) -> list[str]:
        outer = [i for i, t in enumerate(self.text) if t == "import" and self.depth[i] == 0] if "import" in self.text else []
        return [self.dotted(i + 2 if self.text[i + 1 : i + 2] == ["static"] else i + 1)[0] for i in outer]

    def classes(self) -> list[tuple[str, int, int]]:
        """(name, token of its opening brace, line)"""
        if self._classes is not None:
            return self._classes
        out = self._classes = []
        for i, t in enumerate(self.text):
            if t in _KINDS and self.is_name(i + 1) and (i == 0 or self.text[i - 1] != "."):
                brace = next((k for k in range(i + 2, len(self.text)) if self.text[k] in ("{", ";")), None)
                if brace is not None and self.text[brace] == "{":
                    out.append((self.text[i + 1], brace, self.line(i + 1)))
        return out

    def methods(self) -> list[tuple[str, int, str]]:
        """(name, line, body): a name with parentheses and a block after them, where something that can be a type or modifier stands before it."""
        out = []
        for i in (k - 1 for k in self.opened):
            if i < 1 or not self._names[i] or self.text[i] in _STATEMENTS:
                continue
            before = self.text[i - 1]
            if not (before in (">", "]") or (self.is_name(i - 1) and before not in _STATEMENTS)):
                continue
            k = self.closes.get(i + 1)
            if k is None:
                continue
            k += 1
            if self.text[k : k + 1] == ["throws"]:
                while k < len(self.text) and self.text[k] not in ("{", ";"):
                    k += 1
            if self.text[k : k + 1] == ["{"]:
                end = self.at[self.closes[k]] if k in self.closes else len(self.content)
                out.append((self.text[i], self.line(i), self.content[self.at[k] + 1 : end]))
        return out

    def fields(self) -> list[tuple[str, str]]:
        """(name, type) of declarations directly in a class body: words, then a name, then = , or ;"""
        out = []
        for _, brace, _ in self.classes():
            inside, end = self.depth[brace] + 1, self.closes.get(brace, len(self.text))
            begin, k = brace + 1, brace + 1
            while k < end:
                t = self.text[k]
                if t == "@":  # an annotation with its arguments belongs to no type
                    k = self.closes.get(k + 2, k + 1) + 1 if self.text[k + 2 : k + 3] == ["("] else k + 2
                    begin = k if begin >= k - 2 or all(x in _MODIFIERS for x in self.text[begin:k]) else begin
                    continue
                if t in ("(", "{") and k in self.closes:
                    begin = k = self.closes[k] + 1
                    if t == "(":  # a method without a body, or an initialiser
                        while k < end and self.text[k] not in (";", "{"):
                            k += 1
                        begin = k + 1 if self.text[k : k + 1] == [";"] else k
                    continue
                if t in ("=", ";", ",") and self.depth[k] == inside:
                    words = [x for x in self.text[begin:k] if x not in _MODIFIERS]
                    if len(words) >= 2 and self.is_name(k - 1) and words[0] not in _KINDS:
                        out.append((words[-1], "".join(words[:-1])))
                    if t == "=":
                        while k < end and not (self.text[k] == ";" and self.depth[k] == inside):
                            k += 1
                        begin = k + 1
                    elif t == ";":
                        begin = k + 1
                k += 1
        return list(dict.fromkeys(out))

    def calls(self) -> list[tuple[str | None, str]]:
        """(receiver, name) of each call; what follows `new` is no call."""
        out = []
        for i in (k - 1 for k in self.opened):
            if self.is_name(i) and self.text[i] not in _STATEMENTS and self.text[max(0, i - 1) : i] != ["new"]:
                receiver = self.text[i - 2] if i >= 2 and self.text[i - 1] == "." and self.is_name(i - 2) and self.text[i - 2] != "super" else None
                out.append((receiver, self.text[i]))
        return out


_SYMBOLS = "package string, imports array<string>, classes array<struct<name:string,line:int>>, fields array<struct<name:string,type:string>>, methods array<struct<name:string,line:int,body:string>>"


#: The columns of symbols: how a file is read for each, and the kinds of what is found, in a list but for the package.
_READ = {
    "package": (Source.package, {}), "imports": (Source.imports, {"": pa.string()}), "classes": (lambda s: [(n, k) for n, _, k in s.classes()], {"name": pa.string(), "line": pa.int32()}),
    "fields": (Source.fields, {"name": pa.string(), "type": pa.string()}), "methods": (Source.methods, {"name": pa.string(), "line": pa.int32(), "body": pa.string()}),
}


def _column(found: list, kinds: dict) -> pa.Array:
    """Found rows as one Arrow column, built flat."""
    if not kinds:
        return pa.array(found, pa.string())
    offsets = pa.array([0, *accumulate(map(len, found))], pa.int32())
    flat = [x for f in found for x in f]
    if "" in kinds:
        return pa.ListArray.from_arrays(offsets, pa.array(flat, kinds[""]))
    told = zip(*flat, strict=True) if flat else [[] for _ in kinds]
    return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(told, kinds.values(), strict=True)], list(kinds)))


def symbols(corpus: DataFrame, *wanted: str) -> DataFrame:
    """path and what each file declares: package, imports, classes, fields and methods, or those of them that are wanted, which alone are read then."""
    shapes = dict(x.split(" ", 1) for x in _SYMBOLS.split(", "))
    names = [n for n in _READ if not wanted or n in wanted]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            read = [Source(c or "") for c in batch.column("content").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("path"), *[_column([_READ[n][0](s) for s in read], _READ[n][1]) for n in names]], ["path", *names])

    return corpus.select("path", "content").mapInArrow(run, "path string, " + ", ".join(f"{n} {shapes[n]}" for n in names))


def files(corpus: DataFrame) -> DataFrame:
    """path, package, imports, class_name (the first class) and fields of each file."""
    return symbols(corpus, "package", "imports", "classes", "fields").select("path", "package", "imports", F.get("classes", F.lit(0))["name"].alias("class_name"), F.transform("fields", lambda f: f["name"]).alias("fields"))


def methods(corpus: DataFrame) -> DataFrame:
    """path, method, line and body of each method."""
    return symbols(corpus, "methods").select("path", F.explode("methods").alias("m")).select("path", F.col("m.name").alias("method"), "m.line", "m.body")


def calls(bodies: DataFrame) -> DataFrame:
    """path, method, receiver (null: none) and name of each call."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [Source(b or "").calls() for b in batch.column("body").to_pylist()]
            rows = pa.array([i for i, f in enumerate(found) for _ in f], pa.int64())
            flat = [c for f in found for c in f]
            yield pa.RecordBatch.from_arrays([batch.column("path").take(rows), batch.column("method").take(rows), pa.array([r for r, _ in flat], pa.string()), pa.array([n for _, n in flat], pa.string())], ["path", "method", "receiver", "name"])

    return bodies.select("path", "method", "body").mapInArrow(run, "path string, method string, receiver string, name string")


def test_methods(corpus: DataFrame) -> DataFrame:
    """path, test_class, test_method, calls, attributes (behind accessors) and assertion_count of the methods of test files."""
    inside = symbols(corpus.where(F.lower("path").rlike(r"(^|[/\\])tests?[/\\]|tests?\.[a-z]+$")), "classes", "methods")
    each = inside.select("path", F.get("classes", F.lit(0))["name"].alias("test_class"), F.explode("methods").alias("m"))
    bodies = each.select(F.to_json(F.struct("path", "test_class")).alias("path"), F.col("m.name").alias("method"), "m.body")
    accessor = F.regexp_extract("name", "^(?:get|set|is)([A-Z].*)$", 1)
    attribute = F.when(accessor != "", F.concat(F.lower(F.substring(accessor, 1, 1)), F.substring(accessor, 2, 1 << 20)))
    made = calls(bodies).groupBy("path", "method").agg(F.array_sort(F.collect_set("name")).alias("calls"), F.array_sort(F.collect_set(attribute)).alias("attributes"), F.count_if(F.col("name").startswith("assert")).alias("assertion_count"))
    place = F.from_json("path", "path string, test_class string")
    out = bodies.select("path", "method").join(made, ["path", "method"], "left")
    none = F.array().cast("array<string>")
    return out.select(place["path"].alias("path"), place["test_class"].alias("test_class"), F.col("method").alias("test_method"), F.coalesce("calls", none).alias("calls"), F.coalesce("attributes", none).alias("attributes"), F.coalesce("assertion_count", F.lit(0)).alias("assertion_count"))


def code_graph(corpus: DataFrame, project: str) -> tuple[DataFrame, DataFrame]:
    """nodes(id, label, name, project) and edges(source, target, type) of a corpus: the project, its classes, their methods and the
    attributes that methods' accessors use."""
    read = symbols(corpus, "package", "classes", "methods").select(F.concat_ws(".", "package", F.get("classes", F.lit(0))["name"]).alias("owner"), "methods", "path").where("owner <> ''")
    each = read.select("owner", F.explode("methods").alias("m")).select("owner", F.concat("owner", F.lit("#"), "m.name").alias("method"), F.col("m.name").alias("name"), "m.body")
    used = calls(each.select(F.col("owner").alias("path"), "method", "body")).select("method", F.regexp_extract("name", "^(?:get|set|is)([A-Z].*)$", 1).alias("a")).where("a <> ''")
    used = used.select("method", F.concat(F.lower(F.substring("a", 1, 1)), F.substring("a", 2, 1 << 20)).alias("attribute")).distinct()
    root = F.lit(f"project:{project}")
    node = lambda df, key, label, name: df.select(key.alias("id"), F.lit(label).alias("label"), name.alias("name"), F.lit(project).alias("project"))
    nodes = [
        node(read.limit(1), root, "Project", F.lit(project)), node(read, F.concat(F.lit("class:"), "owner"), "Class", F.col("owner")),
        node(each, F.concat(F.lit("method:"), "method"), "Method", F.col("name")), node(used, F.concat(F.lit("attribute:"), "attribute"), "Attribute", F.col("attribute")),
    ]
    edges = [
        read.select(root.alias("source"), F.concat(F.lit("class:"), "owner").alias("target"), F.lit("HAS_CLASS").alias("type")),
        each.select(F.concat(F.lit("class:"), "owner").alias("source"), F.concat(F.lit("method:"), "method").alias("target"), F.lit("HAS_METHOD").alias("type")),
        used.select(F.concat(F.lit("method:"), "method").alias("source"), F.concat(F.lit("attribute:"), "attribute").alias("target"), F.lit("USES_ATTRIBUTE").alias("type")),
    ]
    union = lambda frames: frames[0].unionByName(union(frames[1:])) if len(frames) > 1 else frames[0]
    return union(nodes).distinct(), union(edges).distinct()


def commit_tickets(commits: DataFrame) -> DataFrame:
    """(sha, ticket): ticket keys that a commit's message states, at key boundaries (ABC-1 is not in ABC-12 or XABC-1). commits(sha, message)."""
    keys = F.regexp_extract_all("message", F.lit(r"(?<![A-Za-z0-9-])([A-Z][A-Z0-9]+-[0-9]+)(?![A-Za-z0-9-])"), F.lit(1))
    return commits.select("sha", F.explode(F.array_distinct(keys)).alias("ticket")).distinct()


def data_flow(bodies: DataFrame) -> DataFrame:
    """path, method, attribute and event of each statement with accessors: TRANSFER if it gets and sets, else READ or WRITE. Comments and literals are no statements."""
    code = F.regexp_replace("body", "(?s)" + _BLANK.pattern.replace(r"\Z", r"\z"), " ")
    statement = bodies.select("path", "method", F.explode(F.split(code, "[;{}]")).alias("s"))
    names = lambda verb: F.transform(F.regexp_extract_all("s", F.lit(rf"\.{verb}([A-Z]\w*)\s*\("), F.lit(1)), lambda n: F.concat(F.lower(F.substring(n, 1, 1)), F.substring(n, 2, 1 << 20)))
    both = statement.select("path", "method", names("(?:get|is)").alias("reads"), names("set").alias("writes"))
    moved = (F.size("reads") > 0) & (F.size("writes") > 0)
    event = lambda kind: F.when(moved, "TRANSFER").otherwise(kind)
    rows = F.concat(F.transform("reads", lambda a: F.struct(a.alias("attribute"), event("READ").alias("event"))), F.transform("writes", lambda a: F.struct(a.alias("attribute"), event("WRITE").alias("event"))))
    return both.select("path", "method", F.explode(rows).alias("r")).select("path", "method", "r.attribute", "r.event").distinct()


def semantic_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """path, method, change between two snapshots of method bodies: comments and white space do not count (FORMATTING_ONLY)."""
    bare = F.regexp_replace(F.regexp_replace("body", r"(?s)/\*.*?\*/|//[^\n]*", ""), r"\s+", "")
    digest = lambda df, s: df.groupBy("path", "method").agg(F.sha2(F.concat_ws("\0", F.sort_array(F.collect_list(bare))), 256).alias(f"m{s}"), F.sha2(F.concat_ws("\0", F.sort_array(F.collect_list("body"))), 256).alias(f"t{s}"))
    both = digest(old, 1).join(digest(new, 2), ["path", "method"], "full_outer")
    change = F.when(F.col("m1").isNull(), "ADDED").when(F.col("m2").isNull(), "REMOVED").when(F.col("m1") != F.col("m2"), "MODIFIED").when(F.col("t1") != F.col("t2"), "FORMATTING_ONLY")
    return both.select("path", "method", change.alias("change")).where("change is not null")


def occurrences(corpus: DataFrame, attributes: DataFrame) -> DataFrame:
    """path, line, attribute and usage of each line that names an attribute. Lines meet attributes on their identifiers."""
    lines = corpus.select("path", F.posexplode(F.split("content", "\n")).alias("at", "text")).withColumn("line", F.col("at") + 1)
    plain = lines.select("path", "line", "text", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"\w+"), F.lit(0)))).alias("word"))
    accessor = F.regexp_extract("word", "^(?:get|set|is)([A-Z].*)$", 1)
    named = F.when(accessor != "", F.concat(F.lower(F.substring(accessor, 1, 1)), F.substring(accessor, 2, 1 << 20))).otherwise(F.col("word"))
    hits = with_few(plain.withColumn("attribute", named), attributes.select("attribute").distinct(), "attribute")
    usage = (
        F.when(F.trim("text").rlike(r"^(//|\*|/\*)"), "COMMENT")
        .when(F.col("text").rlike(r"\.set\w+\s*\(\s*null\s*\)"), "NULL_OVERWRITE")
        .when(F.col("word").rlike("^set[A-Z]"), "SETTER")
        .when(F.col("text").rlike(r"\b(if|while|switch)\s*\("), "CONDITION")
        .when(F.col("word").rlike("^(get|is)[A-Z]"), "GETTER")
        .otherwise("REFERENCE")
    )
    return hits.select("path", "line", "attribute", usage.alias("usage")).distinct()
