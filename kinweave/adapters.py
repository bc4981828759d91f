"""The benchmark tables seen as a code base with a knowledge log.

Parts are symbols: five consecutive keys form one file with a class and four
methods. Consecutive order lines are calls, events are knowledge records,
customers are files on disk, orders are file manifests, documents are source
text. Every adapter reads whole tables.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinweave.graph import CodeGraph
from kinweave.operators.records import apply_index, index_records
from kinweave.operators.resolve import contains_edges
from kinweave.session import placed, shared_dir
from kinweave.sources.tables import load_graph, save_graph

lit, col = F.lit, F.col


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _text(*parts: Column | str) -> Column:
    return F.concat(*[lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def group_path(c: Column, ext: str = ".ts") -> Column:
    return _text("src/m", c % 10, "/d", c % 3, "/f", c, ext)


def class_id(c: Column) -> Column:
    return _text(group_path(c), "::C", c)


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(k, c, j, method)``: part key, its class, its position in the class and its method name."""
    part = table(spark, sf_dir, "part")
    k = col("p_partkey")
    return part.select(
        k.alias("k"),
        F.expr("p_partkey div 5").alias("c"),
        (k % 5).alias("j"),
        _text(F.replace("p_name", lit(" "), lit("_")), "_", k).alias("method"),
        col("p_size").cast("bigint").alias("size"),
    )


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    is_class = col("j") == 0
    fqn = F.when(is_class, _text("C", col("c"))).otherwise(_text("C", col("c"), ".", col("method")))
    start = F.when(is_class, 1).otherwise(10 * col("j") - 8)
    return members(spark, sf_dir).select(
        F.concat(group_path(col("c")), lit("::"), fqn).alias("id"),
        fqn.alias("fqn"),
        F.when(is_class, "class").otherwise("method").alias("symbol_type"),
        group_path(col("c")).alias("file_path"),
        start.cast("bigint").alias("line_start"),
        F.when(is_class, 50).otherwise(start + 8).cast("bigint").alias("line_end"),
        lit("typescript").alias("language"),
        col("size").alias("unresolved_calls"),
        "k",
    )


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = group_path(col("c"))
    return members(spark, sf_dir).select("c").distinct().select(
        path.alias("id"), path.alias("path"), lit(".ts").alias("ext"), lit("source").alias("kind")
    )


def call_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(src_k, dst_k)``: a part calls the part on the next line of the same order."""
    lines = table(spark, sf_dir, "lineitem")
    here = lines.select("l_orderkey", (col("l_linenumber") + 1).alias("n"), col("l_partkey").alias("src_k"))
    following = lines.select("l_orderkey", col("l_linenumber").alias("n"), col("l_partkey").alias("dst_k"))
    return here.join(following, ["l_orderkey", "n"]).filter("src_k <> dst_k").select("src_k", "dst_k").distinct()


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = placed(symbols(spark, sf_dir).select("k", "id"))
    return (
        call_keys(spark, sf_dir)
        .join(ids.select(col("k").alias("src_k"), col("id").alias("src")), "src_k")
        .join(ids.select(col("k").alias("dst_k"), col("id").alias("dst")), "dst_k")
        .select("src", "dst", F.when(col("dst_k") % 5 == 0, "instantiation").otherwise("static_call").alias("call_kind"))
    )


def extends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes form a tree: class c extends class (c - 1) div 3."""
    parent = F.expr("(c - 1) div 3")
    return members(spark, sf_dir).filter("j = 0 AND c > 0").select(
        class_id(col("c")).alias("src"), class_id(parent).alias("dst")
    )


def busiest_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One seed per nation: the part on most order lines of its suppliers, ties to the smaller key."""
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey")
    supplier = table(spark, sf_dir, "supplier").select(col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    top = (
        lines.join(supplier, "l_suppkey").groupBy("s_nationkey", "l_partkey").agg(F.count("*").alias("n"))
        .groupBy("s_nationkey").agg(F.min(F.struct(-col("n"), col("l_partkey").alias("k"))).alias("top"))
        .select(col("top.k").alias("k")).distinct()
    )
    return F.broadcast(top).join(symbols(spark, sf_dir).select("k", "id"), "k").select(col("id").alias("seed"))


def log_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as parsed log records: several kinds, provenances and subjects, with supersede links."""
    n_parts = table(spark, sf_dir, "part").agg(F.count("*").alias("n_parts"))
    targets = placed(symbols(spark, sf_dir).select(col("k").alias("s"), col("id").alias("symbol_id"), col("file_path")))
    e, user = col("event_id"), col("user_id")
    per_user = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = (
        table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type")
        .withColumn("prev_id", F.lag("event_id").over(per_user))
        .withColumn("s", e % n_parts.scalar())
        .join(targets, "s")
    )
    folder = F.regexp_replace("file_path", "/[^/]*$", "")
    case = e % 11
    subject = (
        F.when(case == 0, _text("src/gone/g", e, ".ts::Gone"))
        .when(case == 1, col("file_path"))
        .when(case == 2, F.regexp_replace(folder, "/[^/]*$", ""))
        .when(case == 3, folder)
        .otherwise(col("symbol_id"))
    )
    kind = F.get(F.array(*[lit(k) for k in (
        "gotcha", "constraint", "rejected", "decision", "source", "behavior", "intent", "conflict"
    )]), (e % 8).cast("int"))
    pointer = e % 7
    pv = (
        F.when(pointer == 0, "u").when(pointer == 1, "a").when(pointer == 2, "i")
        .when(pointer == 3, _text("g:", e))
        .when(pointer == 4, _text("t:tests/t", user, ".ts"))
        .when(pointer == 5, _text("n:src/n", user, ".ts:", e % 90 + 1))
        .otherwise(_text("d:docs/d", user, ".md"))
    )
    return rows.select(
        (e + 1).alias("line"),
        _text("e", e).alias("id"),
        kind.alias("kn"),
        F.when(col("event_type") == "purchase", F.array(subject, col("file_path"))).otherwise(F.array(subject)).alias("sb"),
        _text(col("event_type"), " by user ", user).alias("cl"),
        F.when(e % 3 == 0, _text("seen at step ", e % 10)).alias("bc"),
        F.when((kind == "behavior") & (e % 2 == 1), lit("a session")).alias("gv"),
        F.when(kind == "behavior", col("event_type")).alias("wn"),
        F.when(kind == "behavior", lit("it is stored")).alias("tn"),
        F.when(kind == "source", F.when(user % 2 == 0, _text("https://wiki/u", user)).otherwise(_text("docs/d", user, ".md"))).alias("rf"),
        pv.alias("pv"),
        F.date_format("ts", "yyyyMMddHHmmss").alias("ts"),
        F.when((col("event_type") == "error") & col("prev_id").isNotNull(), _text("e", col("prev_id"))).alias("ss"),
    )


def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as files on disk; the market segment decides what kind of file."""
    c = col("c_custkey")
    segment = col("c_mktsegment")
    path = (
        F.when(segment.isin("BUILDING", "MACHINERY"), _text("tests/t", c, ".ts"))
        .when(segment == "HOUSEHOLD", _text("src/n", c, ".ts"))
        .otherwise(_text("docs/d", c, ".md"))
    )
    code = files(spark, sf_dir).select("path")
    return table(spark, sf_dir, "customer").select(path.alias("path")).unionByName(code)


_stored: dict[tuple[str, str, str], str] = {}


def _indexed(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], CodeGraph]) -> CodeGraph:
    """Index once, query many times: the graph is written to shared storage on first use."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _stored:
        path = f"{shared_dir(spark)}/kinweave/graph-{name}-{uuid.uuid4().hex}"
        save_graph(build(), path)
        _stored[key] = path
    return load_graph(spark, _stored[key])


def code_graph(spark: SparkSession, sf_dir: str) -> CodeGraph:
    """Symbols, files and code edges."""

    def build() -> CodeGraph:
        nodes = symbols(spark, sf_dir).drop("k")
        return CodeGraph.from_tables(
            spark, symbols=nodes, files=files(spark, sf_dir), calls=calls(spark, sf_dir),
            extends=extends(spark, sf_dir), contains=contains_edges(nodes),
        )

    return _indexed(spark, sf_dir, "code", build)


def knowledge_graph(spark: SparkSession, sf_dir: str) -> CodeGraph:
    """The code graph with the record log indexed into it."""

    def build() -> CodeGraph:
        graph = code_graph(spark, sf_dir)
        return apply_index(graph, index_records(graph, log_records(spark, sf_dir), listing(spark, sf_dir)))

    return _indexed(spark, sf_dir, "knowledge", build)


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as raw log lines with every kind of defect; views are appended twice."""
    e = col("event_id")
    one = _text(
        '{"id":"e', e, '","kn":"', F.when(e % 2 == 0, "gotcha").otherwise("decision"), '","sb":["s', e % 5,
        '"],"cl":"', col("event_type"), ' by user ', col("user_id"), '","pv":"u","ts":"',
        F.date_format("ts", "yyyyMMddHHmmss"), '"}',
    )

    def swap(pattern: str, new: Column | str) -> Column:
        return F.regexp_replace(one, lit(pattern), lit(new) if isinstance(new, str) else new)

    defect = e % 19
    value = (
        F.when(defect == 0, F.substring(one, 1, 20))
        .when(defect == 1, swap('"kn":"[a-z]+"', '"kn":"note"'))
        .when(defect == 2, swap('"cl":"[^"]*"', '"cl":"   "'))
        .when(defect == 3, swap('"ts":"[0-9]*"', '"ts":"20260231000000"'))
        .when(defect == 4, swap('"sb":\\[[^\\]]*\\]', '"sb":"x"'))
        .when(defect == 5, swap('"pv":"u"', '"pv":"z:1"'))
        .when(defect == 6, swap('"id":"e', '"id":"E'))
        .when(defect == 7, swap('"kn":"[a-z]+",', ""))
        .when(defect == 8, swap('"cl":"[^"]*"', '"cl":7'))
        .when(defect == 9, F.concat(lit("["), one, lit("]")))
        .when(defect == 10, lit("   "))
        .when(defect == 11, swap('"id":"e[0-9]+"', _text('"id":"e', e + 3, '"')))
        .when(defect == 12, swap('"pv":"u"', '"pv":"u","rf":"docs/x.md"'))
        .when(defect == 13, swap('"kn":"[a-z]+"', '"kn":"behavior","wn":"run"'))
        .otherwise(one)
    )
    events = table(spark, sf_dir, "events")
    base = events.select((e + 1).alias("line"), value.alias("value"), "event_type")
    repeats = base.filter("event_type = 'view'").withColumn("line", col("line") + 1_000_000_000)
    return base.unionByName(repeats).select("line", "value")


def manifests(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two states of a tree: open orders are new files, failed ones are gone, urgent ones were touched."""
    orders = table(spark, sf_dir, "orders")
    path = _text("src/o", col("o_orderkey"), ".ts").alias("path")
    stamp = F.unix_millis(col("o_orderdate").cast("timestamp"))
    touched = F.when(col("o_orderpriority") == "1-URGENT", 1).otherwise(0)
    previous = orders.filter("o_orderstatus <> 'O'").select(path, stamp.alias("mtime"))
    current = orders.filter("o_orderstatus <> 'F'").select(path, (stamp + touched).alias("mtime"))
    return previous, current


def staged_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A name-status dump over all code files: the class number decides deleted, renamed, modified or added."""
    c = col("c")
    path = group_path(c)
    line = (
        F.when(c % 4 == 0, _text("D\t", path))
        .when(c % 4 == 1, _text("R100\t", path, "\t", path, ".moved"))
        .when(c % 4 == 2, _text("M\t", path))
        .otherwise(_text("A\t", path))
    )
    return members(spark, sf_dir).select("c").distinct().select(line.alias("value"))


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, i, line)``: every line of every document, 0-based."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))


def _rewritten(spark: SparkSession, sf_dir: str, line: Column, ext: str) -> DataFrame:
    """Documents as source files: each line replaced by ``line``, an expression over ``x`` and ``i``."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(
        _text("docs/p", col("doc_id"), ext).alias("file_path"),
        F.array_join(F.transform(F.split("text", "\n"), lambda x, i: line(x, i)), "\n").alias("text"),
    )


def commented_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document lines as comments with and without a marker."""
    shapes = ("// HACK: {}", "  # fixme - {} ", "/* WARNING: {} */", " * Danger {}", "x = 1; {}", "// TODO: {}", "// a HACK {}")

    def line(x: Column, i: Column) -> Column:
        chain = None
        for n, shape in enumerate(shapes):
            before, after = shape.split("{}")
            text = F.concat(lit(before), x, lit(after))
            chain = F.when(i % len(shapes) == n, text) if chain is None else chain.when(i % len(shapes) == n, text)
        return chain

    return _rewritten(spark, sf_dir, line, ".ts")


def decision_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as decision records: a numbered title from the source, the whole text as decision."""
    docs = table(spark, sf_dir, "documents")
    number = F.when(col("doc_id") % 3 == 0, _text("ADR-", col("doc_id"), ": ")).when(
        col("doc_id") % 3 == 1, _text("000", col("doc_id"), ". ")
    ).otherwise(lit(""))
    body = F.replace("text", lit("\r"), lit(""))
    return docs.select(
        _text("docs/adr/", col("doc_id"), ".md").alias("file_path"),
        F.concat(
            lit("intro\n# "), number, lit("Use "), col("source"), lit(" for "), col("lang"), lit(" texts\n\nStatus\n\n## Decision\n\n"),
            F.regexp_replace(body, "\n", "  \n\n"), lit("\n## Later\n"),
        ).alias("text"),
    )


def revert_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as commits, every third a revert of a commit named after the document's first line; the other lines are the message."""
    docs = table(spark, sf_dir, "documents")
    text = F.replace("text", lit("\x1f"), lit(" "))
    first = F.substring_index(text, "\n", 1)
    subject = F.when(col("doc_id") % 3 == 0, F.concat(lit('Revert "'), first, lit('"'))).otherwise(first)
    return docs.select(
        F.concat(lit("\n"), F.sha1(col("doc_id").cast("string")), lit("\x1f"), subject, lit("\x1f"), F.substring(text, F.length(first) + 2, F.length(text))).alias("value")
    )


def ddl_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document lines as SQL scripts: definitions of each kind between ordinary lines."""
    shapes = (
        "CREATE TABLE IF NOT EXISTS app.t{} ( -- ", "create or replace view `v{}` as ", "-- CREATE TABLE ghost{} ",
        "CREATE FUNCTION f{}() ", "  CREATE OR REPLACE PROCEDURE p{}() ", "CREATE TRIGGER [g{}] ", "", "DROP TABLE t{}; ",
    )

    def line(x: Column, i: Column) -> Column:
        chain = None
        for n, shape in enumerate(shapes):
            before, _, after = shape.partition("{}")
            text = F.concat(lit(before), i.cast("string") if after else lit(""), lit(after), x)
            chain = F.when(i % len(shapes) == n, text) if chain is None else chain.when(i % len(shapes) == n, text)
        return chain

    return _rewritten(spark, sf_dir, line, ".sql")


def tagged_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document lines as TSX: each is the text of an element, among signs that would open strings or braces in code."""

    def line(x: Column, i: Column) -> Column:
        n = i.cast("string")
        return F.concat(
            lit("class C"), n, lit(" {\n  m() { return <p id=\"it's {\" on={() => this.n({ a: "), n, lit(" })}>don't ` "),
            F.regexp_replace(x, r"[<{\r]", " "), lit(" {this.n(<b>'&`{`}`}</b>)} \" <br/></p>; }\n  n() { T"), n, lit(".u() }\n}"),
        )

    return _rewritten(spark, sf_dir, line, ".tsx")


# Source text per class: header lines, then one block per method part, then a
# footer. ``{c}`` is the class, ``{p}`` its parent, ``{n}`` the next class,
# ``{m}`` the method. Every block has the same number of lines.
TEMPLATES = {
    ".ts": (
        "// group {c}\nimport { x } from './x';\nexport class C{c} extends C{p} implements Root{c} {\n"
        "  private dep: C{n};\n  constructor(private readonly other: C{p}) {}\n",
        "  {m}(): void {\n    this.shared();\n    this.dep.shared();\n    super.shared();\n    C{n}.make('}');\n"
        "    const v = new C{n}();\n    this.other.shared(`{ ${v}`); // super.ghost();\n    this.own{p}();\n  }\n",
        "}\nexport class Root{c} {\n  shared(): void {}\n  own{c}() { return /[{]/; }\n}\n",
    ),
    ".php": (
        "<?php\nnamespace App;\nclass C{c} extends C{p}\n{\n    use Root{c};\n    private C{n} $dep;\n"
        "    public function __construct(private ?C{p} $other) {}\n",
        "    public function {m}(): void {\n        $this->shared();\n        $this->dep->shared();\n        parent::shared();\n"
        "        C{n}::make('}');\n        $v = new \\App\\C{n}();\n        $this->other->shared(\"{\"); # parent::ghost();\n"
        "        $this->own{p}();\n    }\n",
        "}\ntrait Root{c} {\n    public function shared(): void {}\n    public function own{c}() { return '{'; }\n}\n",
    ),
    ".py": (
        "# group {c}\nimport os\nclass C{c}(C{p}):\n    LIMIT = {c}\n    def __init__(self):\n        pass\n",
        "    @property\n    def {m}(self):\n        self.shared()\n        C{n}.make('def x(): pass')\n        v = C{n}()\n"
        "        helper(v)\n        return v.a.b()\n",
        "def helper(x):\n    return x\n",
    ),
}


def source_files(spark: SparkSession, sf_dir: str, ext: str) -> DataFrame:
    """``(file_path, text)``: one generated source file per class (at most four method parts)."""
    header, block, footer = TEMPLATES[ext]

    def fill(template: str, method: Column | None = None) -> Column:
        c = col("c")
        values = {"{c}": c, "{p}": F.expr("(c - 1) div 3"), "{n}": c + 1}
        out = lit(template)
        for name, value in values.items():
            out = F.replace(out, lit(name), value.cast("string"))
        return out if method is None else F.replace(out, lit("{m}"), method)

    # Names are grouped, not the texts made of them: those are filled in behind the shuffle.
    per_class = members(spark, sf_dir).groupBy("c").agg(
        F.sort_array(F.collect_list(F.when(col("j") > 0, F.struct("k", "method")))).alias("methods")
    )
    text = F.concat(
        fill(header), F.array_join(F.transform("methods", lambda m: fill(block, m["method"])), ""), fill(footer)
    )
    return per_class.select(group_path(col("c"), ext).alias("file_path"), text.alias("text"))
