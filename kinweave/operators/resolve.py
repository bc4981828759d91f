"""Link extracted call references and parent names to symbols.

Rules that the evidence leaves open are decided here, in one place:

* a name means the definition in the same file, else the one with the smallest
  id anywhere; names are never guessed from a suffix;
* a method missing on its class is the nearest ancestor's, ties by id;
* several symbols with one id collapse to the one that starts first;
* ``unresolved_calls`` counts references, not distinct targets;
* there is one CALLS edge per caller, callee and kind.

Homonyms are reduced to one definition per name *before* references join them,
so a name that is defined and called everywhere does not multiply.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinweave import schema
from kinweave.functions.paths import file_of, last_segment, parent_fqn
from kinweave.operators.traverse import reach
from kinweave.session import materialize, placed

# Fixed value: the symbol kinds a class name can stand for.
CLASS_LIKE = ("class", "interface", "enum")


def dedup_symbols(symbols: DataFrame) -> DataFrame:
    """One row per id: the first by line, then by extraction order."""
    rest = [c for c in symbols.columns if c not in ("id", "line_start", "ordinal")]
    order = ["line_start"] + (["ordinal"] if "ordinal" in symbols.columns else [])
    first = symbols.groupBy("id").agg(F.min(F.struct(*order, *rest)).alias("s"))
    return first.select("id", *[F.col(f"s.{c}").alias(c) for c in symbols.columns if c != "id"])


def contains_edges(symbols: DataFrame) -> DataFrame:
    """File to top-level symbol, symbol to member; an absent parent falls back to the file."""
    child = symbols.select(
        F.col("id").alias("dst"), "file_path",
        F.concat(F.col("file_path"), F.lit("::"), parent_fqn(F.col("fqn"))).alias("parent_id"),
    )
    parents = placed(symbols.select(F.col("id").alias("found")))
    linked = child.join(parents, F.col("parent_id") == F.col("found"), "left")
    return linked.select(
        F.coalesce("found", "file_path").alias("src"),
        F.when(F.col("found").isNotNull(), "CodeSymbol").otherwise("File").alias("src_label"),
        "dst",
    )


def _by_name(symbols: DataFrame, name: Column) -> tuple[DataFrame, DataFrame]:
    """``(file_path, name, local_id)`` and ``(name, global_id)``, both unique per key."""
    named = symbols.select("file_path", name.alias("name"), "id")
    local = named.groupBy("file_path", "name").agg(F.min("id").alias("local_id"))
    return placed(local), placed(local.groupBy("name").agg(F.min("local_id").alias("global_id")))


def _lookup(refs: DataFrame, symbols: DataFrame, name: Column, ref_name: str, out: str) -> DataFrame:
    """Add ``out``: the id that ``ref_name`` means in ``file_path``, or null."""
    local, anywhere = _by_name(symbols, name)
    return (
        refs.withColumn("name", F.col(ref_name))
        .join(local, ["file_path", "name"], "left")
        .join(anywhere, "name", "left")
        .withColumn(out, F.coalesce("local_id", "global_id"))
        .drop("name", "local_id", "global_id")
    )


def extends_edges(symbols: DataFrame, inheritance: DataFrame) -> DataFrame:
    """Child to parent by simple names; the child is the one in the declaring file."""
    classes = symbols.filter(F.col("symbol_type").isin(*CLASS_LIKE))
    simple = last_segment(F.col("fqn"))
    children = classes.groupBy("file_path", simple.alias("child")).agg(F.min("id").alias("src"))
    pairs = inheritance.select("file_path", "child", "parent").distinct().join(placed(children), ["file_path", "child"])
    linked = _lookup(pairs, classes, simple, "parent", "dst")
    return linked.filter("dst IS NOT NULL").select("src", "dst").distinct()


def resolve_calls(symbols: DataFrame, refs: DataFrame, extends: DataFrame) -> DataFrame:
    """Each distinct ``(caller_id, target_name, kind)`` with ``callee_id`` (or null) and ``n_refs``."""
    refs = (
        refs.groupBy("caller_id", "target_name", "kind").agg(F.count("*").alias("n_refs"))
        .withColumn("file_path", file_of(F.col("caller_id")))
    )
    refs = materialize(refs, "distinct-refs")  # read four times
    is_super = F.startswith(F.col("target_name"), F.lit("parent::"))

    classes = symbols.filter(F.col("symbol_type").isin(*CLASS_LIKE))
    plain = refs.filter(~is_super & (F.col("kind") != "instantiation"))
    created = refs.filter(~is_super & (F.col("kind") == "instantiation"))
    direct = _lookup(plain, symbols, F.col("fqn"), "target_name", "callee_id").unionByName(
        _lookup(created, classes, F.col("fqn"), "target_name", "callee_id")
    )
    direct = materialize(direct, "direct-calls")

    # What is left is looked up on the ancestors of a class: of the named class
    # for ``Class.method``, of the caller's own class for ``parent::method``.
    missed = direct.filter("callee_id IS NULL AND instr(target_name, '.') > 0 AND kind <> 'instantiation'")
    named = _lookup(
        missed.select(
            "caller_id", "target_name", "kind", "file_path",
            parent_fqn(F.col("target_name")).alias("class_fqn"),
            last_segment(F.col("target_name")).alias("method"),
        ),
        classes, F.col("fqn"), "class_fqn", "class_id",
    ).drop("class_fqn")
    owned = refs.filter(is_super).select(
        "caller_id", "target_name", "kind", "file_path",
        F.expr("substring(target_name, 9)").alias("method"),
        F.regexp_replace("caller_id", r"\.[^.:/]*\z", "").alias("class_id"),
    )
    requests = named.unionByName(owned).filter("class_id IS NOT NULL")

    wanted = requests.select("class_id", "method").distinct()
    ancestors = reach(placed(extends), wanted.select(F.col("class_id").alias("seed")), None)
    members = symbols.filter(F.instr("fqn", ".") > 0).select(
        F.concat(F.col("file_path"), F.lit("::"), parent_fqn(F.col("fqn"))).alias("node"),
        last_segment(F.col("fqn")).alias("method"),
        F.col("id").alias("member_id"),
    )
    inherited = (
        wanted.join(placed(ancestors), F.col("class_id") == F.col("seed"))
        .join(placed(members), ["node", "method"])
        .groupBy("class_id", "method")
        .agg(F.min(F.struct("depth", "member_id")).alias("nearest"))
        .select("class_id", "method", F.col("nearest.member_id").alias("inherited_id"))
    )
    via_class = requests.join(placed(inherited), ["class_id", "method"]).select(
        "caller_id", "target_name", "kind", "inherited_id"
    )
    supers = refs.filter(is_super).withColumn("callee_id", F.lit(None).cast("string"))
    return (
        direct.unionByName(supers.select(direct.columns))
        .join(placed(via_class), ["caller_id", "target_name", "kind"], "left")
        .select(
            "caller_id", "target_name", "kind",
            F.coalesce("callee_id", "inherited_id").alias("callee_id"), "n_refs",
        )
    )


def call_edges(resolved: DataFrame) -> DataFrame:
    return (
        resolved.filter("callee_id IS NOT NULL")
        .select(F.col("caller_id").alias("src"), F.col("callee_id").alias("dst"), F.col("kind").alias("call_kind"))
        .distinct()
    )


def count_unresolved(symbols: DataFrame, resolved: DataFrame) -> DataFrame:
    """Symbols with ``unresolved_calls``: references that link to nothing."""
    missing = (
        resolved.filter("callee_id IS NULL").groupBy(F.col("caller_id").alias("id"))
        .agg(F.sum("n_refs").alias("n"))
    )
    counted = symbols.drop("unresolved_calls").join(placed(missing), "id", "left")
    return schema.conform(counted.withColumn("unresolved_calls", F.coalesce("n", F.lit(0))), schema.SYMBOLS)


def _dyadic(first: Column, last: Column) -> Column:
    """``array<struct<level, bin>>``: the fewest aligned blocks of ``2^level`` lines that make up the lines ``first`` to ``last``."""

    def at(level: Column) -> Column:
        size = F.call_function("shiftleft", F.lit(1).cast("bigint"), level)
        low = F.ceil(first / size).cast("bigint")
        high = F.floor((last + 1) / size).cast("bigint")
        left, right = (low < high) & (low % 2 == 1), (low + low % 2 < high) & (high % 2 == 1)
        return F.array(F.when(left, F.struct(level.alias("level"), low.alias("bin"))), F.when(right, F.struct(level.alias("level"), (high - 1).alias("bin"))))

    top = F.floor(F.log2((last - first + 1).cast("double"))).cast("int")
    return F.array_compact(F.flatten(F.transform(F.sequence(F.lit(0), top), at)))


def enclosing_symbol(lines: DataFrame, symbols: DataFrame) -> DataFrame:
    """The narrowest symbol around each ``(file_path, line)``; the earlier one on a tie.

    A symbol becomes the aligned blocks that make up its lines, about two per
    doubling of its length; a line looks up the one block of each size that it
    lies in. The match is an equi-join, and what is moved grows with symbols and
    lines times the logarithm of the longest symbol, not with the lines covered.
    """
    ordered = symbols.filter("line_end >= line_start")
    longest = ordered.agg(F.max(F.col("line_end") - F.col("line_start") + 1)).first()[0] or 0
    spread = ordered.select(
        "file_path", F.explode(_dyadic(F.col("line_start"), F.col("line_end"))).alias("b"),
        F.struct((F.col("line_end") - F.col("line_start")).alias("span"), "ordinal", "id", "fqn").alias("s"),
    )
    blocks = spread.groupBy("file_path", F.col("b.level").alias("level"), F.col("b.bin").alias("bin")).agg(F.min("s").alias("s"))
    asked = lines.select("file_path", "line").distinct().select(
        "file_path", "line", F.explode(F.sequence(F.lit(0), F.lit(max(longest, 1).bit_length() - 1))).alias("level")
    ).withColumn("bin", F.expr("shiftright(line, level)"))
    narrowest = asked.join(placed(blocks), ["file_path", "level", "bin"]).groupBy("file_path", "line").agg(F.min("s").alias("s"))
    return lines.join(placed(narrowest), ["file_path", "line"]).select(
        *lines.columns, F.col("s.id").alias("symbol_id"), F.col("s.fqn").alias("symbol_fqn")
    )


def enclosing_in_place(rows: DataFrame, asks: Column, encloses: Column, symbol: Column) -> DataFrame:
    """``rows`` with ``around``: for those that ``asks``, the narrowest ``symbol`` around their ``line``, the earlier on a tie.

    :func:`enclosing_symbol` for lines and symbols that are rows of one table
    ``(file_path, pos, line, end_line, ...)``, of which those that ``encloses``
    are symbols. Blocks and lines meet in windows by file, level and block, so a
    table that is placed by file is not moved again, whatever the levels. Rows
    that ask in vain are left out.
    """
    first, last = F.col("line"), F.col("end_line")
    extent = F.when(encloses & (last >= first), last - first + 1)
    at_levels = F.transform(
        F.sequence(F.lit(0), F.floor(F.log2(F.col("longest").cast("double"))).cast("int")),
        lambda level: F.struct(level.alias("level"), F.call_function("shiftright", first, level).alias("bin")),
    )
    numbered = rows.withColumns({"row": F.monotonically_increasing_id(), "longest": F.max(extent).over(Window.partitionBy("file_path"))})
    spread = numbered.select("*", F.posexplode_outer(F.when(asks, at_levels).when(extent.isNotNull(), _dyadic(first, last))).alias("place", "at"))
    of_block = F.when(extent.isNotNull(), F.struct(extent.alias("extent"), "pos", symbol.alias("symbol")))
    spread = spread.withColumns({"level": F.col("at.level"), "bin": F.col("at.bin")}).drop("at", "longest")
    spread = spread.withColumn("found", F.min(of_block).over(Window.partitionBy("file_path", "level", "bin")))
    kept = spread.filter(F.when(asks, F.col("file_path").isNotNull() & F.col("found").isNotNull()).otherwise(F.coalesce("place", F.lit(0)) == 0))
    rest = [c for c in rows.columns if c != "file_path"]
    once = kept.groupBy("file_path", "row").agg(F.any_value(F.struct(*rest)).alias("own"), F.min(F.when(asks, F.col("found"))).alias("found"))
    return once.select("file_path", *[F.col(f"own.{c}").alias(c) for c in rest], F.col("found.symbol").alias("around"))
