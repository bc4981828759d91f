"""The property graph as a bundle of DataFrames."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from pyspark.sql import DataFrame, SparkSession

from kinweave import schema

class MutatingQueryError(ValueError):
    """A statement other than a read was passed to :meth:`CodeGraph.sql`."""


def is_mutating(statement: str, spark: SparkSession | None = None) -> bool:
    """Whether the parsed plan holds a command other than a listing, or a write, at any place.

    A statement that does not parse changes nothing; running it raises the parser's error.
    """
    session = spark or SparkSession.active()
    try:
        todo = [session._jsparkSession.sessionState().sqlParser().parsePlan(statement)]
    except Exception:  # the parser's error comes up again when the statement is run
        return False
    logical = "org.apache.spark.sql.catalyst.plans.logical."
    writes = [session._jvm.java.lang.Class.forName(logical + name) for name in ("Command", "ParsedStatement", "InsertIntoDir")]
    while todo:
        plan = todo.pop()
        name = plan.getClass().getSimpleName()
        if any(kind.isInstance(plan) for kind in writes) and not name.startswith(("Show", "Describe", "Explain")):
            return True
        children = plan.children()
        todo += [children.apply(i) for i in range(children.size())]
    return False


@dataclass(frozen=True)
class CodeGraph:
    """Node tables (symbols, files, records) and edge tables, one DataFrame each."""

    symbols: DataFrame
    files: DataFrame
    records: DataFrame
    contains: DataFrame
    calls: DataFrame
    extends: DataFrame
    about: DataFrame
    supersedes: DataFrame

    @classmethod
    def from_tables(cls, spark: SparkSession, **tables: DataFrame) -> CodeGraph:
        """Build from the given tables; the ones left out are empty."""
        return cls(
            **{
                name: schema.conform(tables[name], layout) if name in tables else schema.empty(spark, layout)
                for name, layout in schema.TABLES.items()
            }
        )

    def with_tables(self, **tables: DataFrame) -> CodeGraph:
        return replace(self, **{n: schema.conform(df, schema.TABLES[n]) for n, df in tables.items()})

    def tables(self) -> dict[str, DataFrame]:
        return {f.name: getattr(self, f.name) for f in fields(self)}

    @property
    def spark(self) -> SparkSession:
        return self.symbols.sparkSession

    def sql(self, statement: str, **params: object) -> DataFrame:
        """Run a read-only Spark SQL statement over the graph tables.

        The tables are in scope under their attribute names; values come in as
        named parameters (``:name``), so nothing is spliced into the text.
        """
        if is_mutating(statement, self.spark):
            raise MutatingQueryError("only read statements run against the graph")
        # A statement is resolved when it is made, so the session's own views come back at once.
        own = {name: self.spark.table(name) for name in self.tables() if self._has_view(name)}
        try:
            for name, df in self.tables().items():
                df.createOrReplaceTempView(name)
            return self.spark.sql(statement, args=params or None)
        finally:
            for name in self.tables():
                if name in own:
                    own[name].createOrReplaceTempView(name)
                else:
                    self.spark.catalog.dropTempView(name)

    def _has_view(self, name: str) -> bool:
        return any(t.name == name and t.isTemporary for t in self.spark.catalog.listTables(pattern=name))
