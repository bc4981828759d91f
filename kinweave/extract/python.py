"""Python declarations and calls, read with the standard library's ``ast`` per file.

A file that does not parse yields one error row and no facts.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from kinweave.extract.facts import Extraction, assemble
from kinweave.extract.tokens import spread

EXTENSIONS = (".py",)
_FACTS = "file_path string, pos bigint, fact string, name string, a string, b string, line bigint, end_line bigint"
_CONSTANT = re.compile(r"(?=.*[A-Z])[A-Z_][A-Z0-9_]*\Z")


def _symbols(body: list[ast.stmt], scope: str) -> Iterator[tuple]:
    """Classes (nested ones too), functions and constants; function bodies stay closed."""
    for node in body:
        if isinstance(node, ast.ClassDef):
            yield "symbol", scope + node.name, "class", "", node
            yield from _symbols(node.body, f"{scope}{node.name}.")
        elif isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            yield "symbol", scope + node.name, "method" if scope else "function", "", node
        elif isinstance(node, (ast.Assign, ast.AnnAssign)):
            target = node.targets[0] if isinstance(node, ast.Assign) else node.target
            if isinstance(target, ast.Name) and _CONSTANT.match(target.id):
                yield "symbol", scope + target.id, "constant", "", node


def _calls(tree: ast.AST) -> Iterator[tuple]:
    for node in ast.walk(tree):
        if not isinstance(node, ast.Call):
            continue
        if isinstance(node.func, ast.Name):
            # By convention a capitalised callee is a class.
            yield "call", node.func.id, "new" if "A" <= node.func.id[0] <= "Z" else "bare", "", node
        elif isinstance(node.func, ast.Attribute) and isinstance(node.func.value, ast.Name):
            owner = node.func.value.id
            own = owner in ("self", "cls")
            yield "call", node.func.attr, "own" if own else "static", "" if own else owner, node


def _facts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = [c.split(" ")[0] for c in _FACTS.split(", ")]
    for batch in batches:
        for path, text in zip(batch["file_path"], batch["text"]):
            try:
                tree = ast.parse(text)
                found = [*_symbols(tree.body, ""), *_calls(tree)]
                rows = [
                    (path, i, fact, name, a, b, node.lineno, node.end_lineno)
                    for i, (fact, name, a, b, node) in enumerate(found)
                ]
            except Exception as error:  # whatever one file does, the others are still read
                rows = [(path, 0, "error", str(error) or type(error).__name__, "", "", 0, 0)]
            yield pd.DataFrame(rows, columns=columns)


def extract(files: DataFrame) -> Extraction:
    """Symbols and call references of ``(file_path, text)``; parse failures in ``errors``."""
    dealt, tasks = spread(files.select("file_path", "text"))
    return assemble(dealt.mapInPandas(_facts, _FACTS).repartition(tasks, "file_path"), "python")
