"""TypeScript declarations, calls and inheritance from tokens.

The rules are written twice: ``_scan`` has them as windows over token rows,
``facts`` as one pass over a file's tokens, which is what ``extract`` runs.

Known differences from a grammar-based reading: statements in bare top-level
blocks are not declarations here, and a decorator above an unexported class is
not part of the class.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinweave.extract.facts import Extraction, collect_facts, fact, facts_here, tables, unbalanced
from kinweave.extract.lexer import UNCLOSED, Token, typescript_tokens
from kinweave.extract.structure import WORDS, Fact, Rows, read
from kinweave.extract.tokens import carry, in_file, is_ident, neighbours, outline, since, tokenize, up_to

EXTENSIONS = (".ts", ".tsx", ".mts", ".cts")
TAGGED = ".tsx"  # sources that may hold tags

_MODIFIERS = ("export", "default", "abstract", "async")
_DECLARE = ("class", "function", "interface", "type", "enum", "const", "let", "var")
_MEMBER_MODIFIERS = (
    "public", "private", "protected", "static", "async", "get", "set", "readonly", "override",
    "abstract", "declare", "accessor",
)
_ACCESS = ("public", "private", "protected", "override")
_PREDEFINED = (
    "string", "number", "boolean", "any", "unknown", "never", "void", "object", "symbol", "bigint",
    "undefined", "null", "this", "typeof", "keyof", "readonly", "unique", "infer", "asserts", "true", "false",
)
# A line that ends or starts with one of these continues the statement.
_CONTINUES_AFTER = (
    "=", "+", "-", "*", "/", "%", "&", "|", "^", "!", "~", "?", ":", ",", ".", "<", "(", "[", "=>", "&&",
    "||", "??", "?.", "...", "@", *_MODIFIERS, *_DECLARE, "extends", "implements", "new", "typeof", "return",
    "import", "from", "as", "declare",
)
_CONTINUES_BEFORE = (
    "as", "satisfies", "in", "of", "instanceof", "extends", "implements", "else", "catch", "finally", "is",
)
_NOT_AN_OBJECT = ("this", "super", "import", "new")


def _col(name: str) -> Column:
    return F.col(name)


def _is_call(at: str, then: str) -> Column:
    generic = F.startswith(_col(at), F.lit("<")) & (F.length(at) > 1)
    return (_col(at) == "(") | ((generic | (_col(at) == "?.")) & (_col(then) == "("))


def _simple_type(first: int) -> Column:
    """The class a type annotation names when token ``n<first>`` starts it, else null."""
    head, after, then, last = (_col(f"n{first + i}") for i in range(4))
    ambiguous = ("|", "&", "[", "=>", "is", ".")
    generic = F.startswith(after, F.lit("<"))
    usable = is_ident(head) & ~head.isin(*_PREDEFINED)
    return (
        F.when(usable & (after == "."), F.when(~last.isin(*ambiguous), then))
        .when(usable & generic, F.when((after == "<") | ~then.isin(*ambiguous), head))
        .when(usable & ~after.isin(*ambiguous), head)
    )


def _scan(files: DataFrame) -> DataFrame:
    """What :func:`facts` finds, as windows over token rows."""
    rows = tokenize(files, typescript_tokens, F.endswith("file_path", F.lit(TAGGED)))
    rows = neighbours(rows, back=range(1, 5), ahead=range(1, 7)).withColumn("line_before", F.lag("line").over(in_file()))
    tok, p1, n1, n2 = _col("tok"), _col("p1"), _col("n1"), _col("n2")

    # What a token and its neighbours tell.
    word = is_ident("tok")
    decorator = (
        (tok == "@") | (p1 == "@") | ((_col("p2") == "@") & tok.isin("(", "."))
        | ((_col("p3") == "@") & (p1 == ".")) | ((_col("p4") == "@") & (tok == "("))
    )
    top = (_col("depth") == 0) & (_col("parens") == 0)
    in_braces = (_col("depth") == 1) & (_col("parens") == 0)
    fresh_line = _col("newline") & ~p1.isin(*_CONTINUES_AFTER) & ~tok.isin(*_CONTINUES_BEFORE)
    starts = top & (word | (tok == "@")) & (
        p1.isin("", ";") | ((p1 == "}") & tok.isin(*_MODIFIERS, *_DECLARE, "@")) | fresh_line
    )
    const_enum = (tok == "const") & (n1 == "enum")
    shape = (
        F.when(tok == "class", ~n1.isin("extends", "implements"))
        .when(tok == "function", F.lit(True))  # if it has a body
        .when(tok == "interface", n2.isin("{", "extends") | F.startswith(n2, F.lit("<")))
        .when(tok == "type", (n2 == "=") | F.startswith(n2, F.lit("<")))
        .when(tok == "enum", n2 == "{")
        .when(tok.isin("const", "let", "var"), ~const_enum)
        .otherwise(False)
    )
    heading = top & tok.isin(*_DECLARE) & is_ident("n1") & shape
    quoted = tok.rlike(r"""\A['"\[].+['"\]]\z""")
    opens = in_braces & (word | quoted | (tok == "@")) & (p1.isin("{", ";", "}", ",") | fresh_line)
    as_name = n1.isin("(", "?", "=", ":", ";", "!") | F.startswith(n1, F.lit("<"))
    modifier = tok.isin(*_MEMBER_MODIFIERS) & ~as_name
    callable_name = (n1 == "(") | F.startswith(n1, F.lit("<")) | (
        (n1 == "?") & ((n2 == "(") | F.startswith(n2, F.lit("<")))
    )
    typed = F.when(n1 == ":", _simple_type(2)).when(n1.isin("?", "!") & (n2 == ":"), _simple_type(3))
    accessible = p1.isin(*_ACCESS) | ((p1 == "readonly") & _col("p2").isin(*_ACCESS))

    chained = p1.isin(".", "?.")
    dot = n1.isin(".", "?.")
    calls_n2 = dot & is_ident("n2") & _is_call("n3", "n4")
    through = dot & is_ident("n2") & _col("n3").isin(".", "?.") & is_ident("n4") & _is_call("n5", "n6")
    written = word & ~tok.isin(*_NOT_AN_OBJECT) & ~chained & (p1 != "new") & calls_n2
    created = (tok == "new") & is_ident("n1") & (n1 != "class") & ~n2.isin(".", "?.", "[")

    def call(when: Column, name: Column, form: str, on: Column | None = None) -> Column:
        return fact("call", when, name, F.lit(form), on)

    here = facts_here(
        unbalanced(),
        fact("error", tok == UNCLOSED, F.lit("a template or a tag does not close"), F.lit("")),
        call(created, n1, "new"),
        call(written, n2, "static", tok),
        call((tok == "this") & ~chained & calls_n2, n2, "own"),
        call((tok == "super") & calls_n2, n2, "super"),
        call((tok == "this") & ~chained & through, _col("n4"), "prop", n2),
    )
    rows = rows.select(
        "file_path", "pos", "tok", "line", "end_line", "depth", here.alias("here"), outline().alias("outline"),
        top.alias("top"),
        starts.alias("starts"),
        (top & ~tok.isin(*_MODIFIERS) & ~const_enum).alias("heads"),
        heading.alias("heading"),
        F.when(heading, n1).alias("name"),
        F.when(heading, F.when(p1.isin("abstract", "async", "const"), _col("line_before")).otherwise(_col("line"))).alias("from_line"),
        (p1 == "abstract").alias("abstract"),
        (top & word & (p1 == ",") & n1.isin("=", ":", ",", ";", "")).alias("listed"),
        in_braces.alias("in_braces"),
        opens.alias("opens"),
        (in_braces & ~modifier & ~decorator & (tok != "*")).alias("leading"),
        (word | quoted).alias("nameable"),
        callable_name.alias("callable"),
        typed.alias("typed"),
        ((_col("depth") == 1) & (_col("parens") == 1) & word & accessible).alias("promotes"),
        (top & word & (p1 == "extends") & ~n1.isin(".", "(")).alias("extended"),
        (top & word & p1.isin("implements", ",", ".") & (n1 != ".")).alias("implemented"),
    ).filter(_col("outline") | (F.size("here") > 0)).drop("outline")

    # Top-level statements.
    rows = rows.withColumns({"stmt": F.sum(_col("starts").cast("int")).over(up_to()), "leads": since(_col("starts"), _col("heads")) == 0})
    in_stmt = Window.partitionBy("file_path", "stmt")
    rows = rows.withColumns(
        {
            "stmt_end": F.max("end_line").over(in_stmt),
            "stmt_last": F.max_by("tok", "pos").over(in_stmt),
        }
    )
    declares = _col("heading") & _col("leads") & ((tok != "function") | (_col("stmt_last") == "}"))
    kind = F.when(tok.isin("const", "let", "var"), "constant").otherwise(tok)
    rows = rows.withColumn("declares", declares).withColumn(
        "decl",
        carry(
            _col("declares"),
            F.struct(_col("stmt").alias("stmt"), kind.alias("kind"), _col("name").alias("name"), "abstract", _col("from_line").alias("line")),
        ),
    )
    within = F.coalesce(_col("decl.stmt") == _col("stmt"), F.lit(False))
    in_body = within & _col("decl.kind").isin("class", "interface")
    in_class = within & (_col("decl.kind") == "class") & ~_col("decl.abstract")
    another = within & (_col("decl.kind") == "constant") & _col("listed")

    # Members of classes and interfaces.
    rows = rows.withColumns(
        {
            "member": in_body & _col("in_braces"), "begins": in_body & _col("opens"), "in_class": in_class, "another": another,
            "significant": in_body & _col("leading"),
        }
    )
    clause = carry(tok.isin("extends", "implements") & _col("top"), F.struct("stmt", "tok"))
    rows = rows.withColumns(
        {
            "member_id": F.sum(_col("begins").cast("int")).over(up_to()),
            "begin": carry(_col("begins"), F.struct("tok", "line")),
            "clause": clause,
            "names": _col("significant") & _col("nameable") & (since(_col("begins"), _col("significant")) == 0),
            "abstract_member": since(_col("begins"), _col("member") & (tok == "abstract")) > 0,
        }
    )
    rows = rows.withColumn("member_name", carry(_col("names"), tok))
    in_member = Window.partitionBy("file_path", "stmt", "member_id")
    body = (_col("depth") >= 1) & ~((_col("depth") == 1) & (tok == "}"))
    rows = rows.withColumn("member_end", F.max(F.when(body, _col("end_line"))).over(in_member))

    is_method = (
        _col("names") & _col("callable") & ~_col("abstract_member")
        & ~((_col("decl.kind") == "interface") & (tok == "new"))
    )
    parameter = _col("promotes") & (_col("member_name") == "constructor")
    is_prop = _col("in_class") & (_col("names") | parameter) & _col("typed").isNotNull()
    is_parent = _col("in_class") & (_col("clause.stmt") == _col("stmt")) & (
        _col("extended") | ((_col("clause.tok") == "implements") & _col("implemented"))
    )

    return collect_facts(
        rows,
        fact("symbol", _col("declares"), _col("name"), kind, line=_col("decl.line"), end_line=_col("stmt_end")),
        fact("symbol", _col("another"), tok, F.lit("constant"), line=_col("decl.line"), end_line=_col("stmt_end")),
        fact(
            "symbol", is_method, F.concat(_col("decl.name"), F.lit("."), tok), F.lit("method"),
            line=F.when(_col("begin.tok") == "@", _col("line")).otherwise(_col("begin.line")),
            end_line=_col("member_end"),
        ),
        fact("prop", is_prop, tok, _col("decl.name"), _col("typed")),
        fact("parent", is_parent, _col("decl.name"), tok),
    )


_QUOTED = re.compile(r"""['"\[][^\n\r\u0085\u2028\u2029]+['"\]]\Z""")
_DOTS = (".", "?.")
_AMBIGUOUS = ("|", "&", "[", "=>", "is", ".")


def _tokens(text: str, tagged: bool | None) -> tuple[list[Token], int]:
    return typescript_tokens(text, bool(tagged)), 0


def _calls_at(at: str, then: str) -> bool:
    return at == "(" or ((at == "?." or (len(at) > 1 and at[0] == "<")) and then == "(")


def _named_type(head: str, after: str, then: str, last: str) -> str | None:
    """The class that a type annotation of these tokens names."""
    if not WORDS[head] or head in _PREDEFINED:
        return None
    if after == ".":
        return None if last in _AMBIGUOUS else then
    if after.startswith("<"):
        return head if after == "<" or then not in _AMBIGUOUS else None
    return None if after in _AMBIGUOUS else head


def facts(rows: Rows) -> list[Fact]:
    """The facts of a path's tokens."""
    pos, tok, lines, ends, depths, all_parens, newline, _ = rows
    out: list[Fact] = []

    def add(i: int, kind: str, name: str, a: str, b: str = "") -> None:
        out.append((pos[i], kind, name, a, b, lines[i], ends[i]))

    # Calls, and statements of the tokens that shape declarations or are facts.
    statements: list[list[int]] = [[]]
    for i, depth in enumerate(depths):
        t, n1 = tok[i], tok[i + 1]
        here = len(out)
        if n1 == "." or n1 == "?.":
            n2, n3, p1 = tok[i + 2], tok[i + 3], tok[i - 1]
            if WORDS[n2]:
                if _calls_at(n3, tok[i + 4]):
                    if t == "super":
                        add(i, "call", n2, "super")
                    elif p1 not in _DOTS:
                        if t == "this":
                            add(i, "call", n2, "own")
                        elif p1 != "new" and WORDS[t] and t not in _NOT_AN_OBJECT:
                            add(i, "call", n2, "static", t)
                elif t == "this" and p1 not in _DOTS and n3 in _DOTS and WORDS[tok[i + 4]] and _calls_at(tok[i + 5], tok[i + 6]):
                    add(i, "call", tok[i + 4], "prop", n2)
        elif t == "new":
            if n1 != "class" and WORDS[n1] and tok[i + 2] not in (".", "?.", "["):
                add(i, "call", n1, "new")
        if t == UNCLOSED:
            add(i, "error", "a template or a tag does not close", "")
        if n1 == "" and depth + (t == "{") - (t == "}") != 0:
            add(i, "error", "braces are not balanced", "")
        if depth <= 1 or n1 == "" or len(out) > here or (depth == 2 and t == "}"):
            if depth == 0 and all_parens[i] == 0 and (t == "@" or WORDS[t]):
                p1 = tok[i - 1]
                if p1 == "" or p1 == ";" or (p1 == "}" and (t == "@" or t in _MODIFIERS or t in _DECLARE)) or _fresh(newline[i], p1, t):
                    statements.append([])
            statements[-1].append(i)

    decl = begin = clause = member_name = None
    leading_before = abstract_before = 0
    for stmt, held in enumerate(statements):
        if not held:
            continue
        stmt_end, stmt_last = max([ends[i] for i in held]), tok[held[-1]]
        heads_before = 0
        kind = ""  # of the declaration in this statement
        member_end, waiting = 0, []
        for i in held:
            depth, parens = depths[i], all_parens[i]
            t, n1, p1 = tok[i], tok[i + 1], tok[i - 1]
            if depth == 0 and parens == 0:
                const_enum = t == "const" and n1 == "enum"
                if t in _DECLARE and not heads_before and WORDS[n1] and _heads(t, n1, tok[i + 2]) and (t != "function" or stmt_last == "}"):
                    kind = "constant" if t in ("const", "let", "var") else t
                    from_line = (lines[i - 1] if i else None) if p1 in ("abstract", "async", "const") else lines[i]
                    decl = (n1, p1 == "abstract", from_line)
                    out.append((pos[i], "symbol", n1, kind, "", from_line, stmt_end))
                if t == "extends" or t == "implements":
                    clause = (stmt, t)
                if t not in _MODIFIERS and not const_enum:
                    heads_before += 1
                if kind and WORDS[t]:
                    if kind == "constant" and p1 == "," and n1 in ("=", ":", ",", ";", ""):
                        out.append((pos[i], "symbol", t, "constant", "", decl[2], stmt_end))
                    if kind == "class" and not decl[1] and clause is not None and clause[0] == stmt and (
                        (p1 == "extends" and n1 not in (".", "("))
                        or (clause[1] == "implements" and p1 in ("implements", ",", ".") and n1 != ".")
                    ):
                        add(i, "parent", decl[0], t)
            elif depth == 1 and parens == 0:
                if kind == "class" or kind == "interface":
                    word = WORDS[t]
                    nameable = word or _QUOTED.match(t) is not None
                    if (nameable or t == "@") and (p1 in ("{", ";", "}", ",") or _fresh(newline[i], p1, t)):
                        out += [(*m, member_end) for m in waiting]
                        member_end, waiting = 0, []
                        begin = (t, lines[i])
                        leading_before = abstract_before = 0
                    modifier = t in _MEMBER_MODIFIERS and not (n1 in ("(", "?", "=", ":", ";", "!") or n1.startswith("<"))
                    if not modifier and t != "*" and not _decorates(t, p1, tok[i - 2], tok[i - 3], tok[i - 4]):
                        if nameable and not leading_before:
                            member_name = t
                            n2 = tok[i + 2]
                            callable_ = n1 == "(" or n1.startswith("<") or (n1 == "?" and (n2 == "(" or n2.startswith("<")))
                            if callable_ and not abstract_before and not (kind == "interface" and t == "new"):
                                line = None if begin is None else lines[i] if begin[0] == "@" else begin[1]
                                waiting.append((pos[i], "symbol", f"{decl[0]}.{t}", "method", "", line))
                            if kind == "class" and not decl[1] and (typed := _typed(tok, i)) is not None:
                                add(i, "prop", t, decl[0], typed)
                        leading_before += 1
                    if t == "abstract":
                        abstract_before += 1
            elif depth == 1 and parens == 1 and kind == "class" and not decl[1] and member_name == "constructor":
                if (p1 in _ACCESS or (p1 == "readonly" and tok[i - 2] in _ACCESS)) and WORDS[t] and (typed := _typed(tok, i)) is not None:
                    add(i, "prop", t, decl[0], typed)
            if depth > 1 or (depth == 1 and t != "}"):
                member_end = max(member_end, ends[i])
        out += [(*m, member_end) for m in waiting]
    return out


def _fresh(newline: bool, p1: str, t: str) -> bool:
    return newline and p1 not in _CONTINUES_AFTER and t not in _CONTINUES_BEFORE


def _heads(t: str, n1: str, n2: str) -> bool:
    """Whether ``t`` and what follows it is the shape of a declaration."""
    if t == "class":
        return n1 not in ("extends", "implements")
    if t == "interface":
        return n2 in ("{", "extends") or n2.startswith("<")
    if t == "type":
        return n2 == "=" or n2.startswith("<")
    return n2 == "{" if t == "enum" else not (t == "const" and n1 == "enum")


def _decorates(t: str, p1: str, p2: str, p3: str, p4: str) -> bool:
    return t == "@" or p1 == "@" or (p2 == "@" and t in ("(", ".")) or (p3 == "@" and p1 == ".") or (p4 == "@" and t == "(")


def _typed(tok: list[str], i: int) -> str | None:
    """The class in the type annotation after a name."""
    if tok[i + 1] == ":":
        return _named_type(*tok[i + 2: i + 6])
    if tok[i + 1] in ("?", "!") and tok[i + 2] == ":":
        return _named_type(*tok[i + 3: i + 7])
    return None


def extract(files: DataFrame) -> Extraction:
    """Symbols, call references and inheritance of ``(file_path, text)``."""
    return tables(read(files, F.endswith("file_path", F.lit(TAGGED)), _tokens, facts), "typescript")
