"""PHP declarations, calls and inheritance from tokens.

The rules are written twice: ``_scan`` has them as windows over token rows,
``facts`` as one pass over a file's tokens, which is what ``extract`` runs.

Known difference from a grammar-based reading: calls inside interpolated strings
are not seen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinweave.extract.facts import Extraction, collect_facts, fact, facts_here, tables, unbalanced
from kinweave.extract.lexer import Token, php_tokens
from kinweave.extract.structure import WORDS, Fact, Rows, read
from kinweave.extract.tokens import carry, is_ident, neighbours, outline, since, tokenize, up_to

EXTENSIONS = (".php",)

_BRACED_NAMESPACE = r"(?im)^\s*(?:<\?php\s+)?namespace(?:\s+[\w\\]+)?\s*\{"

_KINDS = {"class": "class", "interface": "interface", "trait": "class", "enum": "enum", "function": "function"}
_MODIFIERS = ("abstract", "final", "readonly")
_ACCESS = ("public", "private", "protected", "readonly")
_MEMBER_MODIFIERS = (*_ACCESS, "static", "abstract", "final", "var", "const")


def _col(name: str) -> Column:
    return F.col(name)


def _simple(name: str) -> Column:
    """Last segment of a qualified name."""
    return F.substring_index(_col(name), "\\", -1)


def _scan(files: DataFrame) -> DataFrame:
    """What :func:`facts` finds, as windows over token rows."""
    # Inside braced namespaces every declaration sits one brace deeper.
    files = files.select(
        "file_path", "text", F.col("text").rlike(_BRACED_NAMESPACE).cast("int").alias("base")
    )
    rows = neighbours(tokenize(files, php_tokens), back=range(1, 4), ahead=range(1, 6))
    rows = rows.withColumns({"depth": _col("depth") - _col("base"), "word": F.lower("tok")})
    tok, word, p1, n1, n2 = _col("tok"), _col("word"), _col("p1"), _col("n1"), _col("n2")

    # What a token and its neighbours tell.
    attribute = F.startswith(tok, F.lit("#["))
    opener = is_ident("tok") | attribute
    top = (_col("depth") == 0) & (_col("parens") == 0)
    in_braces = (_col("depth") == 1) & (_col("parens") == 0)
    shape = F.when(word == "enum", n2.isin("{", ":", "implements")).otherwise(True)
    named = is_ident("n1") | ((n1 == "&") & is_ident("n2"))
    variable = F.startswith(tok, F.lit("$"))
    type_name = F.when(
        variable & is_ident("p1") & ~F.lower(p1).isin(*_MEMBER_MODIFIERS) & ~_col("p2").isin("|", "&"), _simple("p1")
    )
    scope = is_ident("tok") & (n1 == "::") & is_ident("n2") & (_col("n3") == "(") & ~p1.isin("->", "?->", "::")
    this = (tok == "$this") & (n1 == "->") & is_ident("n2")
    created = (word == "new") & is_ident("n1") & ~F.lower("n1").isin("class", "static")
    here = facts_here(
        unbalanced(-_col("base")),
        fact("call", created, _simple("n1"), F.lit("new")),
        fact("call", scope & (word == "parent"), n2, F.lit("super")),
        fact("call", scope & (word == "self"), n2, F.lit("own")),
        fact("call", scope & ~word.isin("parent", "self", "static"), n2, F.lit("static"), _simple("tok")),
        fact("call", this & (_col("n3") == "("), n2, F.lit("own")),
        fact(
            "call", this & (_col("n3") == "->") & is_ident("n4") & (_col("n5") == "("), _col("n4"), F.lit("prop"), n2
        ),
    )
    rows = rows.select(
        "file_path", "pos", "tok", "word", "line", "end_line", "depth", here.alias("here"), outline().alias("outline"),
        top.alias("top"),
        (top & opener & p1.isin("", ";", "}", "{")).alias("starts"),
        (top & ~word.isin(*_MODIFIERS) & ~attribute).alias("heads"),
        (top & word.isin(*_KINDS) & named & shape).alias("heading"),
        F.when(named & word.isin(*_KINDS), F.when(n1 == "&", n2).otherwise(n1)).alias("name"),
        in_braces.alias("in_braces"),
        (in_braces & opener & p1.isin("{", ";", "}")).alias("opens"),
        (in_braces & ~word.isin(*_MEMBER_MODIFIERS) & ~attribute).alias("leading"),
        (in_braces & (word == "function") & named).alias("function"),
        (in_braces & variable).alias("variable"),
        type_name.alias("type_name"),
        (p1 == ",").alias("listed"),
        (
            (_col("depth") == 1) & (_col("parens") >= 1) & variable & type_name.isNotNull()
            & (F.lower("p2").isin(*_ACCESS) | ((_col("p2") == "?") & F.lower("p3").isin(*_ACCESS)))
        ).alias("promotes"),
        (top & is_ident("tok") & (F.lower(p1) == "extends")).alias("extended"),
        (in_braces & is_ident("tok") & ((F.lower(p1) == "use") | (p1 == ","))).alias("used"),
    ).filter(_col("outline") | (F.size("here") > 0)).drop("outline")

    # Top-level statements.
    rows = rows.withColumns({"stmt": F.sum(_col("starts").cast("int")).over(up_to()), "leads": since(_col("starts"), _col("heads")) == 0})
    # A declaration ends with the brace that closes its body.
    rows = rows.withColumn(
        "stmt_end",
        F.max(F.when(_col("depth") > 0, _col("end_line"))).over(
            Window.partitionBy("file_path", "stmt")
        ),
    ).withColumn("first", carry(_col("starts"), F.struct("stmt", "line")))
    kind = F.coalesce(*[F.when(word == k, v) for k, v in _KINDS.items()])
    rows = rows.withColumn("declares", _col("heading") & _col("leads")).withColumn(
        "decl", carry(_col("declares"), F.struct(_col("stmt").alias("stmt"), word.alias("word"), _col("name").alias("name")))
    )
    within = F.coalesce(_col("decl.stmt") == _col("stmt"), F.lit(False))
    rows = rows.withColumn("in_body", within & _col("decl.word").isin("class", "trait", "interface")).withColumn(
        "in_class", within & _col("decl.word").isin("class", "trait")
    )

    # Members.
    rows = rows.withColumn("begins", _col("in_body") & _col("opens"))
    rows = rows.withColumns(
        {
            "member_id": F.sum(_col("begins").cast("int")).over(up_to()),
            "begin": carry(_col("begins"), F.struct("word", "line")),
            "clause": carry(_col("top") & word.isin("extends", "implements"), F.struct("stmt", "word")),
            "member_leads": since(_col("begins"), _col("in_body") & _col("leading")) == 0,
        }
    )
    # Typed properties: declared in the body or promoted in a parameter list.
    declared = _col("in_class") & _col("variable")
    typed = _col("type_name").isNotNull()
    rows = rows.withColumn(
        "declared_type", carry(declared & typed, F.struct("member_id", _col("type_name").alias("type")))
    )
    body = (_col("depth") >= 1) & ~((_col("depth") == 1) & (tok == "}"))
    rows = rows.withColumn(
        "member_end",
        F.max(F.when(body, _col("end_line"))).over(Window.partitionBy("file_path", "stmt", "member_id")),
    )
    is_method = _col("in_body") & _col("function") & _col("member_leads")
    same_list = _col("listed") & (_col("declared_type.member_id") == _col("member_id"))
    is_prop = (_col("in_class") & _col("promotes")) | (declared & (typed | same_list))
    prop_type = F.coalesce("type_name", "declared_type.type")

    # Parents: the extends clause of a class, used traits of a class or trait.
    base_class = (
        _col("in_class") & _col("extended") & (_col("clause.stmt") == _col("stmt")) & (_col("clause.word") == "extends")
    )
    trait = _col("in_class") & _col("used") & (_col("begin.word") == "use")

    return collect_facts(
        rows,
        fact("symbol", _col("declares"), _col("name"), kind, line=_col("first.line"), end_line=_col("stmt_end")),
        fact(
            "symbol", is_method, F.concat(_col("decl.name"), F.lit("."), _col("name")), F.lit("method"),
            line=_col("begin.line"), end_line=_col("member_end"),
        ),
        fact("prop", is_prop, F.substring(tok, 2, 1 << 30), _col("decl.name"), prop_type),
        fact("parent", base_class | trait, _col("decl.name"), _simple("tok")),
    )


def _tokens(text: str, base: int | None) -> tuple[list[Token], int]:
    return php_tokens(text), base or 0


def _last(name: str) -> str:
    return name.rpartition("\\")[2]


def facts(rows: Rows) -> list[Fact]:
    """The facts of a path's tokens."""
    pos, tok, lines, ends, depths, all_parens, _, outside = rows
    out: list[Fact] = []

    def add(i: int, kind: str, name: str, a: str, b: str = "") -> None:
        out.append((pos[i], kind, name, a, b, lines[i], ends[i]))

    # Calls, and statements of the tokens that shape declarations or are facts.
    statements: list[list[int]] = [[]]
    for i, depth in enumerate(depths):
        t, n1 = tok[i], tok[i + 1]
        depth -= outside[i]
        here = len(out)
        if n1 == "::":
            if tok[i + 3] == "(" and WORDS[t] and WORDS[tok[i + 2]] and tok[i - 1] not in ("->", "?->", "::"):
                word = t.lower()
                if word == "parent":
                    add(i, "call", tok[i + 2], "super")
                elif word == "self":
                    add(i, "call", tok[i + 2], "own")
                elif word != "static":
                    add(i, "call", tok[i + 2], "static", _last(t))
        elif t == "$this":
            if n1 == "->" and WORDS[tok[i + 2]]:
                if tok[i + 3] == "(":
                    add(i, "call", tok[i + 2], "own")
                elif tok[i + 3] == "->" and WORDS[tok[i + 4]] and tok[i + 5] == "(":
                    add(i, "call", tok[i + 4], "prop", tok[i + 2])
        elif len(t) == 3 and WORDS[n1] and t.lower() == "new" and n1.lower() not in ("class", "static"):
            add(i, "call", _last(n1), "new")
        if n1 == "" and depth + (t == "{") - (t == "}") != -outside[i]:
            add(i, "error", "braces are not balanced", "")
        if depth <= 1 or n1 == "" or len(out) > here or (depth == 2 and t == "}"):
            if depth == 0 and all_parens[i] == 0 and tok[i - 1] in ("", ";", "}", "{") and (WORDS[t] or t.startswith("#[")):
                statements.append([])
            statements[-1].append(i)

    decl = begin = clause = first = declared_type = None
    leading_before = member = 0
    for stmt, held in enumerate(statements):
        if not held:
            continue
        if stmt:
            first = lines[held[0]]
        stmt_end = max([ends[i] for i in held if depths[i] > outside[i]], default=None)
        heads_before = 0
        kind = ""  # the word of the declaration in this statement
        member_end, waiting = None, []
        for i in held:
            depth, parens = depths[i] - outside[i], all_parens[i]
            t, n1, p1 = tok[i], tok[i + 1], tok[i - 1]
            if depth == 0 and parens == 0:
                word = t.lower()
                if word in _KINDS and not heads_before and (name := _declared(tok, i)) is not None and (
                    word != "enum" or tok[i + 2] in ("{", ":", "implements")
                ):
                    kind, decl = word, name
                    out.append((pos[i], "symbol", name, _KINDS[word], "", first, stmt_end))
                if word == "extends" or word == "implements":
                    clause = (stmt, word)
                if word not in _MODIFIERS and not t.startswith("#["):
                    heads_before += 1
                if kind in ("class", "trait") and clause == (stmt, "extends") and p1.lower() == "extends" and WORDS[t]:
                    add(i, "parent", decl, _last(t))
            elif depth == 1 and kind in ("class", "trait", "interface"):
                variable = t.startswith("$")
                typed = _named_type(tok, i) if variable else None
                if parens == 0:
                    attribute = t.startswith("#[")
                    if p1 in ("{", ";", "}") and (attribute or WORDS[t]):
                        out += [(*m, member_end) for m in waiting]
                        member_end, waiting = None, []
                        member += 1
                        begin = (t.lower(), lines[i])
                        leading_before = 0
                    word = t.lower()
                    if word == "function" and not leading_before and (name := _declared(tok, i)) is not None:
                        waiting.append((pos[i], "symbol", f"{decl}.{name}", "method", "", None if begin is None else begin[1]))
                    if word not in _MEMBER_MODIFIERS and not attribute:
                        leading_before += 1
                    if kind != "interface":
                        if variable:
                            if typed is not None:
                                declared_type = (member, typed)
                            if typed is not None or (p1 == "," and declared_type is not None and declared_type[0] == member):
                                add(i, "prop", t[1:], decl, declared_type[1])
                        if begin is not None and begin[0] == "use" and (p1 == "," or p1.lower() == "use") and WORDS[t]:
                            add(i, "parent", decl, _last(t))
                elif parens >= 1 and typed is not None and kind != "interface" and (
                    tok[i - 2].lower() in _ACCESS or (tok[i - 2] == "?" and tok[i - 3].lower() in _ACCESS)
                ):
                    add(i, "prop", t[1:], decl, typed)
            if depth > 1 or (depth == 1 and t != "}"):
                member_end = ends[i] if member_end is None else max(member_end, ends[i])
        out += [(*m, member_end) for m in waiting]
    return out


def _declared(tok: list[str], i: int) -> str | None:
    """The name after a word that declares one."""
    name = tok[i + 2] if tok[i + 1] == "&" else tok[i + 1]
    return name if WORDS[name] else None


def _named_type(tok: list[str], i: int) -> str | None:
    """The class in the type before a variable."""
    p1 = tok[i - 1]
    if WORDS[p1] and tok[i - 2] not in ("|", "&") and p1.lower() not in _MEMBER_MODIFIERS:
        return _last(p1)
    return None


def extract(files: DataFrame) -> Extraction:
    """Symbols, call references and inheritance of ``(file_path, text)``."""
    return tables(read(files, F.col("text").rlike(_BRACED_NAMESPACE).cast("int"), _tokens, facts), "php")
