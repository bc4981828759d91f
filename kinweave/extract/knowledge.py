"""Knowledge that is already written down: marker comments, reverts, decision documents."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.extract.sql import source_lines
from kinweave.functions.binding import let
from kinweave.functions.text import _CHARACTERS, clip, collapse, strip

# The comment tags that signal a trap, the folders that
# conventionally hold decision records, and the separators of the log dump.
DEFAULT_MARKERS = ("HACK", "FIXME", "XXX", "WORKAROUND", "GOTCHA", "WARNING", "CAREFUL", "DANGER")
DECISION_DIRS = (
    "docs/adr", "docs/adrs", "docs/decisions", "docs/architecture/decisions", "doc/adr", "adr",
)
RECORD_SEPARATOR, FIELD_SEPARATOR = "\x1e", "\x1f"
SHORT_SHA = 9
# The signs that begin a comment or a line of one, and what may stand
# between a marker and its text.
COMMENT_SIGN = r"//+|#+|\*+"
SEPARATORS = _CHARACTERS + ":-"


def merge_markers(extra: list[str] | tuple[str, ...] = ()) -> list[str]:
    return list(dict.fromkeys([*DEFAULT_MARKERS, *[m.upper() for m in extra]]))


def _claim(rest: Column) -> Column:
    """The text of a marker comment without a closing ``*/``; ``rest`` starts behind the marker.

    Separators come first. There has to be some text: failing anything else it is
    a lone ``*/`` or the last of several separators.
    """

    def read(tail: Column) -> Column:
        cut = F.length(rest) - F.length(tail)
        last = F.when(cut > 1, strip(F.substring(rest, cut, F.lit(1)))).otherwise("")
        return let(
            strip(tail),
            lambda text: let(
                strip(F.regexp_replace(text, r"\*/\z", "")), lambda inner: F.when(inner != "", inner).when(text != "", text).otherwise(last)
            ),
        )

    return let(F.ltrim(rest, F.lit(SEPARATORS)), read)


def marker_comment(line: Column, markers: list[str] | tuple[str, ...]) -> Column:
    """``struct<marker, text>`` where the first word of a comment is a marker with a separator behind it, else null.

    The line is cut at its comment signs. Only parts that begin with a marker are
    looked at closer, in their order, with the rest of the line behind them.
    """
    signs = re.compile("//|[#*]")
    begins = lambda part: F.exists(
        F.array(*[F.lit(signs.split(m)[0].lower()) for m in markers]), lambda name: F.startswith(F.lower(F.left(part, F.length(name))), name)
    )

    def marked(inside: Column) -> Column:
        found = None
        for marker in markers:
            after = F.substring(inside, len(marker) + 1, 1)
            held = (F.lower(F.left(inside, F.lit(len(marker)))) == marker.lower()) & (after != "") & F.contains(F.lit(SEPARATORS), after)
            value = F.struct(F.lit(marker.upper()).alias("marker"), F.substring(inside, len(marker) + 1, 1 << 30).alias("rest"))
            found = F.when(held, value) if found is None else found.when(held, value)
        return found

    def of_parts(parts: Column) -> Column:
        candidates = F.array_compact(F.transform(parts, lambda p, i: F.when((i > 0) & begins(F.ltrim(p, F.lit(_CHARACTERS))), i)))
        tails = F.transform(candidates, lambda i: F.ltrim(F.get(F.split(line, COMMENT_SIGN, i + 1), i), F.lit(_CHARACTERS)))
        return F.get(F.array_compact(F.transform(tails, marked)), F.lit(0))

    first = let(F.split(line, COMMENT_SIGN), of_parts)
    return let(first, lambda m: F.when(m.isNotNull(), F.struct(m["marker"].alias("marker"), _claim(m["rest"]).alias("text"))))


def scan_markers(files: DataFrame, markers: list[str] | tuple[str, ...] = DEFAULT_MARKERS) -> DataFrame:
    """``(file_path, line, marker, claim)`` per marker comment of ``(file_path, text)``."""
    lines = source_lines(files)
    if not markers:
        return lines.select("file_path", "line", F.lit("").alias("marker"), F.lit("").alias("claim")).limit(0)
    named = "|".join(re.sub(r"([^A-Za-z0-9_\s])", r"\\\1", m) for m in markers)
    # Exploding one-element arrays keeps the filters behind the computation: a
    # plain filter would be pushed below it and repeat every expression.
    comment = F.explode(
        F.filter(
            F.array(marker_comment(F.col("value"), markers)), lambda m: m.isNotNull() & (m["text"] != "") & ~m["text"].rlike(r"[\n\r\u2028\u2029]")
        )
    )
    return (
        lines.filter(F.col("value").rlike(f"(?is)(?:{COMMENT_SIGN}).*(?:{named})"))
        .select("file_path", "line", comment.alias("m"))
        .select("file_path", "line", "m.marker", clip(F.col("m.text")).alias("claim"))
    )


def scan_reverts(log: DataFrame) -> DataFrame:
    """``(sha, claim)`` per revert commit.

    ``log`` has one commit per row in ``value``: hash, subject and body with the
    field separator between them (a dump read with ``lineSep`` set to the record
    separator, see :func:`kinweave.sources.files.read_git_log`).
    """
    fields = F.split(F.regexp_replace("value", r"\A\n+", ""), FIELD_SEPARATOR)
    subject = strip(F.get(fields, F.lit(1)))
    return log.select(
        F.substring(strip(F.get(fields, F.lit(0))), 1, SHORT_SHA).alias("sha"),
        clip(F.regexp_extract(subject, r'\ARevert\s+"(.+)"\z', 1)).alias("claim"),
    ).filter("sha <> '' AND claim <> ''")


def _without_number(title: Column) -> Column:
    """Drop a leading number, with or without ADR before it, if a separator follows."""
    separators = _CHARACTERS + ".:)-"
    named = F.when(F.lower(F.left(title, F.lit(3))) == "adr", F.substring(title, 4, 1 << 30))
    joined = let(named, lambda n: F.when(F.left(n, F.lit(1)).rlike(r"[-\s]"), F.substring(n, 2, 1 << 30)).otherwise(n))
    start = let(joined, lambda j: F.when(F.left(j, F.lit(1)).rlike("[0-9]"), j).otherwise(title))

    def cut(start: Column, after: Column, text: Column) -> Column:
        numbered = (F.length(after) < F.length(start)) & (F.length(text) < F.length(after))
        return strip(F.when(numbered & (text != ""), text).otherwise(title))

    return let(start, lambda s: let(F.ltrim(s, F.lit("0123456789")), lambda a: let(F.ltrim(a, F.lit(separators)), lambda t: cut(s, a, t))))


def _after(found: Column, lines: Column) -> Column:
    """The lines behind place ``found``, none if it is 0."""
    return F.slice(lines, F.when(found > 0, found + 1).otherwise(F.size(lines) + 1).cast("int"), F.size(lines))


def decision_title(text: Column) -> Column:
    """The first level-one heading without its number; empty when there is none.

    A ``#`` that stands alone is a heading whose text is the next line with any.
    """

    def of(lines: Column, place: Column) -> Column:
        rest = F.slice(lines, place.cast("int"), F.size(lines))
        texts = F.transform(rest, lambda l, i: strip(F.when(i == 0, F.substring(l, 2, 1 << 30)).otherwise(l)))
        return let(F.coalesce(F.get(F.filter(texts, lambda t: t != ""), F.lit(0)), F.lit("")), _without_number)

    def of_lines(lines: Column) -> Column:
        heads = F.transform(lines, lambda l: F.left(F.concat(F.rtrim(l, F.lit(_CHARACTERS)), F.lit(" ")), F.lit(2)).rlike(r"#\s"))
        return let(F.array_position(heads, F.lit(True)), lambda place: F.when(place > 0, of(lines, place)).otherwise(""))

    return let(F.split(text, "\n"), of_lines)


def decision_reason(text: Column) -> Column:
    """The first paragraph under a Decision heading on one line; null when there is none."""
    blank = lambda l: strip(l) == ""
    is_heading = lambda l: (F.lower(strip(F.ltrim(l, F.lit("#")))) == "decision") & F.startswith(l, F.lit("##"))
    level = lambda l: F.length(l) - F.length(F.ltrim(l, F.lit("#")))
    ends = lambda l, i: (i > 0) & (blank(l) | (level(l).between(1, 6) & F.substring(F.ltrim(l, F.lit("#")), 1, 1).rlike(r"\s")))

    def paragraph(body: Column) -> Column:
        """``body`` starts with the paragraph's first line."""
        end = F.array_position(F.transform(body, ends), F.lit(True))
        kept = let(end, lambda e: F.when(e > 0, F.slice(body, 1, (e - 1).cast("int"))).otherwise(body))
        return let(collapse(F.array_join(kept, " ")), lambda reason: F.when(reason != "", clip(reason)))

    def under(body: Column) -> Column:
        first = F.array_position(F.transform(body, lambda l: ~blank(l)), F.lit(True))
        return let(first, lambda f: F.when(f > 0, let(F.slice(body, f.cast("int"), F.size(body)), paragraph)))

    return let(
        F.split(text, "\n"),
        lambda lines: let(F.array_position(F.transform(lines, is_heading), F.lit(True)), lambda found: F.when(found > 0, let(_after(found, lines), under))),
    )


def scan_decisions(files: DataFrame) -> DataFrame:
    """``(file_path, claim, because)`` per document of ``(file_path, text)`` that has a title."""
    # the exploded array keeps the filter on titles behind their computation
    title = F.explode(F.filter(F.array(decision_title(F.col("text"))), lambda t: t != ""))
    return files.select("file_path", "text", title.alias("title")).select(
        "file_path", clip(F.col("title")).alias("claim"), decision_reason(F.col("text")).alias("because")
    )
