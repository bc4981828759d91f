"""Column functions over knowledge records: provenance, timestamps, priority, rendering."""

from __future__ import annotations

import re

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Record kinds in the order they are presented, and the priority
# of a kind outside the list.
KIND_PRIORITY = {
    "gotcha": 0,
    "constraint": 1,
    "rejected": 2,
    "decision": 3,
    "source": 4,
    "behavior": 5,
    "intent": 6,
    "conflict": 7,
}
UNKNOWN_PRIORITY = 99
RECORD_KINDS = tuple(KIND_PRIORITY)

# The key order of one record line on disk.
WIRE_KEYS = ("id", "kn", "sb", "cl", "bc", "gv", "wn", "tn", "rf", "pv", "ts", "ss")

# Provenance tokens. A bare one stands alone, a prefixed one
# points at a commit, test, code line or document.
PROVENANCE_BARE = ("u", "a", "i")
PROVENANCE_PREFIXES = ("g", "t", "n", "d")

# Fixed value: how many records are injected for one file before the rest is
# only counted.
MAX_INJECTED = 12


def valid_provenance(pv: Column) -> Column:
    return pv.rlike(rf"\A(?:[{''.join(PROVENANCE_BARE)}]|[{''.join(PROVENANCE_PREFIXES)}]:(?s:.+))\z")


def provenance_kind(pv: Column) -> Column:
    return F.substring_index(pv, ":", 1)


def provenance_pointer(pv: Column) -> Column:
    """The local file a provenance token cites; null when it cites none."""
    kind = F.when(F.instr(pv, ":") > 1, provenance_kind(pv))
    pointer = F.regexp_extract(pv, r"(?s)\A[^:]*:(.*)\z", 1)
    path = (
        F.when(kind == "n", F.regexp_replace(pointer, r":[0-9]+\z", ""))
        .when(kind.isin("t", "d"), pointer)
    )
    return F.when(path != "", path)


def is_unvouched(pv: Column) -> Column:
    """True when nothing but a machine's own assertion stands behind the claim."""
    return pv.isin("a", "i")


def should_notify(mode: str, pv: Column) -> Column:
    return {"never": F.lit(False), "all": F.lit(True)}.get(mode, is_unvouched(pv))


def format_ts(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMddHHmmss")


def parse_ts(wire: Column) -> Column:
    """A ``YYYYMMDDHHMMSS`` instant as TIMESTAMP_NTZ; null unless it is on the calendar."""
    digits = F.when(wire.rlike(r"\A[0-9]{14}\z"), wire)
    spaced = F.regexp_replace(digits, r"\A(....)(..)(..)(..)(..)(..)\z", "$1-$2-$3 $4:$5:$6")
    return spaced.try_cast("timestamp_ntz")


def kind_priority(kind: Column) -> Column:
    ranks = reduce(
        lambda chain, item: chain.when(kind == item[0], item[1]),
        list(KIND_PRIORITY.items())[1:],
        F.when(kind == RECORD_KINDS[0], 0),
    )
    return ranks.otherwise(UNKNOWN_PRIORITY)


def canonical_json(*, prefix: str = "") -> Column:
    """The record as its one canonical line: fixed key order, absent keys left out."""
    return F.to_json(F.struct(*[F.col(prefix + key).alias(key) for key in WIRE_KEYS]))


# How a record is written on one line; readers of rules and hooks
# look for these signs.
BULLET, REASON, SCOPE, SOURCE = "  • [{kind}] ", " — {because}", " [module: {dir}]", " → consult {ref}"
TAIL = "  ({id}, {provenance})"


def _filled(form: str, **values: Column) -> Column:
    """``form`` with its names replaced by columns; null where one of them is null."""
    parts = [p for p in re.split(r"(\{\w+\})", form) if p]
    return F.concat(*[values[p[1:-1]] if p[0] == "{" else F.lit(p) for p in parts])


def record_line(
    kind: Column, claim: Column, because: Column, ref: Column, anchor_dir: Column, record_id: Column, pv: Column
) -> Column:
    """One bullet per record. A source leads with the document to consult."""
    none = F.lit("")
    consult = F.when((kind == "source") & (ref != ""), _filled(SOURCE, ref=ref))
    reason = F.when(because != "", _filled(REASON, because=because))
    return F.concat(
        _filled(BULLET, kind=kind), claim, F.coalesce(consult, none), F.coalesce(reason, none), F.coalesce(_filled(SCOPE, dir=anchor_dir), none),
        _filled(TAIL, id=record_id, provenance=pv),
    )


def overflow_line(hidden: Column) -> Column:
    return F.concat(F.lit("  … "), hidden.cast("string"), F.lit(" more apply here; search by subject to see them"))
