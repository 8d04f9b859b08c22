"""Column expressions (P-series).  All are built-in Spark expressions, so they
stay inside whole-stage codegen; none of them is a Python UDF.

Null rules (the part that most often goes wrong):

* ``x != 'E01'`` drops NULL rows in SQL; the exclusions here are null-safe
  (``NOT (x <=> v)``) so blank codes are kept.
* ``greatest(0, NULL)`` is 0 in Spark; the clamp keeps NULL as NULL.
* An all-NULL group sums to NULL; roll-ups wrap sums in ``coalesce(…, 0)``.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Python's ``\s`` (str.isspace) as an explicit class, portable to Java regex
# and RE2 alike: C0 spaces, the file/group/record/unit separators, NEL and
# every Unicode separator (Zs, Zl, Zp, which include the no-break space).
PY_SPACE = r"\t\n\x{0B}\f\r\x{1C}-\x{1F}\x{85}\p{Z}"
# Python's ``\w`` for str patterns: letters, numbers, underscore.
PY_WORD = r"\p{L}\p{N}_"
# Word characters for keyword boundaries: letters, combining marks, numbers, _.
KW_WORD = r"\p{L}\p{M}\p{N}_"


def col_(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---------------------------------------------------------------- predicates

def not_in_null_safe(c: str | Column, values: Iterable) -> Column:
    """P3 building block: true unless the value equals one of ``values``;
    NULL compares as "not equal" and is kept."""
    c = col_(c)
    cond = F.lit(True)
    for v in values:
        cond = cond & ~c.eqNullSafe(F.lit(v))
    return cond


def oda_exclusion(sector: str | Column = "sector_code",
                  aid_type: str | Column = "aid_type",
                  excluded_sectors: Sequence[str] = ("930",),
                  excluded_aid: Sequence[str] = ("E01", "E02")) -> Column:
    """Drop excluded sector and aid-type codes, keep blanks."""
    return not_in_null_safe(sector, excluded_sectors) & not_in_null_safe(aid_type, excluded_aid)


def starts_with(c: str | Column, prefix: str, negate: bool = False) -> Column:
    """P5 (negated when asked).  NULL input gives NULL, which a filter drops."""
    e = col_(c).startswith(prefix)
    return ~e if negate else e


def ends_with_none(c: str | Column, suffixes: Sequence[str]) -> Column:
    """Keep values that end with none of ``suffixes``."""
    c = col_(c)
    cond = F.lit(True)
    for s in suffixes:
        cond = cond & ~c.endswith(s)
    return cond


def contains_literal(c: str | Column, needle: str) -> Column:
    """Fixed-string containment (parentheses are not regex here)."""
    return F.contains(col_(c), F.lit(needle))


def conditional_keep(ref: str | Column, text: str | Column,
                     rules: Sequence[tuple[str, str]]) -> Column:
    """For each ``(ref_value, needle)`` rule, rows of that ref are kept only
    when ``text`` contains ``needle``; other refs are untouched.  A NULL ref is
    dropped, and a NULL text drops a row only for refs that have a rule."""
    ref, text = col_(ref), col_(text)
    cond = ref.isNotNull()
    for value, needle in rules:
        cond = cond & ((ref != F.lit(value)) | F.coalesce(contains_literal(text, needle), F.lit(False)))
    return cond


def flag_from_label(label: str | Column, prefix: str) -> Column:
    """Boolean flag = label starts with ``prefix``."""
    return col_(label).startswith(prefix)


# ------------------------------------------------------------------- scalars

def clamp_nonneg(c: str | Column) -> Column:
    """P10: ``max(0, x)`` that keeps NULL (``greatest`` would turn NULL into 0)."""
    c = col_(c)
    return F.when(c < 0, F.lit(0.0)).otherwise(c)


def scale(c: str | Column, factor: str | Column | float) -> Column:
    """Unit scaling / deflation by a factor column or constant."""
    f = factor if isinstance(factor, Column) else (F.col(factor) if isinstance(factor, str) else F.lit(factor))
    return col_(c) * f


def recode(c: str | Column, mapping: dict[str, str]) -> Column:
    """Map listed values, keep the rest (``coalesce(map[c], c)``)."""
    c = col_(c)
    if not mapping:
        return c
    m = F.create_map(*[x for kv in mapping.items() for x in (F.lit(kv[0]), F.lit(kv[1]))])
    return F.coalesce(F.try_element_at(m, c), c)


def repair_from_prefix(key: str | Column, ident: str | Column,
                       rules: Sequence[tuple[str, str]]) -> Column:
    """Set ``key`` to ``value`` where ``ident`` starts with ``prefix``."""
    out = col_(key)
    ident = col_(ident)
    for prefix, value in rules:
        out = F.when(ident.startswith(prefix), F.lit(value)).otherwise(out)
    return out


def unicode_trim(c: str | Column) -> Column:
    """Strip leading/trailing whitespace including no-break spaces."""
    return F.regexp_replace(col_(c), f"^[{PY_SPACE}]+|[{PY_SPACE}]+$", "")


def hspace_to_space(c: str | Column) -> Column:
    """Every horizontal space character becomes a plain space."""
    return F.regexp_replace(col_(c), r"\h", " ")


def concat_text(*cols: str | Column) -> Column:
    """Join text columns with one space, skipping NULLs."""
    return F.concat_ws(" ", *[col_(c) for c in cols])


def normalize_text(c: str | Column) -> Column:
    """Non-word characters to space, collapse whitespace, strip, lower;
    a blank result is NULL."""
    # "non-word, non-space → space" followed by "whitespace runs → one space"
    # is the same as one pass turning every run of non-word characters into a
    # single space.
    s = F.regexp_replace(col_(c), f"[^{PY_WORD}]+", " ")
    s = F.lower(F.trim(s))
    return F.nullif(s, F.lit(""))     # computes the text once, where a condition on it would twice


def strip_stopwords(c: str | Column, stopwords: Sequence[str]) -> Column:
    """Drop stop words from a space-separated text.

    ``x IN (…)`` with a long literal list is planned as a hash-set lookup
    (InSet), so the cost per token does not grow with the list.
    """
    words = sorted(set(stopwords))
    toks = F.split(F.coalesce(col_(c), F.lit("")), " ")
    kept = F.filter(toks, lambda t: (t != "") & ~t.isin(words))
    return F.array_join(kept, " ")


def value_bin(c: str | Column, edges: Sequence[float]) -> Column:
    """P20: index of ``[e_i, e_{i+1})``; the last bin is closed; out of range
    (or NULL) gives NULL."""
    c = col_(c)
    out = F.lit(None).cast("int")
    n = len(edges) - 1
    for i in reversed(range(n)):
        lo, hi = edges[i], edges[i + 1]
        inside = (c >= lo) & ((c <= hi) if i == n - 1 else (c < hi))
        out = F.when(inside, F.lit(i)).otherwise(out)
    return out


def bin_label(c: str | Column, edges: Sequence[float]) -> Column:
    """P20 label ``"lo - hi"`` for the bin of ``c``."""
    idx = value_bin(c, edges)
    labels = [f"{_num(edges[i])} - {_num(edges[i + 1])}" for i in range(len(edges) - 1)]
    arr = F.array(*[F.lit(x) for x in labels])
    return F.when(idx.isNull(), F.lit(None)).otherwise(F.element_at(arr, idx + 1))


def _num(x: float) -> str:
    return str(int(x)) if float(x).is_integer() else str(x)


def money_text(c: str | Column, digits: int = 1) -> Column:
    """``$1,234.5`` style text (NULL stays NULL)."""
    c = col_(c)
    return F.when(c.isNull(), F.lit(None)).otherwise(
        F.concat(F.when(c < 0, F.lit("-$")).otherwise(F.lit("$")),
                 F.format_number(F.abs(c), digits)))


def range_text(lo: str | Column, hi: str | Column, digits: int = 1) -> Column:
    """``"$lo - $hi"``."""
    return F.concat_ws(" - ", money_text(lo, digits), money_text(hi, digits))
