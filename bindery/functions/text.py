"""Column expressions on sequences and labels. All of them stay inside the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from bindery.constants import (
    CLASS_ONE_PATTERN,
    CLASS_TWO_PATTERN,
    CLASS_ONE_PATTERN_STRICT,
    COLON_ALLELE_PATTERN,
    LATER_GENES_PATTERN,
    PAD_SYMBOL,
    RESIDUES,
    SPAN_TERMINALS,
    WHITE_SPACE,
    WILDCARD_PATTERN,
)


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: str | Column) -> Column:
    """Text without leading and trailing white space of any kind; null becomes ``''``."""
    return F.btrim(F.coalesce(_col(c).cast("string"), F.lit("")), F.lit(WHITE_SPACE))


def choose_nonempty(first: str | Column, second: str | Column) -> Column:
    """The first value unless it is blank, then the second."""
    a, b = strip(first), strip(second)
    return F.when(a != "", a).otherwise(b)


def all_nonempty(cols: list[str]) -> Column:
    """True when none of the columns is the empty string."""
    return reduce(lambda x, y: x & y, [_col(c) != "" for c in cols])


def has_wildcard(*cols: str | Column) -> Column:
    """True when any of the columns holds a wildcard residue."""
    return reduce(lambda x, y: x | y, [_col(c).rlike(WILDCARD_PATTERN) for c in cols])


def preclean_gene(c: str | Column) -> Column:
    """Repair a gene symbol: ``:01`` becomes ``*01``; ambiguous calls keep the first gene."""
    starred = F.regexp_replace(_col(c), COLON_ALLELE_PATTERN, r"*$1")
    return F.btrim(F.regexp_replace(starred, LATER_GENES_PATTERN, ""), F.lit(WHITE_SPACE))


def mhc_class(alleles: str | Column, strict_class_names: bool = False) -> Column:
    """``MHCI``, ``MHCII`` or ``''`` from free allele text.

    The text ``HLA class II`` also contains ``HLA class I``, so by default it counts for
    both classes and stays undecided; ``strict_class_names`` ends the name at the ``I``.
    """
    upper = F.upper(strip(alleles))
    one = upper.rlike(CLASS_ONE_PATTERN_STRICT if strict_class_names else CLASS_ONE_PATTERN)
    two = upper.rlike(CLASS_TWO_PATTERN)
    # each pattern is searched once; the text is never null here
    names = F.array(*[F.lit(n) for n in ("", "MHCI", "MHCII", "")])
    return F.get(names, one.cast("int") + 2 * two.cast("int"))


def same_scheme(c: str | Column) -> Column:
    """An IRI with ``https`` folded to ``http``, trimmed."""
    text = F.coalesce(_col(c).cast("string"), F.lit(""))
    return strip(F.replace(text, F.lit("https://"), F.lit("http://")))


def strip_gaps(c: str | Column) -> Column:
    """Sequence without alignment gaps, trimmed, upper case; null becomes ``''``."""
    return F.upper(strip(F.translate(F.coalesce(_col(c).cast("string"), F.lit("")), "-.", "")))


def locate(haystack: str | Column, needle: str | Column) -> Column:
    """0-based position of the needle; -1 when it is empty or absent."""
    needle = _col(needle)
    return F.when(needle == "", F.lit(-1)).otherwise(F.instr(_col(haystack), needle) - 1)


def core_span(full: str | Column, core: str | Column) -> Column:
    """Struct ``(start, end)`` of the core sequence inside the full one, half-open, from 0.

    Tried in order: the core; with ``C`` in front; then for each terminal the core plus
    terminal, and that with ``C`` in front. The ``C`` forms are skipped when the core
    already begins with ``C``. Null when nothing is found.
    """
    full, core = _col(full), F.upper(_col(core))
    lacks_c = ~core.startswith("C")
    tries = [core, F.when(lacks_c, F.concat(F.lit("C"), core))]
    for end in SPAN_TERMINALS:
        tries.append(F.concat(core, F.lit(end)))
        tries.append(F.when(lacks_c, F.concat(F.lit("C"), core, F.lit(end))))
    # compiled, and none is tried behind the first that fits
    found = F.coalesce(*[F.when(F.instr(full, t) > 0, t) for t in tries])
    start = F.instr(full, found) - 1
    return F.when(
        found.isNotNull(),
        F.struct(start.alias("start"), (start + F.length(found)).alias("end")),
    )


def cut_span(full: str | Column, start: str | Column, end: str | Column) -> Column:
    """``full[start:end]`` with a half-open interval from 0."""
    start, end = _col(start), _col(end)
    return F.substr(_col(full), start + 1, end - start)


def residue_ids(seq: str | Column, max_len: int, pad: bool = True) -> Column:
    """Residue numbers: padding 0, the twenty residues 1..20, anything else 21."""
    known = F.lit(PAD_SYMBOL + RESIDUES)
    letters = F.filter(F.split(F.substring(_col(seq), 1, max_len), ""), lambda x: x != "")
    unknown = len(RESIDUES) + 1
    ids = F.transform(
        letters, lambda x: F.when(F.instr(known, x) > 0, F.instr(known, x) - 1).otherwise(unknown)
    )
    if not pad:
        return ids
    return F.concat(ids, F.array_repeat(F.lit(0), F.lit(max_len) - F.size(ids)))


def residue_mask(seq: str | Column, max_len: int) -> Column:
    """1 for each residue kept, 0 for each padding position."""
    kept = F.least(F.length(_col(seq)), F.lit(max_len))
    return F.concat(F.array_repeat(F.lit(1), kept), F.array_repeat(F.lit(0), max_len - kept))


def deletions(seq: Column, depth: int) -> Column:
    """All distinct texts left after removing up to ``depth`` characters."""
    return _shorter_levels(F.array(seq), F.array(seq), depth)


def _shorter_levels(level: Column, found: Column, depth: int) -> Column:
    if depth == 0:
        return F.array_distinct(found)
    below = F.array_distinct(F.flatten(F.transform(level, _drop_one)))
    # Bound as a lambda variable, so that the level is worked out once and used twice.
    step = F.transform(F.array(below), lambda b: _shorter_levels(b, F.concat(found, b), depth - 1))
    return F.get(step, 0)


def _drop_one(text: Column) -> Column:
    """Every text with one character removed; nothing is left to remove from ``''``."""
    places = F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1)))
    return F.transform(
        places, lambda i: F.concat(F.substr(text, F.lit(1), i - 1), F.substr(text, i + 1))
    )
