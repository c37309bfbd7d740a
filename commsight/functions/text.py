"""Column expressions for cleaning and labelling text.

All of these are built-in Spark expressions (JVM side, whole-stage codegen);
none needs a Python UDF.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def _c(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


# Python's str.strip() removes every character for which str.isspace() is
# true: the Unicode White_Space set plus the four separators U+001C..U+001F.
# Java's (?U)\s is the White_Space set, so we add the separators.
_WS = r"[\s\x1c-\x1f]"
_STRIP_PATTERN = rf"(?U)^{_WS}+|{_WS}+$"


def strip_text(c: ColumnOrName) -> Column:
    """Trim all Unicode whitespace at both ends, like Python ``strip()``.

    Spark's ``trim`` removes spaces only, so tabs and no-break spaces survive it.
    """
    return F.regexp_replace(_c(c), _STRIP_PATTERN, "")


def strip_suffix(c: ColumnOrName, sep: str = " - ") -> Column:
    """Text before the first ``sep``, stripped (``s.split(sep)[0].strip()``)."""
    return strip_text(F.substring_index(_c(c), sep, 1))


def last_token(c: ColumnOrName, sep: str = ",") -> Column:
    """Text after the last ``sep``, stripped and lower-cased.

    ``a.split(',')[-1].strip().lower()``; an address with no separator is
    returned whole.
    """
    return F.lower(strip_text(F.substring_index(_c(c), sep, -1)))


def title_case(c: ColumnOrName, sep: str = "_", replace_sep: str | None = None) -> Column:
    """Capitalise each run of letters, lower-case the rest.

    ``title_case('web_connectivity')`` gives ``Web_Connectivity`` and
    ``ipv4a's`` gives ``Ipv4A'S``, as ``str.title`` does.  With
    ``replace_sep=' '`` the separator is replaced too: ``tls_version`` gives
    ``Tls Version``.
    """
    text = _c(c) if replace_sep is None else F.replace(_c(c), F.lit(sep), F.lit(replace_sep))
    parts = F.regexp_extract_all(text, F.lit(r"\p{L}+|\P{L}+"), F.lit(0))
    return F.when(text.isNotNull(), F.array_join(F.transform(parts, lambda x: F.concat(
        F.upper(F.substring(x, 1, 1)), F.lower(F.substring(x, 2, 1 << 30)))), ""))


def status_label(flag: ColumnOrName, yes: str = "Anomaly", no: str = "Accessible") -> Column:
    """Boolean flag to a label; null counts as false, as in the source."""
    return F.when(F.coalesce(_c(flag), F.lit(False)), F.lit(yes)).otherwise(F.lit(no))


def asn_label(asn: ColumnOrName) -> Column:
    """Autonomous-system number rendered as ``AS n`` (``AS `` when absent)."""
    return F.concat(F.lit("AS "), F.coalesce(_c(asn).cast("string"), F.lit("")))


def percent_value(share: ColumnOrName, digits: int = 2) -> Column:
    """A 0..1 share as a percentage number rounded to ``digits``."""
    return F.round(_c(share).cast("double") * 100.0, digits)


def percent_text(share: ColumnOrName, digits: int = 2) -> Column:
    """P15 for rendering: ``12.35%``.  Null share stays null.

    Java formatting rounds HALF_UP on the decimal expansion, Python rounds the
    exact binary value; they can differ in the last digit on ties.
    """
    v = _c(share).cast("double")
    # format_string would render a null as "nu%" ("null" cut to the precision).
    return F.when(v.isNotNull(), F.format_string(f"%.{digits}f%%", v * 100.0))


def code_case(c: ColumnOrName) -> Column:
    """Upper-case a country code."""
    return F.upper(_c(c))


# Words are maximal runs of Unicode letters and digits.
_NON_WORD = r"[^\p{L}\p{N}]+"


def normalize_text(c: ColumnOrName) -> Column:
    """Lower-case, replace every run of non letters/digits by one space, trim.

    Used on both sides of entity matching (E1) so that a value and a phrase in
    a question compare equal whatever the punctuation around them.
    """
    return F.trim(F.regexp_replace(F.lower(_c(c)), _NON_WORD, " "))


def words(c: ColumnOrName) -> Column:
    """Array of normalised words (the words of ``normalize_text``); empty
    text gives an empty array.  One regex pass: split on non-word runs and
    drop the empty tokens a leading or trailing separator leaves."""
    return F.array_remove(F.split(F.lower(_c(c)), _NON_WORD, -1), "")


def blank_to_null(c: ColumnOrName) -> Column:
    """Scraped cells are ``''`` when blank; treat ``''`` and null alike."""
    col = _c(c)
    return F.when(col == "", F.lit(None)).otherwise(col)


def linked_name(name: ColumnOrName, link: ColumnOrName) -> Column:
    """K6: ``[name](link)``."""
    return F.concat(F.lit("["), _c(name), F.lit("]("), _c(link), F.lit(")"))
