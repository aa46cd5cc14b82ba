"""Scalar text rules as Column factories. Each rule exists once, for batch, stream and SQL alike."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Lower-case Latin-1 letters that have a base letter, and the letters.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
BASE = "aaaaaaceeeeiiiinooooouuuuyy"
# The smaller table that names fold by, in both cases.
NAME_ACCENTED = "àáâäçèéêëìíîïñòóôöùúûüÀÁÂÄÇÈÉÊËÌÍÎÏÑÒÓÔÖÙÚÛÜ"
NAME_BASE = "aaaaceeeeiiiinoooouuuuAAAACEEEEIIIINOOOOUUUU"
# Dashes and quotes that have a plain form.
FANCY, PLAIN = "‐‑‒–‘’", "----''"


def squeeze(col: Column) -> Column:
    """Runs of white space become one blank; none at the ends."""
    return F.trim(F.regexp_replace(col, r"(?U)\s+", " "))


def title_normalize(col: Column) -> Column:
    """Lower case, accents folded, one trailing ``#token`` and all ``[...]`` dropped, plain dashes and quotes."""
    out = F.translate(F.lower(col), ACCENTED, BASE)
    out = F.regexp_replace(out, r"(?U)\s*#\S+\s*$", "")
    out = F.regexp_replace(out, r"\[[^\]]*\]", "")
    return squeeze(F.translate(out, FANCY, PLAIN))


def name_fold(col: Column) -> Column:
    """ASCII letters and digits in upper case; anything else is a gap; gaps are single, none at the ends."""
    return F.upper(F.trim(F.regexp_replace(F.translate(col, NAME_ACCENTED, NAME_BASE), "[^A-Za-z0-9]+", " ")))


def group_name(col: Column, franchise: str) -> Column:
    """A folded name with ``&`` read as *and* and without one leading franchise word."""
    return F.regexp_replace(name_fold(F.replace(col, F.lit("&"), F.lit(" and "))), f"^{franchise.upper()} ", "")


def comparable_name(col: Column, synonyms: dict[str, str]) -> Column:
    """Folded tokens, synonyms unified."""
    tokens = F.split(name_fold(col), " ")
    if synonyms:
        table = F.create_map(*[F.lit(x) for pair in synonyms.items() for x in pair])
        tokens = F.transform(tokens, lambda t: F.coalesce(table[t], t))
    return F.array_join(tokens, " ")


def name_parts(col: Column) -> Column:
    """``struct(base, tags, number)``: closed brackets are tags; a token after the last ``#`` is a number if it
    starts with a letter or digit and has only those and ``. - /``, else it stays."""
    tags = F.transform(F.regexp_extract_all(col, F.lit(r"\[([^\]]*)\]"), 1), lambda t: F.trim(t))
    bare = F.regexp_replace(col, r"\[[^\]]*\]", "")
    pattern = r"(?s)^(.*)#(?U:\s*)([A-Za-z0-9][A-Za-z0-9./-]*)(?U:\s*)$"
    number = F.nullif(F.regexp_extract(bare, pattern, 2), F.lit(""))
    base = F.when(number.isNotNull(), F.regexp_extract(bare, pattern, 1)).otherwise(bare)
    return F.named_struct(F.lit("base"), squeeze(base), F.lit("tags"), tags, F.lit("number"), number)


def canonical_number(col: Column) -> Column:
    """Upper case; leading zeros dropped in each run of digits, a run of zeros becomes ``0``."""
    return F.regexp_replace(F.upper(col), "(?<![0-9])0+(?=[0-9])", "")


def alpha_prefix(col: Column) -> Column:
    return F.upper(F.regexp_extract(col, "^[A-Za-z]*", 0))


def shelf(slug: Column, rules: list[tuple[str, str, str]], default: str) -> Column:
    """The name of the first rule ``(test, text, name)`` that holds; tests are ``prefix`` and ``contains``."""
    out = None
    for test, text, name in rules:
        holds = slug.startswith(text) if test == "prefix" else slug.contains(text)
        out = F.when(holds, name) if out is None else out.when(holds, name)
    return F.lit(default) if out is None else out.otherwise(default)


def denied(title: Column, equal: tuple[str, ...] = (), endings: tuple[str, ...] = (), parts: tuple[str, ...] = ()) -> Column:
    """Whether a normalised title is on a denylist of whole titles, endings and parts."""
    out = F.lit(False)
    for x in equal:
        out = out | (title == x)
    for x in endings:
        out = out | title.endswith(x)
    for x in parts:
        out = out | title.contains(x)
    return out


def strip_count(col: Column) -> Column:
    """``"PSA 10 (30)"`` -> ``"PSA 10"``: cut at the last `` (`` unless it starts the text."""
    return F.regexp_replace(col, r"(?s)^(.+) \(.*$", "$1")


def money_to_cents(col: Column) -> Column:
    """``struct(cents, drift)``: blank is null; leading ``$`` and commas go; half cents round to even; a sign,
    other characters or a value beyond an int is drift."""
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(col, r"^[\s\u00a0]+|[\s\u00a0]+$", ""), r"^\$+", ""), ",", "")
    amount = F.when(bare.rlike(r"^[0-9]*\.?[0-9]+$|^[0-9]+\.$"), bare.try_cast("decimal(20,4)"))
    cents = F.bround(amount * 100, 0)
    fits = cents <= 2_147_483_647
    blank = F.coalesce(F.regexp_replace(col, r"[\s\u00a0]", "") == "", F.lit(True))
    return F.named_struct(F.lit("cents"), F.when(~blank & fits, cents.cast("int")), F.lit("drift"), ~blank & ~F.coalesce(fits, F.lit(False)))


def strict_date(col: Column) -> Column:
    """A date written exactly ``yyyy-MM-dd``, else null."""
    return F.when(col.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.try_to_date(col, "yyyy-MM-dd"))


def epoch_ms_date(col: Column) -> Column:
    return F.to_date(F.timestamp_millis(col))


def split_id(col: Column) -> Column:
    """``struct(source, id)``, split at the first ``-``; both null without one."""
    at = F.instr(col, "-")
    return F.named_struct(F.lit("source"), F.when(at > 1, F.substring_index(col, "-", 1)), F.lit("id"), F.when(at > 1, F.substr(col, at + 1)))


def stream_position(col: Column) -> Column:
    """``struct(stream, position)`` of ids in number sequences: a number, or ``session-lot``."""
    whole = F.when(col.rlike("^[0-9]+$"), col.try_cast("bigint"))
    parts = F.when(col.rlike("^[0-9]+-[0-9]+$"), F.split(col, "-"))
    lot = parts[1].try_cast("bigint")
    return F.named_struct(F.lit("stream"), F.when(whole.isNotNull(), F.lit("")).when(lot.isNotNull(), parts[0]), F.lit("position"), F.coalesce(whole, lot))


def capitalise_segments(col: Column) -> Column:
    return F.array_join(F.transform(F.split(col, "-"), lambda s: F.initcap(s)), "-")


# Numerals that a numbered name may end in.
NUMERALS = {"i": 1, "ii": 2, "iii": 3, "iv": 4, "v": 5, "vi": 6, "vii": 7, "viii": 8, "ix": 9, "x": 10}


def roman_suffix(col: Column) -> Column:
    """The number that the last ``-`` segment writes in Roman numerals; anything else is an error."""
    table = F.create_map(*[F.lit(x) for pair in NUMERALS.items() for x in pair])
    got = table[F.lower(F.substring_index(col, "-", -1))]
    return F.when(got.isNotNull(), got).otherwise(F.raise_error(F.concat(F.lit("no numeral ends "), F.coalesce(col, F.lit("null")))).cast("int"))


def trailing_id(url: Column, strict: bool = True) -> Column:
    """The number that ends a URL's path; an error (or null) if there is none."""
    got = F.nullif(F.regexp_extract(url, r"([0-9]+)/?$", 1), F.lit("")).cast("bigint")
    return F.when(got.isNotNull(), got).otherwise(F.raise_error(F.concat(F.lit("no id ends "), F.coalesce(url, F.lit("null")))).cast("bigint")) if strict else got


def lookup(col: Column, table: dict[str, str], what: str) -> Column:
    """A total lookup: a key outside the caller's table is an error."""
    got = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[col]
    return F.when(got.isNotNull(), got).otherwise(F.raise_error(F.concat(F.lit(f"unknown {what}: "), F.coalesce(col, F.lit("null")))))


def clip_labels(labels: Column, length: int = 24, most: int = 8) -> Column:
    """Up to ``most`` labels, each cut to ``length`` characters and an ellipsis."""
    return F.array_join(F.transform(F.slice(labels, 1, most), lambda x: F.when(F.length(x) > length, F.concat(F.substring(x, 1, length), F.lit("…"))).otherwise(x)), ", ")


def safe_path(url: Column, prefix: str, longest: int = 512) -> Column:
    """A site-relative URL below a prefix, without ``..``, of bounded length."""
    return url.startswith(prefix) & ~url.contains("..") & (F.length(url) <= longest)


def version_tag(tag: Column, fetched_at: Column) -> Column:
    return F.coalesce(tag, F.concat(F.lit("api-"), F.date_format(fetched_at, "yyyy-MM-dd")))
