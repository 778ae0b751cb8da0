"""Text scalar expressions (all JVM-side Column expressions)."""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _accent_table() -> tuple[str, str]:
    """Single-letter transliteration for Latin-1 Supplement and Latin Extended-A, built by rule:
    a letter whose canonical decomposition is one ASCII letter plus combining marks maps to it."""
    src, dst = [], []
    for cp in range(0xC0, 0x180):
        ch = chr(cp)
        base = unicodedata.normalize("NFKD", ch)
        plain = "".join(c for c in base if not unicodedata.combining(c))
        if len(plain) == 1 and plain.isascii() and plain.isalpha() and plain != ch:
            src.append(ch)
            dst.append(plain)
    return "".join(src), "".join(dst)


ACCENTED, PLAIN = _accent_table()


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# Letters transliterated to two letters.
SHARP_S = ("ß", "ss")


def unaccent(c) -> Column:
    return F.replace(F.translate(_c(c), ACCENTED, PLAIN), F.lit(SHARP_S[0]), F.lit(SHARP_S[1]))


def norm_text(c) -> Column:
    """Unaccent, trim, upper; null -> ''."""
    return F.coalesce(F.upper(F.trim(unaccent(_c(c).cast("string")))), F.lit(""))


def norm_text_lit(v: str) -> str:
    """Driver-side twin of ``norm_text`` for literal parameters."""
    s = "".join(PLAIN[ACCENTED.index(ch)] if ch in ACCENTED else ch for ch in (v or ""))
    return s.replace(*SHARP_S).strip(" ").upper()


def norm_header(c) -> Column:
    """Unaccent, collapse whitespace, trim, lower."""
    return F.lower(F.trim(F.regexp_replace(unaccent(_c(c)), r"\s+", " ")))


def norm_header_lit(v: str) -> str:
    s = "".join(PLAIN[ACCENTED.index(ch)] if ch in ACCENTED else ch for ch in (v or ""))
    return " ".join(s.replace(*SHARP_S).split()).lower()


# Strings treated as missing by the cleaning helpers.
MISSING_WORDS = ("nan", "none", "nat")


def safe_string(c) -> Column:
    """null -> '', trimmed text."""
    return F.coalesce(F.trim(_c(c).cast("string")), F.lit(""))


def clean_string(c) -> Column:
    """Like ``safe_string`` but the words nan/none/nat (any case) also become ''."""
    s = safe_string(c)
    return F.when(F.lower(s).isin(*MISSING_WORDS), F.lit("")).otherwise(s)


def coalesce_field(c, default) -> Column:
    return F.coalesce(_c(c), F.lit(default))


def blank_to_null(c) -> Column:
    return F.nullif(F.trim(_c(c).cast("string")), F.lit(""))


def address_line(*cols) -> Column:
    """Non-blank parts joined by ', ' (concat_ws skips nulls)."""
    return F.concat_ws(", ", *[blank_to_null(c) for c in cols])


def or_contains(cols, needle_lower: str) -> Column:
    """Case-insensitive literal substring over several columns (nulls never match)."""
    return reduce(lambda a, b: a | b,
                  [F.coalesce(F.lower(_c(c).cast("string")).contains(F.lit(needle_lower)), F.lit(False))
                   for c in cols])


# Scored-search match types and scores, in priority order.
MATCH_RULES = (("exacta", 100), ("clave_parcial", 90), ("estado", 80),
               ("municipio", 70), ("localidad", 60), ("nombre", 50))


def match_type(query: str, key, group, municipality, locality, name) -> Column:
    """First matching rule of the scored search (accent-insensitive); null when none."""
    q = F.lit(norm_text_lit(query))
    k = norm_text(key)
    return (F.when(k == q, "exacta")
            .when(k.contains(q), "clave_parcial")
            .when(norm_text(group).contains(q), "estado")
            .when(norm_text(municipality).contains(q), "municipio")
            .when(norm_text(locality).contains(q), "localidad")
            .when(norm_text(name).contains(q), "nombre"))


def match_score(mtype: Column) -> Column:
    e = None
    for t, s in MATCH_RULES:
        e = (F.when(mtype == t, s) if e is None else e.when(mtype == t, s))
    return e.otherwise(0)


# Facility key pattern of the image folders.
KEY_PATTERN = r"([A-Za-z1l])-\s*(\d{2,3})-(\d{2,3})-(\d{2,3})"


def _zfill(x: Column, n: int) -> Column:
    # lpad never shortens here, like str.zfill
    return F.lpad(x, F.greatest(F.length(x), F.lit(n)), F.lit("0"))


def normalise_facility_key(c) -> Column:
    """Folder name -> canonical lower-case facility key; unmatched -> lower(text)."""
    s = _c(c)
    m = s.rlike(KEY_PATTERN)
    letter = F.regexp_extract(s, KEY_PATTERN, 1)
    letter = F.when(letter.isin("L", "l", "1"), F.lit("I")).otherwise(letter)
    key = F.concat_ws("-", letter,
                      _zfill(F.regexp_extract(s, KEY_PATTERN, 2), 2),
                      _zfill(F.regexp_extract(s, KEY_PATTERN, 3), 3),
                      _zfill(F.regexp_extract(s, KEY_PATTERN, 4), 2))
    return F.lower(F.when(m, key).otherwise(F.trim(s)))
