"""DuckDB text fragments shared by oracle twins (written independently of the Spark code paths)."""

from __future__ import annotations

from roomrate import constants as K
from roomrate.functions.text import AMENITY_DELETE_CHARS


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def amenity_norm_sql(col: str) -> str:
    s = f"translate(lower({col}), {q(AMENITY_DELETE_CHARS)}, '')"
    for old, new in K.AMENITY_REPLACEMENTS:
        s = f"replace({s}, {q(old)}, {q(new)})"
    return s


def amenity_rename_sql(tok: str) -> str:
    whens = " ".join(f"WHEN {q(a)} THEN {q(b)}" for a, b in K.AMENITY_RENAMES.items())
    return f"CASE {tok} {whens} ELSE {tok} END"


def naive_fill_sql(base: str, targets, round_result: bool, category="room_type", lat="latitude", lon="longitude",
                   half=K.NEIGHBOUR_LAT_HALF_WIDTH, zero_is_missing: bool = False, key_cols=None) -> str:
    """SELECT over `base` (a CTE name) with each target filled by a correlated neighbour mean."""
    reps = []
    for t in targets:
        mean = (f"(SELECT avg(b.{t}) FROM {base} b WHERE b.{category} = a.{category} "
                f"AND b.{lat} > a.{lat} - {half} AND b.{lat} < a.{lat} + {half} "
                f"AND b.{lon} > a.{lon} - {half} AND b.{lon} < a.{lon} + {half})")
        if round_result:
            mean = f"round_even({mean}, 0)"
        missing = f"(a.{t} IS NULL OR a.{t} = 0)" if zero_is_missing else f"a.{t} IS NULL"
        reps.append(f"CASE WHEN {missing} THEN {mean} ELSE CAST(a.{t} AS DOUBLE) END AS {t}")
    return f"SELECT a.* REPLACE ({', '.join(reps)}) FROM {base} a"


def treebank_sql(x: str) -> str:
    """List of the Treebank-like tokens of a text column."""
    out = f"regexp_replace(lower({x}), '\\d+', '', 'g')"
    for pattern, into in K.TOKEN_RULES:
        out = f"regexp_replace({out}, {q(pattern)}, {q(into)}, 'g')"
    return f"list_filter(string_split({out}, ' '), lambda w: regexp_matches(w, {q(K.TOKEN_KEPT)}))"


def stop_words_sql(words) -> str:
    return "[" + ", ".join(q(w) for w in words) + "]"
