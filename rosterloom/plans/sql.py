"""Pieces of SQL that say what the text functions do."""

from __future__ import annotations

from rosterloom.functions import text


def quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def digits_sql(c: str) -> str:
    return f"regexp_replace(translate({c}, '{text.CONFUSED}', '{text.CONFUSED_DIGITS}'), '[^0-9]', '', 'g')"


def latin_sql(c: str) -> str:
    for greek, latin in (*text.DIGRAPHS, *text.LONG_LETTERS):
        c = f"replace({c}, '{greek}', '{latin}')"
    return f"translate({c}, '{text.LETTERS_GREEK}', '{text.LETTERS_LATIN}')"


def plain_upper_sql(c: str) -> str:
    return f"upper(translate({c}, '{text.ACCENTED}', '{text.PLAIN}'))"


def similar_sql(a: str, b: str) -> str:
    return f"CASE WHEN {a} = {b} THEN 1.0::DOUBLE WHEN {a} = '' OR {b} = '' THEN 0.0::DOUBLE ELSE 1 - levenshtein({a}, {b})::DOUBLE / greatest(strlen({a}), strlen({b})) END"
