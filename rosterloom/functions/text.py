"""Text normalisation, transliteration and similarity as Column expressions.

Everything stays in built-in functions except NFC composition and named HTML
entities, which Spark lacks; those two are pandas UDFs and are only needed for
input that is not composed already or that holds named entities.
"""

from __future__ import annotations

import html
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- fixed values ---------------------------------------------------------
#: Latin capitals and the Greek capitals they are mistaken for.
LOOK_ALIKE_LATIN = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOOK_ALIKE_GREEK = "ΑΒΚΔΕΦΓΗΙΞΚΛΜΝΟΡΚΡΣΤΥΒΩΧΥΖ"
#: Letters read for digits, and the digits.
CONFUSED = "OoΟοΘθQIiΙιlL|ZzSsGgBbβ"
CONFUSED_DIGITS = "00000001111111225566888"
DASHES = "‐‑‒–—―−⁻﹣－_"
SINGLE_QUOTES = "‘’‚‛"
DOUBLE_QUOTES = "“”„‟«»"
SPACES = "      ​﻿"
#: Digraphs are replaced first, in this order, then letters.
DIGRAPHS = (("ΑΥ", "AV"), ("ΕΥ", "EV"), ("ΟΥ", "OU"), ("ΤΖ", "TZ"), ("ΓΓ", "NG"), ("ΓΚ", "GK"), ("ΜΠ", "MP"))
LONG_LETTERS = (("Θ", "TH"), ("Ξ", "KS"), ("Χ", "CH"), ("Ψ", "PS"))
LETTERS_GREEK = "ΑΒΓΔΕΖΗΙΚΛΜΝΟΠΡΣΤΥΦΩ"
LETTERS_LATIN = "AVGDEZIIKLMNOPRSTYFO"
#: A private sign.
ASIDE = "\ue000"
#: All white space, as code points: controls, blanks, and the separators of Unicode.
WHITE_SPACE = (9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
TRIM_SIGNS = r""".,;\-—|/"' """
# --------------------------------------------------------------------------


def _accents() -> tuple[str, str]:
    """Accented Greek letters and their plain ones: tonos and dialytika in both
    cases, breathings and the other old accents in lower case."""
    pairs = []
    for code in (*range(0x0386, 0x03D0), *range(0x1F00, 0x2000)):
        c = chr(code)
        base = unicodedata.normalize("NFD", c)[0]
        if base != c and base.isalpha() and "GREEK" in unicodedata.name(c, "") and (code < 0x1F00 or c.islower()):
            pairs.append((c, base))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


ACCENTED, PLAIN = _accents()


@F.pandas_udf(T.StringType())
def nfc(text: pd.Series) -> pd.Series:
    """Unicode composition; null stays null."""
    return text.map(lambda x: unicodedata.normalize("NFC", x), na_action="ignore")


@F.pandas_udf(T.StringType())
def unescape_entities(text: pd.Series) -> pd.Series:
    """All named and numeric HTML entities; null stays null."""
    return text.map(html.unescape, na_action="ignore")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trim_space(c: Column | str) -> Column:
    """Trims all white space; Spark's own trim takes blanks only."""
    return F.btrim(_col(c), F.lit("".join(map(chr, WHITE_SPACE))))


def strip_accents(c: Column | str) -> Column:
    return F.translate(_col(c), ACCENTED, PLAIN)


def upper_plain(c: Column | str) -> Column:
    """Upper case, one sign for one: sharp s stays, as it has no single capital."""
    # it is put aside as a sign without cases; the argument occurs once, since these nest
    return F.translate(F.upper(F.translate(_col(c), "ß", ASIDE)), ASIDE, "ß")


def normalize_text(c: Column | str, compose: bool = False) -> Column:
    """Dashes, quotes, accents and spaces made uniform, runs of white space
    collapsed, ends trimmed. compose: apply NFC first (a Python UDF)."""
    x = nfc(_col(c)) if compose else _col(c)
    x = F.translate(x, DASHES + SINGLE_QUOTES + DOUBLE_QUOTES + SPACES, "-" * len(DASHES) + "'" * len(SINGLE_QUOTES) + '"' * len(DOUBLE_QUOTES) + " " * len(SPACES))
    return F.trim(F.regexp_replace(strip_accents(x), r"[ \t\r\n]+", " "))


def look_alike_upper(c: Column | str) -> Column:
    """Upper case with Latin look-alikes turned Greek."""
    return F.translate(upper_plain(c), LOOK_ALIKE_LATIN, LOOK_ALIKE_GREEK)


def digits_only(c: Column | str) -> Column:
    """Digits, with letters mistaken for digits mapped and all else dropped; empty below six."""
    x = F.regexp_replace(F.translate(_col(c), CONFUSED, CONFUSED_DIGITS), "[^0-9]", "")
    return F.when(F.char_length(x) < 6, F.lit("")).otherwise(x)


def phones(c: Column | str) -> Column:
    """The numbers of a comma list: array<string> without empty ones."""
    return F.filter(F.transform(F.split(_col(c), ","), digits_only), lambda x: x != "")


def transliterate(c: Column | str, compose: bool = False) -> Column:
    """Greek to upper-case Latin letters; other signs pass."""
    x = nfc(_col(c)) if compose else _col(c)
    x = upper_plain(strip_accents(x))
    for greek, latin in (*DIGRAPHS, *LONG_LETTERS):
        x = F.replace(x, F.lit(greek), F.lit(latin))
    return F.translate(x, LETTERS_GREEK, LETTERS_LATIN)


def similarity(a: Column | str, b: Column | str, unit: str = "bytes") -> Column:
    """1 - edits / longer length, of trimmed upper-cased text. Edits count
    characters; the length counts bytes by default, which is how published
    results were made, or characters with unit="chars"."""
    return similarity_prepared(*(upper_plain(trim_space(x)) for x in (a, b)), unit)


def similarity_prepared(a: Column, b: Column, unit: str = "bytes") -> Column:
    """similarity of text that is trimmed and upper-cased already."""
    size = F.octet_length if unit == "bytes" else F.char_length
    near = 1 - F.levenshtein(a, b) / F.greatest(size(a), size(b))
    return F.when(a == b, F.lit(1.0)).when((a == "") | (b == ""), F.lit(0.0)).otherwise(near)


def name_key(c: Column | str) -> Column:
    """Normalised upper case without blanks, dots and hyphens."""
    return F.regexp_replace(upper_plain(normalize_text(c)), r"[ .\-]", "")


def name_similarity_squeezed(a: Column | str, b: Column | str, unit: str = "bytes") -> Column:
    """The better of transliterated and raw similarity of name keys (validation)."""
    a, b = name_key(a), name_key(b)
    return F.greatest(similarity(transliterate(a), transliterate(b), unit), similarity(a, b, unit))


def name_similarity_spaced(a: Column | str, b: Column | str, unit: str = "bytes") -> Column:
    """The same with blanks kept (catalog fill)."""
    a, b = normalize_text(a), normalize_text(b)
    return F.greatest(similarity(transliterate(a), transliterate(b), unit), similarity(a, b, unit))


def source_name_score(name: Column | str, *others: Column | str) -> Column:
    """Best transliterated similarity to any of several names (record linkage)."""
    scores = [similarity(transliterate(name), transliterate(o)) for o in others]
    return F.greatest(*scores) if len(scores) > 1 else scores[0]


def clean_field(c: Column | str) -> Column:
    """Normalised upper case without punctuation at the ends."""
    return F.regexp_replace(upper_plain(normalize_text(c)), rf"^[{TRIM_SIGNS}]+|[{TRIM_SIGNS}]+$", "")


def normalize_line(c: Column | str) -> Column:
    """Upper case, trimmed, with ΤΗΛ., ΤΗΛ: and ΤΗΛ/ written ΤΗΛ."""
    return F.regexp_replace(trim_space(upper_plain(c)), "ΤΗΛ[.:/]", "ΤΗΛ")


def strip_tags(c: Column | str, named_entities: bool = True) -> Column:
    """Tags become blanks, ends are trimmed, entities are decoded last."""
    x = trim_space(F.regexp_replace(_col(c), "<[^>]+>", " "))
    return unescape_entities(x) if named_entities else basic_entities(x)


def basic_entities(c: Column | str) -> Column:
    """The five predefined entities, without Python."""
    x = _col(c)
    for entity, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        x = F.replace(x, F.lit(entity), F.lit(sign))
    return x


def extract_phone(c: Column | str, strict: bool = False) -> Column:
    """The last ten of the first ten or eleven digits after blanks are dropped.
    A house number right before the number glues on; strict=True looks for a
    number that stands apart instead."""
    if strict:
        spaced = F.regexp_extract(_col(c), r"(?<!\d)(2\d{9}|2\d{4} \d{5})(?!\d)", 1)
        return F.replace(spaced, F.lit(" "), F.lit(""))
    return F.right(F.regexp_extract(F.replace(_col(c), F.lit(" "), F.lit("")), r"\d{10,11}", 0), F.lit(10))


def pad2(c: Column | str) -> Column:
    x = _col(c)
    return F.when(F.char_length(x) == 1, F.concat(F.lit("0"), x)).otherwise(x)


def is_digits(c: Column | str) -> Column:
    return _col(c).rlike("^[0-9]+$")


def count_digits(c: Column | str) -> Column:
    return F.regexp_count(_col(c), F.lit("[0-9]"))


def clamp(c: Column | str, low: Column, high: Column) -> Column:
    return F.least(F.greatest(_col(c), low), high)


def option_key(c: Column | str) -> Column:
    """c<number> to the number, none to -1, anything else to null."""
    x = F.lower(trim_space(c))
    number = F.regexp_extract(x, r"^c(\d{1,9})$", 1)
    return F.when(x == "none", F.lit(-1)).when(number != "", number.try_cast("int"))


def first_non_empty(*cs: Column | str) -> Column:
    """The first that is neither null nor empty, else the empty string."""
    return F.coalesce(*(F.nullif(_col(c), F.lit("")) for c in cs), F.lit(""))
