"""Text, name and address normalisation as column expressions; the SQL twins serve as oracles.

Letters of other scripts are romanised by tables (Indic scripts and kana by rule from Unicode names, Cyrillic and Greek by letter), and letters
with marks are reduced to ASCII by a table built from Unicode decompositions; what is still not ASCII becomes a space. Texts without such letters skip
these steps.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from kinmesh.functions.vocabulary import ADDRESS_WORDS, DOMAIN_WORDS, GENERIC_ADDRESS, LEGAL_SUFFIXES

#: Latin letters that have no decomposition, and what they are written as.
LATIN_SPECIAL = {"ß": "ss", "œ": "oe", "æ": "ae", "Œ": "OE", "Æ": "AE", "þ": "th", "Þ": "Th", "ø": "o", "Ø": "O", "đ": "d", "Đ": "D", "ð": "d", "Ð": "D", "ł": "l", "Ł": "L", "ı": "i"}


def _latin_table() -> tuple[str, str]:
    marked = [chr(i) for i in range(0xC0, 0x250)] + [chr(i) for i in range(0x1E00, 0x1F00)]
    pairs = [(c, b[0]) for c in marked for b in [unicodedata.normalize("NFKD", c)] if b != c and b[0].isascii() and b[0].isalpha() and all(unicodedata.combining(x) for x in b[1:])]
    pairs += [(c, b) for c, b in LATIN_SPECIAL.items() if len(b) == 1]
    return "".join(c for c, _ in pairs), "".join(b for _, b in pairs)


_MARKED, _PLAIN = _latin_table()


def _let(c: Column, f) -> Column:
    """f of a column that is computed once."""
    return F.transform(F.array(c), f)[0]


def _if_any(c: Column, pattern: str, f) -> Column:
    """f of the texts in which the pattern is found; others stay."""
    return _let(c, lambda x: F.when(x.rlike(pattern), f(x)).otherwise(x))


def _without_marks(c: Column) -> Column:
    for letter, written in LATIN_SPECIAL.items():
        if len(written) > 1:
            c = F.replace(c, F.lit(letter), F.lit(written))
    return F.regexp_replace(F.translate(c, _MARKED, _PLAIN), r"\p{M}+", "")


def to_ascii(c: Column) -> Column:
    """Latin letters without their marks."""
    return _if_any(c, r"[^\x00-\x7F]", _without_marks)


# How letters of two alphabets are written, in alphabetical order.
CYRILLIC = dict(zip("абвгдеёжзийклмнопрстуфхцчшщъыьэюя", "a b v g d e e zh z i i k l m n o p r s t u f kh ts ch sh shch - y - e iu ia".replace("-", "").split(" "), strict=True))
GREEK = dict(zip("αβγδεζηθικλμνξοπρσςτυφχψω", "a b g d e z e th i k l m n x o p r s s t u ph kh ps o".split(" "), strict=True))

#: Marks in romanised Indic text: a consonant's own vowel, and what takes its place.
_OWN, _INSTEAD = "\x01", "\x02"


def _indic(c: str) -> str:
    """How an Indic letter or sign is written, by its Unicode name."""
    _, _, rest = unicodedata.name(c, "").partition(" ")
    if rest.startswith("LETTER "):
        sound = rest[7:].split()[-1].lower()
        return sound[:-1] + _OWN if len(sound) > 1 and sound.endswith("a") and sound[0] not in "aeiou" else sound
    if rest.startswith("VOWEL SIGN"):
        return _INSTEAD + rest[11:].split()[-1].lower()
    if rest.startswith("DIGIT"):
        return str(unicodedata.digit(c))
    return _INSTEAD if rest.startswith("SIGN VIRAMA") else "n" if rest.startswith(("SIGN ANUSVARA", "SIGN CANDRABINDU")) else ""


def _script_table() -> dict[str, str]:
    table = {c: _indic(c) for i in range(0x0900, 0x0E00) if unicodedata.name(c := chr(i), "")}
    for i in (*range(0x3041, 0x3097), *range(0x30A1, 0x30FB)):
        table[chr(i)] = unicodedata.name(chr(i)).split()[-1].lower()
    for letters in (CYRILLIC, GREEK):
        for c, written in letters.items():
            table[c] = table[c.upper()] = written
            for i in (*range(0x0370, 0x0400), *range(0x0400, 0x0460), *range(0x1F00, 0x2000)):
                if chr(i) not in table and unicodedata.normalize("NFKD", chr(i))[0] in (c, c.upper()):  # with marks
                    table[chr(i)] = written
    return table


_SCRIPTS = _script_table()
_IN_SCRIPTS = r"[\u0370-\u045F\u0900-\u0DFF\u1F00-\u1FFF\u3041-\u30FA]"


def _in_latin(c: Column) -> Column:
    table = F.str_to_map(F.lit("\x03".join(f"{k}\x04{v}" for k, v in _SCRIPTS.items())), F.lit("\x03"), F.lit("\x04"))
    written = F.array_join(F.transform(F.split(c, ""), lambda x: F.coalesce(F.try_element_at(table, x), x)), "")
    return F.translate(F.replace(F.replace(written, F.lit(_OWN + _INSTEAD), F.lit("")), F.lit(_OWN), F.lit("a")), _INSTEAD, "")


def romanise(c: Column) -> Column:
    """Indic scripts, kana, Cyrillic and Greek in Latin letters; other text is left as it is."""
    return _if_any(c, _IN_SCRIPTS, _in_latin)


def romanise_text(text: str) -> str:
    """The same for one string."""
    written = "".join(_SCRIPTS.get(c, c) for c in text)
    return written.replace(_OWN + _INSTEAD, "").replace(_OWN, "a").replace(_INSTEAD, "")


def leet_fix(c: Column) -> Column:
    """A zero between letters is an o, a one an l."""
    return F.regexp_replace(F.regexp_replace(c, "(?<=[a-z])0(?=[a-z])", "o"), "(?<=[a-z])1(?=[a-z])", "l")


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def clean_text(c: Column) -> Column:
    """Lower-case ASCII words parted by single spaces; null, '' and the literal null become ''."""
    c = F.when(c.isNull() | (F.lower(c) == "null"), "").otherwise(c)
    c = F.lower(to_ascii(romanise(c)))
    c = F.replace(F.replace(c, F.lit("&"), F.lit(" and ")), F.lit("@"), F.lit(" at "))
    c = leet_fix(F.translate(c, "-/.,'", "     "))
    return squeeze(F.regexp_replace(c, r"[^\w\s]", " "))


def normalize_number(c: Column) -> Column:
    """Without leading zeros; zeros alone are one zero."""
    return F.regexp_replace(c, "^0+(?=.)", "")


def tokens(cleaned: Column) -> Column:
    return F.filter(F.split(cleaned, " "), lambda t: t != "")


def root_tokens(cleaned: Column, strip_domain_words: bool = False) -> Column:
    """Words of a cleaned name without legal forms, or all of them if nothing else is left."""
    words = tokens(cleaned)
    if strip_domain_words:
        words = F.filter(words, lambda t: ~t.isin(*DOMAIN_WORDS))
    kept = F.filter(words, lambda t: ~t.isin(*LEGAL_SUFFIXES))
    return F.when(F.size(kept) > 0, kept).otherwise(words)


def address_runs(cleaned: Column) -> Column:
    """Runs of digits or letters of a cleaned address, abbreviations written out."""
    long_form = F.create_map(*[F.lit(x) for pair in ADDRESS_WORDS.items() for x in pair])
    return F.transform(F.regexp_extract_all(cleaned, F.lit(r"(\d+|[a-z]+)"), 1), lambda t: F.coalesce(F.try_element_at(long_form, t), t))


def address_numbers(runs: Column) -> Column:
    """Distinct numbers of at least two digits without leading zeros."""
    return F.array_distinct(F.filter(F.transform(F.filter(runs, lambda t: t.rlike("^[0-9]")), normalize_number), lambda t: F.length(t) >= 2))


def address_words(runs: Column) -> Column:
    """Telling words in order, repeats kept."""
    return F.filter(runs, lambda t: ~t.rlike("^[0-9]") & (F.length(t) >= 4) & ~t.isin(*GENERIC_ADDRESS))


# The same in DuckDB SQL. Its pattern engine has no look-around, so overlapping captures are replaced twice.


def sql_list(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


def sql_leet(x: str) -> str:
    for digit, letter in (("0", "o"), ("1", "l")):
        for _ in range(2):
            x = f"regexp_replace({x}, '([a-z]){digit}([a-z])', '\\1{letter}\\2', 'g')"
    return x


def sql_ascii(x: str) -> str:
    for letter, written in LATIN_SPECIAL.items():
        x = f"replace({x}, '{letter}', '{written}')"
    return f"strip_accents({x})"


def sql_squeeze(x: str) -> str:
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


def sql_clean(x: str) -> str:
    x = f"case when {x} is null or lower({x}) = 'null' then '' else {x} end"
    x = f"replace(replace(lower({sql_ascii(x)}), '&', ' and '), '@', ' at ')"
    x = sql_leet(f"translate({x}, '-/.,''', '     ')")
    return sql_squeeze(f"regexp_replace({x}, '[^0-9A-Za-z_\\s]', ' ', 'g')")


def sql_tokens(x: str) -> str:
    return f"list_filter(string_split({x}, ' '), lambda t: t <> '')"


def sql_root(x: str, strip_domain_words: bool = False) -> str:
    words = sql_tokens(x)
    if strip_domain_words:
        words = f"list_filter({words}, lambda t: t not in ({sql_list(DOMAIN_WORDS)}))"
    kept = f"list_filter({words}, lambda t: t not in ({sql_list(LEGAL_SUFFIXES)}))"
    return f"case when len({kept}) > 0 then {kept} else {words} end"


def sql_runs(x: str) -> str:
    whens = " ".join(f"when '{k}' then '{v}'" for k, v in ADDRESS_WORDS.items())
    return f"list_transform(regexp_extract_all({x}, '[0-9]+|[a-z]+'), lambda t: case t {whens} else t end)"


def sql_number(x: str) -> str:
    return f"case when ltrim({x}, '0') = '' then left({x}, 1) else ltrim({x}, '0') end"


def sql_numbers(runs: str) -> str:
    return f"list_distinct(list_filter(list_transform(list_filter({runs}, lambda t: regexp_matches(t, '^[0-9]')), lambda t: {sql_number('t')}), lambda t: length(t) >= 2))"


def sql_words(runs: str) -> str:
    return f"list_filter({runs}, lambda t: not regexp_matches(t, '^[0-9]') and length(t) >= 4 and t not in ({sql_list(GENERIC_ADDRESS)}))"
