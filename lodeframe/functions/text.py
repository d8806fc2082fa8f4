"""Text normalisation and parsing as column expressions (and one driver-side query parser)."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

# ASCII punctuation and digits, as regular-expression classes.
PUNCTUATION = r"[!-/:-@\[-`{-~]"
DIGITS = r"[0-9]"
BRACKETED = r"[\(\[].*?[\)\]]"
# Letters of one base and marks behind it (Unicode's canonical decomposition), and the base that each folds to.
_PARTS = {chr(i): unicodedata.normalize("NFD", chr(i)) for i in range(0xC0, 0x2000)}
_BASES = {c: d[0] for c, d in _PARTS.items() if len(d) > 1 and all(unicodedata.category(x) == "Mn" for x in d[1:])}
ACCENTED, FOLDED = "".join(_BASES), "".join(_BASES.values())
# Letters that do not decompose and what exact search takes them for.
STROKED, PLAIN = "łŁđĐøØħĦıŧŦ", "lLdDoOhHitT"
LIGATURES = {"æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "ß": "ss"}


def collapse_spaces(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def strip_brackets(c: Column) -> Column:
    return F.regexp_replace(c, BRACKETED, "")


def searchable(c: Column) -> Column:
    """Lower case without bracketed groups, punctuation and digits; hyphens become spaces."""
    bare = F.translate(strip_brackets(F.lower(F.coalesce(c, F.lit("")))), "-’", " '")
    return collapse_spaces(F.regexp_replace(F.regexp_replace(bare, PUNCTUATION, ""), DIGITS, ""))


def without_accents(c: Column) -> Column:
    """Every letter as its base, without marks; texts of ASCII alone stay as they are."""
    return F.when(c.rlike(r"[^\x00-\x7F]"), F.regexp_replace(F.translate(c, ACCENTED, FOLDED), r"\p{Mn}+", "")).otherwise(c)


def folded(c: Column) -> Column:
    """Lower case with all letters folded to ASCII where they have a base: the key of exact ("precise") search."""
    plain = F.translate(without_accents(c), STROKED, PLAIN)
    for letter, two in LIGATURES.items():
        plain = F.replace(plain, F.lit(letter), F.lit(two))
    return F.lower(plain)


def client_searchable(c: Column) -> Column:
    """Like ``searchable``, but accents fold and only the first hyphen and curly apostrophe are replaced."""
    bare = F.regexp_replace(F.lower(without_accents(F.coalesce(c, F.lit("")))), BRACKETED, "")
    first = F.regexp_replace(F.regexp_replace(bare, r"^([^-]*)-", "$1 "), r"^([^’]*)’", "$1'")
    return collapse_spaces(F.regexp_replace(F.regexp_replace(first, PUNCTUATION, ""), DIGITS, ""))


def tokens(c: Column) -> Column:
    return F.filter(F.split(c, r"[^\p{L}\p{N}]+"), lambda t: t != "")


def has_all_tokens(document: Column, query: Column) -> Column:
    """Fuzzy search: every token of the query is a token of the document."""
    return F.size(F.array_except(query, document)) == 0


def int_list(c: Column) -> Column:
    """``[1, 2]`` as an array; the empty array for any other text."""
    return F.when(c.rlike(r"^\[(\d+, ?)*\d*\]$"), F.coalesce(F.from_json(c, "array<int>"), F.array().cast("array<int>"))).otherwise(F.array().cast("array<int>"))


def tag_parts(c: Column) -> Column:
    """Trimmed comma-separated parts of all () and [] groups, without repeats."""
    groups = F.regexp_extract_all(c, F.lit(r"\(([^()]+)\)|\[([^\[\]]+)\]"), F.lit(0))
    inner = F.transform(groups, lambda g: g.substr(F.lit(2), F.length(g) - 2))
    return F.array_distinct(F.flatten(F.transform(inner, lambda g: F.transform(F.split(g, ","), lambda t: F.trim(t)))))


def brace_number(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"\s?\{([^{}]+)\}", 1), F.lit(""))


def without_brace_number(c: Column) -> Column:
    return F.regexp_replace(c, r"^(.*?)\s?\{[^{}]+\}", "$1")


def without_tag(c: Column, tag: str | Column) -> Column:
    """c without a tag's occurrences inside brackets, however many, then without the brackets' leftovers."""
    tag = F.lit(tag) if isinstance(tag, str) else tag
    quoted = F.concat(F.lit(r"\Q"), F.replace(tag, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    # Each round takes one occurrence a bracket, so as many as the text holds of them leave none.
    times = F.greatest(F.regexp_count(c, quoted), F.lit(1))

    def once(text: Column, _: Column) -> Column:
        for left, inner, right in ((r"(\(", "[^()]*", r"\))"), (r"(\[", r"[^\[\]]*", r"\])")):
            text = F.regexp_replace(text, F.concat(F.lit(f"{left}{inner})"), quoted, F.lit(f",? *({inner}{right}")), F.lit("$1$2"))
        return text

    c = F.when(F.length(tag) > 0, F.aggregate(F.sequence(F.lit(1), times), c, once)).otherwise(c)
    for left, right in ((r"\(\s*\)", ""), (r"\[\s*\]", ""), (r"\[, ", "["), (r", ?\]", "]"), (r"\(, ", "("), (r", ?\)", ")")):
        c = F.regexp_replace(c, left, right)
    return collapse_spaces(c)


def without_copy_suffix(c: Column) -> Column:
    """Strips any number of trailing ``(1)`` and ``- Copy``."""
    return F.regexp_replace(c, r"(?i)(\s*(\(\d+\)|-\s*copy)\s*)+$", "")


def interior_capital(c: Column) -> Column:
    return strip_brackets(c).rlike(r"^\s*\p{L}+\s*$") & F.trim(strip_brackets(c)).rlike(r"^.+\p{Lu}")


def language_prefix(c: Column) -> Column:
    """XX of ``{XX} name``, else null."""
    return F.nullif(F.regexp_extract(c, r"^\{([^{}]+)\} ", 1), F.lit(""))


def without_language(c: Column) -> Column:
    return F.regexp_replace(c, r"^\{[^{}]+\} ", "")


def extension(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"\.([^.]*)$", 1), F.lit(""))


def without_extension(c: Column) -> Column:
    return F.regexp_replace(c, r"\.[^.]*$", "")


def copyright_year(c: Column) -> Column:
    """The year behind a copyright sign or (c), else the first bare 19xx or 20xx."""
    signed = F.nullif(F.regexp_extract(c, r"(?i)(?:©|\(c\))\s*((?:19|20)\d\d)", 1), F.lit(""))
    bare = F.nullif(F.regexp_extract(c, r"(?:^|\D)((?:19|20)\d\d)(?:\D|$)", 1), F.lit(""))
    return F.coalesce(signed, bare)


def proxy_marker(c: Column) -> Column:
    return c.rlike(r"(?i)\bnot\s+for\s+sale\b|\bproxy\b|\bplaytest\b")


def artist_credit(c: Column) -> Column:
    """The name behind ``Illus.``, without a full stop at its end."""
    return F.nullif(F.rtrim(F.regexp_replace(F.regexp_extract(c, r"(?i)illus\.?\s*:?\s*([^\n|]+)", 1), r"[.\s]+$", "")), F.lit(""))


def boilerplate_key(c: Column, least: int = 12, density: float = 0.5) -> Column:
    """Letters and digits in lower case, or null if there are too few of them or too small a share."""
    key = F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    seen = F.length(F.regexp_replace(c, r"\s+", ""))
    return F.when((F.length(key) >= least) & (F.length(key) >= seen * density), key)


def calculator_family(c: Column) -> Column:
    """The part before a version suffix ``-vN``, else null."""
    return F.nullif(F.regexp_extract(c, r"^(.+)-v\d+$", 1), F.lit(""))


def agent_key(c: Column) -> Column:
    return F.coalesce(calculator_family(c), c)


# Words that declare an attribute in a name, the tag of each, and the tags of which one alone can hold.
DECLARATIONS: dict[str, str] = {
    "Full Art": r"\bfull[\s-]?art\b",
    "Borderless": r"\bborderless\b",
    "Showcase": r"\bshowcase\b",
    "Extended": r"\bextended\b",
    "Etched": r"\betched\b(?!\s+(?:champion|oracle|monstrosity)\b)",
    "Black Border": r"\bblack[\s-]border(?:ed)?\b",
    "White Border": r"\bwhite[\s-]border(?:ed)?\b",
    "Silver Border": r"\bsilver[\s-]border(?:ed)?\b",
    "Old Border": r"\b(?:retro|old[\s-](?:frame|border(?:ed)?))\b",
    "Future Frame": r"\bfuture[\s-]?(?:shift(?:ed)?|frame)\b",
}
EXCLUSIVE = ("Black Border", "Borderless", "Silver Border", "White Border")


def declared_tags(c: Column) -> Column:
    """Tags that a name declares; a "no", "not" or "without" before a word cancels it, and contradicting borders cancel each other."""
    found = F.array_compact(F.array(*[F.when(c.rlike(rf"(?i)(?<!\b(?:no|not|without)\s{{1,4}}){p}"), F.lit(t)) for t, p in DECLARATIONS.items()]))
    borders = F.array(*[F.lit(t) for t in EXCLUSIVE])
    return F.when(F.size(F.array_intersect(found, borders)) > 1, F.array_except(found, borders)).otherwise(found)


# Start and factor of the 32-bit FNV-1a hash.
FNV_START, FNV_FACTOR = 0x811C9DC5, 0x01000193


def fnv1a(text: str) -> int:
    """32-bit FNV-1a over the UTF-16 code units of one string."""
    h, raw = FNV_START, text.encode("utf-16-be", "surrogatepass")
    for k in range(0, len(raw), 2):
        h = ((h ^ int.from_bytes(raw[k : k + 2])) * FNV_FACTOR) & 0xFFFFFFFF
    return h


def fnv1a_hash(c: Column) -> Column:
    """``fnv1a`` of a column: a fold over its code units that wraps at 32 bits; null stays null."""
    units = F.transform(F.regexp_extract_all(F.hex(F.encode(c, "UTF-16BE")), F.lit("[0-9A-F]{4}"), F.lit(0)), lambda u: F.conv(u, 16, 10).cast("long"))
    return F.aggregate(units, F.lit(FNV_START).cast("long"), lambda h, u: (h.bitwiseXOR(u) * FNV_FACTOR).bitwiseAND(F.lit(0xFFFFFFFF)))


def query_key(card_type: Column, query: Column, expansion: Column, number: Column) -> Column:
    """The hash by which clients know a search, as text; what is null is the word null."""
    none = lambda c: F.coalesce(c, F.lit("null"))
    return fnv1a_hash(F.concat(F.lit("cardType="), card_type, F.lit("\n  &query="), none(query), F.lit("\n  &expansionCode="), none(expansion), F.lit("\n  &collectorNumber="), none(number))).cast("string")


# --- query syntax -----------------------------------------------------------------------------

# Operator names and their aliases.
OPERATORS = {"artist": "artist", "a": "artist", "border": "border", "frame": "frame", "tag": "tag", "set": "set", "lang": "lang"}
_WORD = re.compile(r'(-?)([A-Za-z]+):(?:"([^"]*)"|(\S+))|\S+')


@dataclass(frozen=True)
class Term:
    operator: str
    value: str
    negated: bool = False


@dataclass(frozen=True)
class Query:
    text: str
    terms: list[Term] = field(default_factory=list)
    errors: list[str] = field(default_factory=list)


def parse_query(raw: str | None) -> Query:
    """Free text, operator terms and unknown operators of one query string, each in its order."""
    text, terms, errors = [], [], []
    for m in _WORD.finditer(raw or ""):
        if not m[2]:
            text.append(m[0])
        elif (name := OPERATORS.get(m[2].lower())) is None:
            errors.append(m[2])
        else:
            terms.append(Term(name, m[3] if m[3] is not None else m[4], bool(m[1])))
    return Query(" ".join(text), terms, errors)


def query_terms(c: Column) -> Column:
    """The batch form of the parser: array of (negated, operator, value) of known operators in a text column."""
    words = F.regexp_extract_all(c, F.lit(r'(?<!\S)-?[A-Za-z]+:(?:"[^"]*"|\S+)'), F.lit(0))
    names = F.create_map(*[F.lit(x) for pair in OPERATORS.items() for x in pair])

    def parts(w: Column) -> Column:
        value = F.regexp_replace(w, r"^-?[A-Za-z]+:", "")
        return F.struct(
            w.startswith("-").alias("negated"),
            F.try_element_at(names, F.lower(F.regexp_extract(w, r"^-?([A-Za-z]+):", 1))).alias("operator"),
            F.regexp_replace(value, r'^"([^"]*)"$', "$1").alias("value"),
        )

    return F.filter(F.transform(words, parts), lambda t: t["operator"].isNotNull())


def residual_text(c: Column) -> Column:
    return collapse_spaces(F.regexp_replace(c, r'(?<!\S)-?[A-Za-z]+:(?:"[^"]*"|\S+)', " "))


# --- decklists ----------------------------------------------------------------------------------


# The token of an image in a line of text, and the mark of one at a face's end.
IMAGE_TOKEN = r"\[mpc:([A-Za-z0-9_-]+)\]"
IMAGE_MARK = r"@([A-Za-z0-9_-]+)\s*$"


def deck_line(c: Column) -> Column:
    """(quantity, kind, front, front_id, back, back_id, set_code, number) of ``2x t:front@id // back@id (SET) 12``.

    Quantity is 1 by default.  A face's image is a token in brackets anywhere in it or, without one, what
    follows an @ at its end.
    """
    line = collapse_spaces(c)
    rest = F.regexp_replace(line, r"^\d+\s*[xX]?\s+", "")
    kind = F.lower(F.nullif(F.regexp_extract(rest, r"^([tTbB]):", 1), F.lit("")))
    body = F.regexp_replace(rest, r"^[tTbB]:", "")
    printing = r"\s*\(([A-Za-z0-9]{2,6})\)(?:\s+(\S+))?\s*$"
    name = F.regexp_replace(body, printing, "")

    def face(part: Column, label: str) -> list[Column]:
        bare = F.trim(F.regexp_replace(part, IMAGE_TOKEN, ""))
        token, mark = (F.nullif(F.regexp_extract(x, p, 1), F.lit("")) for x, p in ((part, IMAGE_TOKEN), (bare, IMAGE_MARK)))
        return [F.nullif(F.trim(F.regexp_replace(bare, IMAGE_MARK, "")), F.lit("")).alias(label), F.coalesce(token, mark).alias(f"{label}_id")]

    return F.struct(
        F.coalesce(F.nullif(F.regexp_extract(line, r"^(\d+)\s*[xX]?\s+\S", 1), F.lit("")).cast("int"), F.lit(1)).alias("quantity"),
        F.when(kind == "t", "TOKEN").when(kind == "b", "CARDBACK").otherwise("CARD").alias("kind"),
        *face(F.regexp_extract(name, r"^(.*?)(?:\s*(?://|\|)\s*.*)?$", 1), "front"),
        *face(F.regexp_extract(name, r"(?://|\|)\s*(.*)$", 1), "back"),
        F.upper(F.nullif(F.regexp_extract(body, printing, 1), F.lit(""))).alias("set_code"),
        F.nullif(F.regexp_extract(body, printing, 2), F.lit("")).alias("number"),
    )


# Language marks that follow a set code.
LANGUAGE_MARKS = "EN|FR|DE|ES|IT|PT|JA|KO|RU|ZH"


def collector_line(c: Column) -> Column:
    """(number, set_code) of a line of small print: the first number, then the first code of 3 to 5 letters or digits behind it, else before it.

    A code of digits alone, the number itself, a code behind a slash (a denominator with its rarity) and
    a language mark are no set codes.
    """
    number = F.lower(F.nullif(F.regexp_extract(c, r"(?<![A-Za-z0-9])(\d{1,4}[a-zA-Z]?)(?![A-Za-z0-9])", 1), F.lit("")))
    at = F.regexp_instr(c, F.lit(r"(?<![A-Za-z0-9])\d{1,4}[a-zA-Z]?(?![A-Za-z0-9])"))
    behind = F.when(number.isNotNull(), c.substr(at + F.length(number), F.length(c)))
    before = F.when(number.isNotNull(), c.substr(F.lit(1), at - 1))

    def code(part: Column) -> Column:
        words = F.regexp_extract_all(part, F.lit(r"(?<![A-Za-z0-9/])[A-Za-z0-9]{3,5}(?![A-Za-z0-9])"), F.lit(0))
        return F.lower(F.try_element_at(F.filter(words, lambda w: ~w.rlike(r"^\d+$") & ~F.upper(w).rlike(f"^({LANGUAGE_MARKS})$") & (F.lower(w) != number)), F.lit(1)))

    return F.struct(number.alias("number"), F.coalesce(code(behind), code(before)).alias("set_code"))
