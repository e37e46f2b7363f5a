"""Text functions as Column -> Column, without UDFs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space, with the four separators that most tools strip as well.
WHITE = r"\p{IsWhite_Space}\x{1C}-\x{1F}"
#: White space and zero-width characters.
UNSEEN = WHITE + r"\x{200B}\x{FEFF}"


def strip(c: Column) -> Column:
    """Remove outer Unicode white space; null stays null."""
    return F.regexp_replace(c, rf"^[{WHITE}]+|[{WHITE}]+$", "")


def squeeze(c: Column) -> Column:
    """Remove outer white space and reduce inner runs to one space; null stays null."""
    return F.regexp_replace(strip(c), rf"[{WHITE}]+", " ")


def fold_key(c: Column) -> Column:
    """Squeezed lower case, for keys that are compared; null stays null."""
    return F.lower(squeeze(c))


def is_blank(c: Column) -> Column:
    """True for null and for texts of nothing but white space and zero-width characters."""
    return c.isNull() | ~c.rlike(rf"[^{UNSEEN}]")


def chain(c: Column, *steps) -> Column:
    """Apply functions Column -> Column one after another."""
    return reduce(lambda done, step: step(done), steps, c)


def replaced(pattern: str, by: str):
    """A step for ``chain``."""
    return lambda c: F.regexp_replace(c, pattern, by)


def first_line(c: Column) -> Column:
    return F.substring_index(F.regexp_replace(c, r"\r\n?", "\n"), "\n", 1)


def truncated(c: Column, limit: int, mark: str = "…") -> Column:
    """At most ``limit`` characters, with a mark if there were more."""
    return F.when(F.length(c) > limit, F.concat(F.substring(c, 1, limit), F.lit(mark))).otherwise(c)


#: Ordered rules that turn a message into its pattern (fixed values): token and time rules come before plain numbers.
FINGERPRINT_RULES = (
    (r"eyJ[A-Za-z0-9_-]{5,}\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", "<JWT>"),
    (r"\?[^\s\"']+", "?<Q>"),
    (r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:[+-]\d{2}:?\d{2}|Z)?", "<TIME>"),
    (r"\b1[6-9]\d{11}\b", "<TIME_MS>"),
    (r"\b1[3-9]\d{9}\b", "<PHONE>"),
    (r"\b(?:\d{1,3}\.){3}\d{1,3}(?::\d+)?\b", "<IP>"),
    (r"\b[0-9A-HJKMNP-TV-Z]{26}\b", "<ULID>"),
    (r"(?i)\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\b", "<UUID>"),
    (r"(?i)\b[0-9a-f]{32}\b", "<HEX32>"),
    (r"(?i)\b[0-9a-f]{16}\b", "<HEX16>"),
    (r"\b\d{4,}\b", "<N>"),
)


def fingerprint(c: Column, most: int = 300) -> Column:
    """The pattern of a message's first line; null and empty give an empty pattern."""
    line = truncated(first_line(F.coalesce(c, F.lit(""))), most)
    steps = [replaced(p, by) for p, by in FINGERPRINT_RULES]
    return F.trim(chain(line, *steps, replaced(r"\s+", " ")))


def caller_place(c: Column) -> Column:
    """A caller's path without its line number."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"\.go:\d+", ".go:N")


_EDGE = r"[^\p{L}\p{N}_]"
#: Ordered masking rules (fixed values); numbers have to stand free of letters and digits. Identity numbers come before phones.
MASK_RULES = (
    (r"(https?://)[^:\s/@]+:[^@\s/]+@", "$1<CRED>@"),
    (rf"(^|{_EDGE})\d{{17}}[\dXx]($|{_EDGE})", "$1<ID_CARD>$2"),
    (rf"(^|{_EDGE})1[3-9]\d{{9}}($|{_EDGE})", "$1<PHONE>$2"),
    (r"[\p{L}\p{N}_.+-]+@[\p{L}\p{N}_.-]+\.[a-zA-Z]{2,}", "<EMAIL>"),
)
#: A signed web token (fixed value).
_JWT = r"\beyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"


def mask_tokens(c: Column) -> Column:
    """Replace signed web tokens by ``<JWT kid=... alg=...>`` from their header, or ``<JWT>`` if it can't be read."""

    def one(done: Column, token: Column) -> Column:
        encoded = F.translate(F.substring_index(token, ".", 1), "-_", "+/")
        header = F.try_validate_utf8(F.try_to_binary(encoded, F.lit("base64")).cast("string"))
        field = lambda name: F.coalesce(F.get_json_object(header, f"$.{name}"), F.lit("?"))
        named = F.concat(F.lit("<JWT kid="), field("kid"), F.lit(" alg="), field("alg"), F.lit(">"))
        readable = F.try_parse_json(header).isNotNull()
        return F.replace(done, token, F.when(readable, named).otherwise(F.lit("<JWT>")))

    return F.when(c.contains("eyJ"), F.aggregate(F.regexp_extract_all(c, F.lit(_JWT), F.lit(0)), c, one)).otherwise(c)


def mask(c: Column) -> Column:
    """Replace tokens, credentials in URLs, identity numbers, phones and emails; masking twice changes nothing."""
    steps = []
    for pattern, by in MASK_RULES:
        # numbers that share the character between them need a second pass
        steps += [replaced(pattern, by)] * (2 if _EDGE in pattern else 1)
    return chain(mask_tokens(c), *steps)


def words(c: Column) -> Column:
    """Lower-case search terms: runs of letters, digits and underscores; each Han character is a term."""
    # no Han character is below 2E80, which is quicker to see than by the script
    return F.regexp_extract_all(
        F.lower(F.coalesce(c, F.lit(""))), F.lit(r"[\p{L}\p{N}_&&[\x{0}-\x{2E7F}[^\p{IsHan}]]]++|\p{IsHan}"), F.lit(0)
    )


def snippet(text: Column, terms: Column, around: int = 80, head: int = 120) -> Column:
    """The text around the first place of the first of ``terms`` that it has, or its head; white space reduced."""
    term = F.get(F.filter(terms, lambda t: F.contains(F.lower(text), t)), F.lit(0))
    place = F.coalesce(F.position(term, F.lower(text)), F.lit(0))
    return snippet_at(text, F.coalesce(term, F.lit("")), place, around, head)


def snippet_at(text: Column, term: Column, place: Column, around: int = 80, head: int = 120) -> Column:
    """``snippet`` of a term whose place, from 1, is known; the text's head with place 0."""
    start = F.greatest(place - around, F.lit(1))
    part = F.when(place > 0, F.substring(text, start, place - start + F.length(term) + around)).otherwise(
        F.substring(text, F.lit(1), F.lit(head))
    )
    return F.trim(F.regexp_replace(part, r"\s+", " "))


def without_fences(c: Column) -> Column:
    """A reply without the code fence around its JSON."""
    return F.trim(F.regexp_replace(c, r"(?s)^\s*```(?:json)?\s*|\s*```\s*$", ""))


def without_tool_tags(c: Column) -> Column:
    """A reply without tool-call blocks, closed ones first and then a dangling one."""
    closed = F.regexp_replace(c, r"(?is)<tool_call>.*?</tool_call>", "")
    return F.trim(F.regexp_replace(closed, r"(?is)<tool_call>.*$", ""))


#: The digits of time-ordered identifiers (fixed value).
CROCKFORD = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"


def ulid_millis(c: Column) -> Column:
    """The milliseconds since 1970 in the first ten characters of a time-ordered identifier, or null."""
    digits = F.split(F.substring(F.upper(c), 1, 10), "")
    value = F.aggregate(
        digits, F.lit(0).cast("long"), lambda a, d: a * 32 + F.instr(F.lit(CROCKFORD), d).cast("long") - 1
    )
    return F.when(F.upper(c).rlike(f"^[{CROCKFORD}]{{26}}$"), value)


def byte_size(c: Column) -> Column:
    """Bytes of a size such as '500MB' or '1.5 GB'; null if it is none."""
    number = F.regexp_extract(F.upper(c), r"^\s*(\d+(?:\.\d+)?)\s*([KMGT]?)B?\s*$", 1)
    unit = F.regexp_extract(F.upper(c), r"^\s*(\d+(?:\.\d+)?)\s*([KMGT]?)B?\s*$", 2)
    power = F.when(unit == "", 0).otherwise(F.instr(F.lit("KMGT"), unit))
    return F.when(number != "", (number.try_cast("double") * F.pow(F.lit(1024.0), power)).cast("long"))


#: Patterns of what a message refers to: tickets, releases and nodes (fixed values of this project's tables).
REFERENCES = (r"OPS-\d+", r"[a-z]+-[a-z]+@\d+\.\d+\.\d+", r"node-[a-h]\d{2}")


def references(c: Column, patterns: tuple[str, ...] = REFERENCES) -> Column:
    """All distinct references in a text, in order of the patterns and then of their places."""
    found = [F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(p), F.lit(0)) for p in patterns]
    return F.array_distinct(F.flatten(F.array(*found)))


def heading(c: Column, default: Column) -> Column:
    """The first top heading of a Markdown text, or a default."""
    return F.coalesce(F.nullif(F.regexp_extract(c, r"(?m)^[ \t]*# ([^\r\n]+)", 1), F.lit("")), default)


def line_range(c: Column) -> Column:
    """``first`` and ``last`` of a range such as '3-17'; null if it is none or runs backwards."""
    first = F.regexp_extract(c, r"^\s*(\d{1,9})\s*-\s*(\d{1,9})\s*$", 1).try_cast("int")
    last = F.regexp_extract(c, r"^\s*(\d{1,9})\s*-\s*(\d{1,9})\s*$", 2).try_cast("int")
    return F.when(first <= last, F.struct(first.alias("first"), last.alias("last")))
