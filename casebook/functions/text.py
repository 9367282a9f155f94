"""Text predicates and scalar expressions shared by the operators."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, functions as F

from casebook.functions import lexicons as lx

_SPACE = r"(?U)[\s\x1c-\x1f]"
_META = r"([\\^$.\[\]()|*+?{}\-#&~/'\"!@%=:;,<>`])"


def strip(text: Column) -> Column:
    """Remove every kind of whitespace from both ends."""
    return F.regexp_replace(text, rf"(?U)\A[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", "")


def collapse(text: Column) -> Column:
    """Single spaces between words, none at the ends."""
    return F.trim(F.regexp_replace(text, f"{_SPACE}+", " "))


def is_blank(text: Column) -> Column:
    return text.isNull() | ~text.rlike(r"(?U)[^\s\x1c-\x1f]")


def escape_literal(text: Column) -> Column:
    """Escape everything a regular expression would read as an operator."""
    return F.regexp_replace(text, _META, r"\\$1")


def word_pattern(term: Column) -> Column:
    return F.concat(F.lit(r"(?U)\b"), escape_literal(term), F.lit(r"\b"))


def keyword_present(term: Column, text_lower: Column) -> Column:
    """Whole-word match for one token, substring match for a phrase; both sides lower case."""
    return F.when(F.contains(term, F.lit(" ")), F.contains(text_lower, term)).otherwise(
        F.rlike(text_lower, word_pattern(term))
    )


def word_list_pattern(words) -> str:
    """One alternation for a word list: tokens bounded, phrases anywhere."""
    tokens = [w.replace("-", r"\-") for w in words if " " not in w]
    phrases = [w for w in words if " " in w]
    parts = [r"\b(?:" + "|".join(tokens) + r")\b"] if tokens else []
    return "(?U)" + "|".join(parts + phrases)


def holds_any(text: Column, words) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])


def mentions(text_lower: Column, words) -> Column:
    """Any word of the list; the pattern runs only on texts that hold one as a string."""
    found = text_lower.rlike(word_list_pattern(words))
    literal = all(re.fullmatch(r"[\w '-]+", w) for w in words)
    return holds_any(text_lower, words) & found if literal else found


def label_of(attribute: Column) -> Column:
    """Display label of an attribute name, itself when unlisted."""
    table = F.create_map(*[F.lit(x) for pair in lx.ATTRIBUTE_LABELS.items() for x in pair])
    return F.coalesce(F.try_element_at(table, attribute), attribute)


def join_labels(attributes: Column) -> Column:
    return F.array_join(F.transform(attributes, label_of), ", ")


def iso_utc(value: Column) -> Column:
    """ISO-8601 second precision with Z; naive timestamps count as UTC."""
    return F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def event_day(text: Column) -> Column:
    """Date of a full ISO date or timestamp string; partial or invalid dates give null."""
    head = F.substring(strip(text), 1, 10)
    return F.when(head.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(head, "yyyy-MM-dd"))


def event_uuid(source_type: Column, source_id: Column, event_type: Column) -> Column:
    """Name-based (version 5) identifier of a timeline event in the URL namespace."""
    name = F.concat(
        F.lit("timeline:"), source_type, F.lit(":"), source_id.cast("string"), F.lit(":"), event_type
    )
    digest = F.sha1(F.concat(F.unhex(F.lit(lx.URL_NAMESPACE_HEX)), F.encode(name, "UTF-8")))
    variant = F.substring(F.lit("89ab"), F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") % 4 + 1, F.lit(1))
    return F.concat_ws(
        "-",
        F.substring(digest, 1, 8),
        F.substring(digest, 9, 4),
        F.concat(F.lit("5"), F.substring(digest, 14, 3)),
        F.concat(variant, F.substring(digest, 18, 3)),
        F.substring(digest, 21, 12),
    )


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body refers to it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def unit_vector(vector: Column) -> Column:
    """Vector scaled to length one, in doubles; a zero vector gives nulls."""
    wide = F.transform(vector, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(wide, F.lit(0.0), lambda acc, x: acc + x * x))
    return let(norm, lambda n: F.transform(wide, lambda x: F.try_divide(x, n)))


def dot(left: Column, right: Column) -> Column:
    return F.aggregate(F.zip_with(left, right, lambda a, b: a * b), F.lit(0.0), lambda acc, x: acc + x)


def similarity(distance: Column) -> Column:
    return F.greatest(F.lit(0.0), F.nanvl(1.0 - distance, F.lit(0.0)))


def age_years(birth: Column, today: Column) -> Column:
    before_birthday = F.struct(F.month(today), F.dayofmonth(today)) < F.struct(F.month(birth), F.dayofmonth(birth))
    return F.year(today) - F.year(birth) - before_birthday.cast("int")


def mask_to_list(names: Column, mask: Column) -> Column:
    """Names whose bit is set, in list order."""
    return F.filter(names, lambda _, i: F.getbit(mask, i) == 1)


def list_to_mask(names: Column, holds) -> Column:
    """Bit i is set when ``holds(names[i])``."""
    bits = F.transform(names, lambda a, i: F.when(holds(a), F.call_function("shiftleft", F.lit(1), i)).otherwise(0))
    return F.aggregate(bits, F.lit(0), lambda acc, b: acc.bitwiseOR(b))
