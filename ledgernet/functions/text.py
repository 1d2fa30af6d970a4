"""Identifier, label and document expressions."""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgernet import vocabulary as V


def node_id(node_type: str, key: Column) -> Column:
    return F.concat(F.lit(f"{node_type}::"), key.cast("string"))


def join_id(*parts: Column) -> Column:
    """Parts of a composite node key joined to one id."""
    return F.concat_ws("::", *[p.cast("string") for p in parts])


def nonblank(text: Column) -> Column:
    """The text, or null where it is empty."""
    return F.nullif(text, F.lit(""))


def label(nome: Column, descricao: Column, numero: Column, original_id: Column, id_: Column) -> Column:
    """First non-empty of the columns that can name a node."""
    return F.coalesce(*[nonblank(c) for c in (nome, descricao, numero, original_id)], id_)


def digits(text: Column) -> Column:
    return F.regexp_replace(text, r"\D", "")


def mask_document(document: Column) -> Column:
    """Hide most digits of a tax number; the pattern depends on how many it has."""
    d = digits(document)
    n = F.length(d)
    person = F.concat(F.lit("***."), F.substring(d, 4, 3), F.lit(".***-"), F.right(d, F.lit(2)))
    company = F.concat(
        F.lit("**."), F.substring(d, 3, 3), F.lit(".***/*"), F.substring(d, 9, 4), F.lit("-"), F.right(d, F.lit(2))
    )
    other = F.concat(F.repeat(F.lit("*"), n - 4), F.right(d, F.lit(4)))
    return F.when(document.isNull() | (document == ""), document).otherwise(
        F.when(n == 11, person).when(n == 14, company).when(n >= 4, other).otherwise(F.lit("***"))
    )


@lru_cache(maxsize=1)
def _ascii_tables() -> tuple[str, str, dict[str, str]]:
    """Compatibility decompositions, of all code points, that leave ASCII characters.

    The first two strings pair characters that become one ASCII character, the
    mapping holds those that become several (ligatures, numerals in brackets).
    """
    source, target, wide = [], [], {}
    for char in map(chr, range(0x80, sys.maxunicode + 1)):
        if not unicodedata.decomposition(char):
            continue
        ascii_part = "".join(c for c in unicodedata.normalize("NFKD", char) if c.isascii())
        if len(ascii_part) == 1:
            source.append(char)
            target.append(ascii_part)
        elif ascii_part:
            wide[char] = ascii_part
    return "".join(source), "".join(target), wide


def _may_widen(text: Column) -> Column:
    """Whether the text can hold a character that widens: a coarse range is quick to scan."""
    wide = sorted(_ascii_tables()[2])
    latin = [c for c in wide if c < "\u0100"]
    rest = wide[len(latin) :]
    return text.rlike(f"[{latin[0]}-{latin[-1]}{rest[0]}-{rest[-1]}]")


def ascii_fold(text: Column) -> Column:
    """Strip accents and drop what has no ASCII form, as compatibility decomposition does."""
    source, target, wide = _ascii_tables()
    # Characters that widen are rare: only rows holding one pay for the lookup.
    table = F.str_to_map(F.lit("\x02".join(f"{k}\x01{v}" for k, v in wide.items())), F.lit("\x02"), F.lit("\x01"))
    widened = F.array_join(
        F.transform(F.split(text, ""), lambda c: F.coalesce(F.element_at(table, c), c)), ""
    )
    expanded = F.when(_may_widen(text), widened).otherwise(text)
    folded = F.regexp_replace(F.translate(expanded, source, target), r"[^\x00-\x7F]", "")
    return F.when(text.rlike(r"[^\x00-\x7F]"), folded).otherwise(text)


def slugify(text: Column) -> Column:
    """Lower-case ASCII words joined by hyphens; null gives the empty string."""
    words = F.regexp_replace(F.lower(ascii_fold(text)), "[^a-z0-9]+", "-")
    return F.coalesce(F.btrim(words, F.lit("-")), F.lit(""))


def stable_key(*parts: Column) -> Column:
    """The non-empty parts that identify a record, joined."""
    return F.concat_ws("::", *[nonblank(p) for p in parts])


def joined_slugs(*slugs: Column) -> Column:
    """The slug of a stable key from the slugs of its parts, of which several keys may share some."""
    return F.concat_ws("-", *[nonblank(s) for s in slugs])


def written_text(value: Column) -> Column:
    """The text of a JSON string, null for any other kind of value."""
    return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string"))


def truthy_text(value: Column) -> Column:
    """A JSON text or number as text; null for what counts as absent: null, false, the number zero, empty text."""
    text = F.try_variant_get(value, "$", "string")
    kind = F.schema_of_variant(value)
    absent = (text == "") | (kind.isin("VOID", "NULL")) | ((kind == "BOOLEAN") & (text == "false"))
    zero = (kind != "STRING") & F.coalesce(text.try_cast("double") == 0, F.lit(False))
    return F.when(~(absent | zero), text)


def id_of_key(prefix: str, key: Column, slug: Column | None = None) -> Column:
    """Readable id of a stable key: prefix, slug, short hash. ``slug`` may be given."""
    slug = F.regexp_replace(slugify(key) if slug is None else slug, "^$", V.EMPTY_SLUG)
    return F.when(key == "", F.lit(f"{prefix}-{V.UNKNOWN_ID}")).otherwise(
        F.concat_ws("-", F.lit(prefix), slug, F.substring(F.sha1(key), 1, 10))
    )


def stable_id(prefix: str, *parts: Column) -> Column:
    """Id that depends only on the non-empty parts.

    The key occurs several times in it: over many rows make the key a column first
    and use ``id_of_key``.
    """
    return id_of_key(prefix, stable_key(*parts))


def contains_text(needle: str, *columns: Column) -> Column:
    """Case-folded substring test over several columns."""
    wanted = F.lit(needle.lower())
    hit = F.lit(False)
    for column in columns:
        hit = hit | F.coalesce(F.contains(F.lower(column), wanted), F.lit(False))
    return hit
