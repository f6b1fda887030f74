"""Text functions as Column expressions: cleaning, folding, keys, flags."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as yes and as no.
YES = ("si", "true", "1", "incluido", "disponible", "apto")
NO = ("no", "false", "0", "sin", "no_apto")


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def filled(text: Column) -> Column:
    """text, or null if it is empty. nullif() in a lambda would work out its argument twice."""
    return F.when(text != "", text)


def found(text: Column, pattern: str, group: int = 0) -> Column:
    """The first match, or null: regexp_extract itself gives an empty string for none."""
    return once(filled, F.regexp_extract(text, pattern, group))


def clean_text(c: Column | str) -> Column:
    """White space, of Unicode too, collapsed; empty becomes null."""
    return once(filled, F.trim(F.regexp_replace(col(c), r"(?U)\s+", " ")))


def plain_text(c: Column | str) -> Column:
    """clean_text() of what is left without tags, for strings that may hold markup; the usual entities decoded."""
    text = F.regexp_replace(col(c), r"(?s)<!--.*?-->|</?[A-Za-z][^>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return clean_text(text)


@lru_cache(maxsize=1)
def folding() -> tuple[str, str]:
    """Letters that compatibility decomposition turns into one ASCII character and marks, and that character."""
    pairs = []
    for i in [*range(0xA0, 0x250), *range(0x1E00, 0x1F00), *range(0x2070, 0x20A0), *range(0xFF01, 0xFF5F)]:
        base = [x for x in unicodedata.normalize("NFKD", chr(i)) if not unicodedata.combining(x)]
        if len(base) == 1 and base[0].isascii() and base[0] != chr(i):
            pairs.append((chr(i), base[0]))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def fold(c: Column | str) -> Column:
    """Lower case without accents; combining marks go; null becomes an empty string. Covers every letter that
    decomposes to one ASCII character (translate() keeps this inside code generation)."""
    return F.lower(F.translate(F.regexp_replace(F.coalesce(col(c), F.lit("")), r"\p{M}+", ""), *folding()))


def normalize_key(c: Column | str) -> Column:
    """fold(), with every run of other characters than a-z 0-9 as one underscore, none at the ends."""
    return F.regexp_replace(F.regexp_replace(fold(c), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def key_of(text: str) -> str:
    """normalize_key() of a constant."""
    text = "".join(x for x in unicodedata.normalize("NFKD", text) if not unicodedata.combining(x)).lower()
    return "_".join("".join(x if x.isascii() and x.isalnum() else " " for x in text).split())


def contains_any(folded: Column, terms) -> Column:
    out = F.lit(False)
    for t in terms:
        out = out | F.contains(folded, F.lit(t))
    return out


def parse_bool(c: Column | str) -> Column:
    """1, 0 or null."""
    key = normalize_key(c)
    return F.when(col(c).isNull(), None).when(key.isin(*YES), 1).when(key.isin(*NO), 0).cast("int")


def flag(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False)).cast("int")


def warnings(**named: Column) -> Column:
    """Names of the conditions that hold, joined by a bar; null if none does."""
    return F.nullif(F.concat_ws("|", *[F.when(c, F.lit(k)) for k, c in named.items()]), F.lit(""))


def first_filled(*values: Column) -> Column:
    """The first that is neither null nor empty; 0 and false stand."""
    return F.coalesce(*[F.nullif(v, F.lit("")) for v in values])


def token_count(c: Column | str) -> Column:
    """How many bar-separated tokens aren't blank."""
    return F.coalesce(F.size(F.filter(F.split(col(c), "[|]"), lambda t: F.trim(t) != "")), F.lit(0))


def rounded(x: Column, digits: int = 2) -> Column:
    """To so many decimals, half up on the binary value: the same in every engine with IEEE doubles."""
    scale = float(10**digits)
    return F.floor(x * scale + F.lit(0.5)) / scale


def once(f, c: Column | str) -> Column:
    """f of c, with c worked out once and bound to a lambda's variable. For wide projections, where f names
    its argument many times and the generated code would grow beyond what a method may hold."""
    return F.get(F.transform(F.array(col(c)), lambda x: f(x)), F.lit(0))
