"""Rule-based features, as Column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from parcela.functions.text import contains_any, flag, key_of

# Features and the terms that stand for them.
BINARY_TERMS = {
    "balcon": ("balcon",), "terraza": ("terraza",), "patio": ("patio",), "jardin": ("jardin",), "parrilla": ("parrilla",),
    "pileta": ("pileta", "piscina"), "sum": ("sum", "salon de usos multiples"), "gimnasio": ("gimnasio", "gym"),
    "sauna": ("sauna",), "laundry": ("laundry", "lavanderia"), "baulera": ("baulera",), "ascensor": ("ascensor",),
    "seguridad_24h": ("seguridad 24", "vigilancia 24"), "vigilancia": ("vigilancia",),
    "aire_acondicionado": ("aire acondicionado",), "calefaccion": ("calefaccion", "caldera"),
    "losa_radiante": ("losa radiante",), "gas_natural": ("gas natural",), "agua_corriente": ("agua corriente",),
    "electricidad": ("electricidad", "luz"), "cloaca": ("cloaca",), "internet": ("internet", "wifi"),
    "vista_rio": ("vista al rio",), "vista_abierta": ("vista abierta", "vista panoramica"),
    "reciclado": ("reciclado", "reciclada", "refaccionado a nuevo"),
    "a_refaccionar": ("a refaccionar", "para reciclar", "estado original"),
}
CARD_TERMS = {"apto_credito": ("apto credito",), "balcon": ("balcon",), "terraza": ("terraza",), "pileta": ("pileta", "piscina"), "parrilla": ("parrilla",), "cochera_mencionada": ("cochera", "garage"), "amenities_mencionadas": ("amenities", "sum", "gimnasio")}
DELIVERY = (
    ("entrega_inmediata", ("entrega inmediata", "posesion inmediata")),
    ("proxima_entrega", ("proxima entrega", "pronta entrega")),
    ("en_construccion", ("en construccion",)),
    ("en_pozo", ("en pozo", "venta en pozo", "venta en blanco")),
)
# What pages that block a visitor say.
BLOCK_TITLES = ("access denied", "acceso denegado", "just a moment", "security check", "verificación de seguridad", "verificacion de seguridad")
BLOCK_TEXTS = ("verify you are human", "verifique que no es un robot", "completa el captcha", "complete el captcha", "security verification", "checking your browser", "comprobando su navegador")
WIDGETS_A = ("g-recaptcha", "h-captcha", "cf-chl-", "challenge-platform")
WIDGETS_B = (*WIDGETS_A, "px-captcha")


def attribute(attrs: Column, *names: str) -> Column:
    """The value of an attribute in an ordered array<struct<k, v>> of normalized keys: of the first name that
    is a key, or else of the first key that contains the first such name or lies in it."""
    return F.get(attributes(attrs, [names]), F.lit(0))


def attributes(attrs: Column, wanted: Sequence[Sequence[str]]) -> Column:
    """array<string>: attribute() for each list of names. One expression, however many are wanted."""
    first = lambda names, test: F.get(F.filter(F.transform(names, lambda k: F.get(F.filter(attrs, lambda a: test(a["k"], k)), F.lit(0))["v"]), lambda v: v.isNotNull()), F.lit(0))
    same, alike = (lambda a, k: a == k), (lambda a, k: F.contains(a, k) | F.contains(k, a))
    return F.transform(F.lit([[key_of(n) for n in names] for names in wanted]), lambda names: F.coalesce(first(names, same), first(names, alike)))


def binary_features(said: dict[str, Column], haystack: Column) -> dict[str, Column]:
    """1 or 0 for each feature: what an attribute says (1, 0 or null), or else whether a term occurs in the normalized text."""
    return {name: F.coalesce(said[name], flag(contains_any(haystack, map(key_of, terms)))) for name, terms in BINARY_TERMS.items()}


def card_features(folded: Column) -> dict[str, Column]:
    return {k: flag(contains_any(folded, terms)) for k, terms in CARD_TERMS.items()}


def first_class(folded: Column, classes) -> Column:
    """Of (name, terms) the first name one of whose terms occurs."""
    out = F.lit(None).cast("string")
    for name, terms in reversed(classes):
        out = F.when(contains_any(folded, terms), name).otherwise(out)
    return out


def delivery_status(folded: Column) -> Column:
    return first_class(folded, DELIVERY)


def block_reason(title: Column, visible: Column, html: Column, widgets=WIDGETS_A) -> Column:
    """Why a page looks like a block and not like content; null if it doesn't."""
    title, visible, html = (F.lower(F.coalesce(c, F.lit(""))) for c in (title, visible, html))
    widget, out = contains_any(html, widgets), F.lit(None).cast("string")
    for p in reversed(BLOCK_TEXTS):
        out = F.when(F.contains(visible, F.lit(p)) & widget, f"texto_visible:{p}").otherwise(out)
    for p in reversed(BLOCK_TITLES):
        out = F.when(F.contains(title, F.lit(p)), f"titulo:{p}").otherwise(out)
    return out


def response_class(status: Column, reason: Column, html: Column) -> Column:
    """What a captured response is, from its status and content."""
    return F.when(status == 202, "intermediate").when(status == 404, "not_found").when(status >= 400, "http_error").when(reason.isNotNull(), "blocked").when(html.isNull(), "missing").otherwise("ok")


def whole_response(status: Column, html: Column, least: int = 50_000) -> Column:
    return (status == 200) & (F.length(html) >= least)


def surface_kind(area: Column) -> Column:
    lower = F.lower(area)
    return F.when(F.contains(lower, F.lit("cubiert")), "cubierta").when(F.contains(lower, F.lit("total")), "total")


def completeness(*fields: Column) -> Column:
    """The share of fields that are filled, in percent, unrounded."""
    filled = sum((F.when(c.isNotNull() & (c.cast("string") != ""), 1).otherwise(0) for c in fields), F.lit(0))
    return filled / float(len(fields)) * 100
