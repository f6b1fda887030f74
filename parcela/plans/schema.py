"""The output tables' columns, in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcela.functions.features import BINARY_TERMS

LISTING_DDL = (
    "property_id STRING, fuente STRING, url STRING, scraped_at_utc TIMESTAMP, search_url STRING, pagina_origen INT, http_status INT, parse_ok INT, parse_warnings STRING, "
    "titulo STRING, descripcion STRING, tipo_operacion STRING, tipo_propiedad STRING, estado_publicacion STRING, fecha_publicacion STRING, inmobiliaria STRING, seller_id STRING, "
    "moneda STRING, precio DOUBLE, precio_texto STRING, expensas_moneda STRING, expensas DOUBLE, expensas_texto STRING, precio_m2_calculado DOUBLE, "
    "direccion_completa STRING, calle STRING, altura STRING, piso STRING, unidad STRING, barrio STRING, localidad STRING, partido STRING, provincia STRING, pais STRING, codigo_postal STRING, latitud DOUBLE, longitud DOUBLE, "
    "ambientes INT, dormitorios INT, banios INT, toilettes INT, cocheras INT, superficie_total_m2 DOUBLE, superficie_cubierta_m2 DOUBLE, superficie_descubierta_m2 DOUBLE, superficie_semicubierta_m2 DOUBLE, superficie_terreno_m2 DOUBLE, frente_m DOUBLE, fondo_m DOUBLE, "
    "antiguedad_anios INT, estado_inmueble STRING, disposicion STRING, orientacion STRING, luminosidad STRING, cantidad_plantas INT, cantidad_pisos_edificio INT, departamentos_por_piso INT, apto_credito INT, apto_profesional INT, permite_mascotas INT, accesibilidad INT, amoblado INT, "
    + ", ".join(f"{k} INT" for k in BINARY_TERMS)
    + ", cantidad_imagenes INT, imagen_principal STRING, video_url STRING, tour_virtual_url STRING, cantidad_atributos_extra INT, atributos_extra_json STRING, jsonld_raw STRING"
)
CARD_DDL = (
    "item_id STRING, fuente STRING, url STRING, search_url STRING, pagina_origen INT, scraped_at_utc TIMESTAMP, titulo STRING, tipo_propiedad STRING, tipo_operacion STRING, moneda STRING, precio DOUBLE, precio_texto STRING, desde INT, inmobiliaria STRING, "
    "direccion STRING, barrio STRING, localidad STRING, provincia STRING, ambientes_min INT, ambientes_max INT, banios_min INT, banios_max INT, dormitorios_min INT, dormitorios_max INT, superficie_min_m2 DOUBLE, superficie_max_m2 DOUBLE, tipo_superficie STRING, imagen_principal STRING, "
    "destacado INT, emprendimiento INT, posesion STRING, unidades_disponibles DOUBLE, atributos_texto STRING, texto_tarjeta STRING, parse_warnings STRING, "
    "posicion_pagina INT, slug STRING, calle STRING, altura INT, comuna INT, precio_anterior DOUBLE, descuento_pct DOUBLE, precio_m2_min DOUBLE, precio_m2_max DOUBLE, amplitud_superficie_m2 DOUBLE, es_rango_superficie INT, es_rango_ambientes INT, monoambiente INT, apto_credito INT, balcon INT, terraza INT, pileta INT, parrilla INT, cochera_mencionada INT, amenities_mencionadas INT, estado_entrega STRING, cantidad_atributos INT, completitud_pct DOUBLE, imagen_id STRING, imagen_extension STRING"
)


def columns(ddl: str) -> list[tuple[str, str]]:
    return [tuple(c.split(" ")) for c in ddl.split(", ")]


LISTING, CARD = columns(LISTING_DDL), columns(CARD_DDL)


def aligned(values: dict[str, Column], schema: list[tuple[str, str]]) -> list[Column]:
    """A column for each of the schema's: the value, or null."""
    unknown = values.keys() - {n for n, _ in schema}
    if unknown:
        raise ValueError(f"not in the schema: {sorted(unknown)}")
    return [values.get(n, F.lit(None)).cast(t).alias(n) for n, t in schema]


def unified(*tables: DataFrame) -> DataFrame:
    """Tables of either schema, one below the other: house numbers become text, missing columns null."""
    tables = [t.withColumn("altura", F.col("altura").cast("string")) for t in tables]
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out
