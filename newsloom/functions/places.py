"""Localised values, countries and continents of vendor records, and the audience role of a publisher."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNITED_STATES = "United States"
#: Continents whose publishers stand for the audience, and a spelling that the vendor uses: fixed values.
AUDIENCE = ("Europe", "North America")
SPELLINGS = {"Noth America": "North America"}


def localized(value: Column) -> Column:
    """The English value of a map of languages, or its first value."""
    return F.coalesce(F.try_element_at(value, F.lit("eng")), F.try_element_at(F.map_values(value), F.lit(1)))


def english_label(value: Column) -> Column:
    """The English value only, for records whose other languages do not count."""
    return F.try_element_at(value, F.lit("eng"))


#: Labels within labels that ``nested_value`` goes down.
LABELS = 4


def nested_value(value: Column) -> Column:
    """The text of a vendor's value (JSON text): of an object its English value, else that of its label, and so on down; a
    plain value is itself. Nothing else of an object counts."""
    parsed = F.try_parse_json(value)
    found = []
    for depth in range(LABELS + 1):
        at = "$" + ".label" * depth
        kind = F.schema_of_variant(F.try_variant_get(parsed, at, "variant"))
        found.append(F.when(~kind.startswith("OBJECT") & ~kind.startswith("ARRAY"), F.try_variant_get(parsed, at, "string")))
        found.append(F.try_variant_get(parsed, f"{at}.eng", "string"))
    return F.coalesce(*found)


def country_name(country_label: Column, location_type: Column, location_label: Column) -> Column:
    """The country of a location: its country's label, or its own label if it is a country itself."""
    return F.coalesce(country_label, F.when(location_type == "country", location_label))


def continent_name(country_continent: Column, location_continent: Column) -> Column:
    found = F.coalesce(country_continent, location_continent)
    spelt = F.create_map(*[F.lit(x) for pair in SPELLINGS.items() for x in pair])
    return F.coalesce(F.try_element_at(spelt, found), found)


def audience_role(country: Column, continent: Column, event_country: Column) -> Column:
    """local for a publisher of the event's country, audience for one of the audience's continents, else excluded."""
    same = (F.trim(country) != "") & (F.lower(country) == F.lower(event_country))
    return F.when(same, "local").when(continent.isin(*AUDIENCE), "audience").otherwise("excluded")


def role_by_country(country: Column) -> Column:
    return F.when(country == UNITED_STATES, "united_states").otherwise("international")


def distinct_labels(items: Column, most: int) -> Column:
    """The first ``most`` of an array of (label, score), then those of them whose label is not blank."""
    return F.filter(F.slice(items, 1, most), lambda x: F.coalesce(F.trim(x["label"]), F.lit("")) != "")
