"""Column functions for free-text locations and stored geocoder payloads."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ripplenet.functions.text import strip_digits

INVALID = "invalid"


def geocode_address(query: Column, payload: Column) -> Column:
    """Formatted address out of a stored payload; ``invalid`` for an empty query or a payload without results."""
    status = F.get_json_object(payload, "$.status")
    address = F.get_json_object(payload, "$.results[0].formatted_address")
    return F.when(F.length(query) == 0, F.lit(INVALID)).when(status == "ZERO_RESULTS", F.lit(INVALID)).otherwise(address)


def us_state_part(address: Column) -> Column:
    """Second-last comma part of a lower-cased US address without digits; null outside the USA."""
    part = F.try_element_at(F.split(address, ","), F.lit(-2))
    return F.when(F.contains(address, F.lit(", usa")), F.trim(strip_digits(part)))
