"""Where each logical field of a source lives, as a validated recipe of Column expressions."""

from __future__ import annotations

import re
from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from addrloom.functions.text import sqlite_int

PROPS = re.compile(r"props:[A-Za-z0-9_]+")


@dataclass(frozen=True)
class Recipe:
    street_from: str
    full_from: str
    number_from: str = "number"
    lo_num: str | None = None
    hi_num: str | None = None
    lo_num_suf: str | None = None
    hi_num_suf: str | None = None
    municipality: str | None = None
    ward: str | None = None
    status: str | None = None
    unit: str | None = None
    address_class: str | None = None

    def __post_init__(self):
        allowed = {"street_from": {"street", "full"}, "full_from": {"full", "number+street"}, "number_from": {"number", "full"}, "unit": {"unit", "full-after-street", None}}
        for f in fields(self):
            v = getattr(self, f.name)
            plain = allowed.get(f.name, {None})
            if v not in plain and not (f.name != "full_from" and isinstance(v, str) and PROPS.fullmatch(v)):
                raise ValueError(f"{f.name}: {v!r} isn't a field")
        if self.number_from == "full" and self.full_from == "number+street":
            raise ValueError("number and full would be made of each other")

    def declares(self, field: str) -> bool:
        """Whether the source has a logical field at all."""
        return getattr(self, field) is not None

    def columns(self) -> dict[str, Column]:
        """The logical fields; those not declared are null."""
        prop = lambda v: F.get_json_object("props", f"$.{v[6:]}")
        blank = lambda c: F.nullif(F.trim(c), F.lit(""))
        said = lambda v: prop(v) if v else F.lit(None).cast("string")
        number = {"number": F.col("number"), "full": F.nullif(F.substring_index(F.trim("full"), " ", 1), F.lit(""))}.get(self.number_from)
        number = prop(self.number_from) if number is None else number
        street = {"street": F.col("street"), "full": blank(F.substring("full", F.length(F.coalesce(number, F.lit(""))) + 1, F.length("full")))}.get(self.street_from)
        street = prop(self.street_from) if street is None else street
        full = F.col("full") if self.full_from == "full" else blank(F.concat_ws(" ", number, street))
        none = lambda c: F.nullif(F.nullif(c, F.lit("None")), F.lit(""))
        after = F.substring("full", F.instr(F.col("full"), F.concat(F.lit(" "), street)) + F.length(street) + 1, F.length("full"))
        unit = {"unit": none(F.col("unit")), "full-after-street": F.when(F.contains(F.col("full"), F.concat(F.lit(" "), street)), none(F.trim(after)))}.get(self.unit)
        unit = none(said(self.unit)) if unit is None else unit
        return {
            "address_number": number, "linear_name_full": street, "address_full": full, "unit": unit,
            "lo_num": sqlite_int(said(self.lo_num)), "hi_num": sqlite_int(said(self.hi_num)),
            "lo_num_suf": F.nullif(said(self.lo_num_suf), F.lit("None")), "hi_num_suf": F.nullif(said(self.hi_num_suf), F.lit("None")),
            "municipality_name": said(self.municipality), "ward_name": said(self.ward), "status": said(self.status), "address_class": said(self.address_class),
        }

    def project(self, source: DataFrame) -> DataFrame:
        return source.select(F.col("identity_key").alias("address_point_id"), "longitude", "latitude", *[c.alias(k) for k, c in self.columns().items()])
