"""From landed payloads to discovered fields, by dialect."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from unisource.operators import dynamics, edmx, records, sage, sap

# Dialects of plain records, and those whose fields come from records at all.
_RECORDS = ("rest", "graphql", "soap")
_TYPED = (*_RECORDS, "file_json", "sage_cloud")
# Dialects one operator handles alone.
_SINGLE = {
    **dict.fromkeys(_RECORDS, records.endpoint_fields),
    "file_json": records.json_file_fields,
    "odata": edmx.edmx_fields,
    "bapi": sap.bapi_fields,
    "sage_x3": sage.x3_fields,
    "sage_cloud": sage.cloud_fields,
}


def discover(landed: DataFrame, dialects: list[str] | None = None, mode: str = "all") -> DataFrame:
    """Fields of every landed payload. Store payloads partitioned by dialect, so that each
    operator reads its own; `dialects` leaves out branches known to have none.

    Records are typed from all of them; mode `first` takes each payload's first one.

    Multi-part dialects: `abap_listing` + `abap`, `sap_services` + `sap_odata`,
    `dynamics_entities` + `dynamics_attributes` + `dynamics_edmx`.
    """

    def of(name: str) -> DataFrame:
        return landed.filter(F.col("dialect") == name)

    def wanted(name: str) -> bool:
        return dialects is None or name in dialects

    found = [operator(of(name), **({"mode": mode} if name in _TYPED else {})) for name, operator in _SINGLE.items() if wanted(name)]
    if wanted("abap"):
        tables = sap.listed_tables(sap.rfc_rows(of("abap_listing")))
        fields = of("abap")
        # without a listing, or with one that was refused or cannot be read, all tables of a source count
        unlisted = fields.join(tables.select("source_id").distinct(), "source_id", "left_anti")
        found.append(sap.abap_fields(fields, tables))
        found.append(sap.abap_fields(unlisted.select(*fields.columns)))
    if wanted("sap_odata"):
        found.append(sap.service_fields(of("sap_services"), of("sap_odata")))
    if wanted("dynamics"):
        defined = dynamics.attribute_fields(of("dynamics_entities"), of("dynamics_attributes"))
        found.append(dynamics.choose_metadata(defined, of("dynamics_edmx")))
    return reduce(DataFrame.unionByName, found)
