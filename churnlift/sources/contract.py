"""

A contract names the columns of a table, their types and how text is parsed.
``ingest`` applies it to a raw table, whose columns may be text:

* ``strict``: the first value that does not fit ends the job with the column
  and the value in the message (a parse without ``errors='coerce'``);
* ``reject``: rows with a value that does not fit are kept out and listed in a
  reject table (key, column, value, reason), one row a value;
* a column with ``on_bad="null"`` is coerced in both modes.

A table that has its types already is checked by ``conforming``.  Missing
columns are an error everywhere; columns that the contract does not
name are left out, so the scan is pruned.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Field:
    """``type``: a Spark type name; ``format``: how text is parsed (timestamps);
    ``required``: NULL does not fit; ``on_bad``: "reject" or "null"."""

    type: str
    format: str | None = None
    required: bool = False
    on_bad: str = "reject"


@dataclass(frozen=True)
class Contract:
    """``key``: the columns that name a row in the reject table."""

    name: str
    key: tuple[str, ...]
    fields: dict[str, Field]


# Formats of the text columns.
DATE, TIME = "yyyy-MM-dd HH:mm:ss", "HH:mm:ss"

CONTRACTS = {c.name: c for c in (
    Contract("order_details", ("ORDER_ID", "LINE_NO"), {
        "ORDER_ID": Field("bigint", required=True), "CUSTOMER_ID": Field("bigint"), "SKU_ID": Field("bigint"), "STORE_ID": Field("bigint"),
        "LINE_NO": Field("int"), "DEVICE_ID": Field("bigint"), "ORDER_TIMESTAMP": Field("timestamp_ntz", DATE),
        "ORDER_DATE": Field("timestamp_ntz", DATE, required=True), "UNIT_QUANTITY": Field("double"), "UNIT_LIST_PRICE": Field("double"),
        "UNIT_OFFERED_PRICE": Field("double"), "UNIT_CHARGED_PRICE": Field("double"), "UNIT_NET": Field("double"),
        "PAYMENT_METHOD": Field("string"), "ORDER_STATE_FINAL": Field("string")}),
    Contract("operation_details", ("ORDER_ID",), {
        "ORDER_ID": Field("bigint", required=True), "ORDER_DATE": Field("timestamp_ntz", DATE, required=True),
        "ORDER_TIME": Field("time", TIME, on_bad="null"), "ORDER_STATE_FINAL": Field("string", required=True), "DELIVERY_TIME": Field("double"),
        "WITHIN_SLA": Field("int"), "APPROVAL_TIME": Field("double"), "TOTAL_DISTANCE": Field("double")}),
    Contract("store_master", ("STORE_ID",), {
        "STORE_ID": Field("bigint", required=True), "STORE_NAME": Field("string"), "PREFIX": Field("string")}),
    Contract("product_master", ("SKU_ID",), {
        "SKU_ID": Field("bigint", required=True), "SKU_NAME": Field("string"), "SKU_CATEGORY": Field("string"),
        "SKU_SUBCATEGORY": Field("string"), "SKU_IS_BUNDLE": Field("int")}),
    Contract("user_master", ("CUSTOMER_ID",), {"CUSTOMER_ID": Field("bigint", required=True), "SEGMENT": Field("string")}),
)}


def parsed(c: Column, have: T.DataType, field: Field) -> Column:
    """The value in the declared type; NULL where it does not fit.  A ``time``
    stays text, valid or NULL."""
    if field.type == "time":
        return F.when(F.try_to_timestamp(c.cast("string"), F.lit(field.format)).isNotNull(), c.cast("string"))
    if field.type == "timestamp_ntz" and isinstance(have, T.StringType):
        return F.try_to_timestamp(c, F.lit(field.format)).cast("timestamp_ntz")
    return c.try_cast(field.type)


def _checked(df: DataFrame, contract: Contract) -> None:
    missing = [c for c in contract.fields if c not in df.columns]
    if missing:
        raise ValueError(f"{contract.name}: missing columns {missing}")


def strict(df: DataFrame, contract: Contract) -> DataFrame:
    """The table in its declared types; a value that does not fit raises when it is read."""
    _checked(df, contract)
    out = []
    for name, field in contract.fields.items():
        raw, value = F.col(name), parsed(F.col(name), df.schema[name].dataType, field)
        if field.on_bad == "reject":
            bad = F.format_string(f"{contract.name}.{name}: '%s' is not a {field.type}", raw.cast("string"))
            value = F.when(raw.isNotNull() & value.isNull(), F.raise_error(bad).cast(_stored(field))).otherwise(value)
        if field.required:
            value = F.coalesce(value, F.raise_error(F.lit(f"{contract.name}.{name}: NULL in a required column")).cast(_stored(field)))
        out.append(value.alias(name))
    return df.select(*out)


def conforming(df: DataFrame, contract: Contract) -> DataFrame:
    """A table that is typed already, checked by its schema alone: no value is
    touched, so filters still reach the scan.  Times are text."""
    _checked(df, contract)
    for name, field in contract.fields.items():
        want = T._parse_datatype_string(_stored(field))
        if df.schema[name].dataType != want:
            raise TypeError(f"{contract.name}.{name} is {df.schema[name].dataType.simpleString()}, expected {want.simpleString()}")
    return df.select(*contract.fields)


def _stored(field: Field) -> str:
    return "string" if field.type == "time" else field.type


def split(df: DataFrame, contract: Contract) -> tuple[DataFrame, DataFrame]:
    """(rows that fit, reject table).  Both are plans over one projection: no
    row goes through Python, and only the rejects are exploded."""
    _checked(df, contract)
    faults = []
    for name, field in contract.fields.items():
        raw, value = F.col(name), parsed(F.col(name), df.schema[name].dataType, field)
        reason = F.lit(None).cast("string")
        if field.on_bad == "reject":
            reason = F.when(raw.isNotNull() & value.isNull(), F.lit(f"not a {field.type}"))
        if field.required:
            reason = F.coalesce(reason, F.when(raw.isNull(), F.lit("required")))
        faults.append(F.when(reason.isNotNull(), F.struct(F.lit(name).alias("column"), raw.cast("string").alias("value"),
                                                          reason.alias("reason"))))
    marked = df.select(*contract.fields, F.array_compact(F.array(*faults)).alias("_faults"))
    good = marked.where(F.size("_faults") == 0).select(
        *[parsed(F.col(name), df.schema[name].dataType, field).alias(name) for name, field in contract.fields.items()])
    rejects = marked.where(F.size("_faults") > 0).select(*[F.col(k).cast("string").alias(k) for k in contract.key], F.inline("_faults"))
    return good, rejects


def ingest(df: DataFrame, contract: Contract, mode: str = "strict") -> DataFrame | tuple[DataFrame, DataFrame]:
    """``strict``: the table; ``reject``: (table, rejects)."""
    if mode not in ("strict", "reject"):
        raise ValueError(f"unknown mode {mode}")
    return strict(df, contract) if mode == "strict" else split(df, contract)
