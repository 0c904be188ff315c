"""Local twin of the driver's correctness gate: run a registered Spark query
and its DuckDB SQL on the same parquet tables and compare row count, column
names/types and an order-insensitive value hash."""

from __future__ import annotations

import math

import duckdb
import pandas as pd

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sql: str, sf_dir: str) -> pd.DataFrame:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con.sql(sql).df()


def _kind(dtype) -> str:
    s = str(dtype)
    if s.startswith("int") or s.startswith("Int") or s.startswith("uint"):
        return "int"
    if s.startswith("float") or s.startswith("Float"):
        return "float"
    if s.startswith("datetime"):
        return "datetime"
    if s == "bool" or s == "boolean":
        return "bool"
    return "object"


def _norm(v, digits):
    if v is None or v is pd.NA or v is pd.NaT:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, digits) if digits is not None else v
    if isinstance(v, pd.Timestamp):
        return v.isoformat()
    if isinstance(v, (list, tuple)) or (hasattr(v, "ndim") and getattr(v, "ndim", 0) > 0):
        return tuple(_norm(x, digits) for x in list(v))
    if hasattr(v, "item"):
        return _norm(v.item(), digits)
    return v


def rows(df: pd.DataFrame, digits=None):
    cols = sorted(df.columns)
    out = []
    for rec in df[cols].itertuples(index=False, name=None):
        out.append(tuple(_norm(v, digits) for v in rec))
    return sorted(out, key=repr)


def compare(spark_pdf: pd.DataFrame, duck_pdf: pd.DataFrame) -> dict:
    res = {"rows_spark": len(spark_pdf), "rows_oracle": len(duck_pdf)}
    res["rows_match"] = len(spark_pdf) == len(duck_pdf)
    res["names_match"] = sorted(spark_pdf.columns) == sorted(duck_pdf.columns)
    if res["names_match"]:
        ks = {c: _kind(spark_pdf[c].dtype) for c in spark_pdf.columns}
        kd = {c: _kind(duck_pdf[c].dtype) for c in duck_pdf.columns}
        # a nullable integer column arrives as float from Spark's pandas path
        # and as Int64 from DuckDB's; treat int/float as one numeric kind then
        def same(a, b, c):
            if a == b:
                return True
            return {a, b} == {"int", "float"} and (spark_pdf[c].isna().any() or duck_pdf[c].isna().any())
        res["type_diffs"] = {c: (ks[c], kd[c]) for c in ks if not same(ks[c], kd[c], c)
                             and not (len(spark_pdf) == 0 or spark_pdf[c].isna().all() or duck_pdf[c].isna().all())}
        res["exact_match"] = rows(spark_pdf) == rows(duck_pdf)
        res["match_9"] = rows(spark_pdf, 9) == rows(duck_pdf, 9)
        if not res["exact_match"]:
            a, b = rows(spark_pdf), rows(duck_pdf)
            diffs = [(x, y) for x, y in zip(a, b) if x != y]
            res["first_diffs"] = diffs[:2]
    else:
        res["cols_spark"] = sorted(spark_pdf.columns)
        res["cols_oracle"] = sorted(duck_pdf.columns)
    res["ok"] = bool(res["rows_match"] and res["names_match"] and res.get("match_9") and not res.get("type_diffs"))
    return res
