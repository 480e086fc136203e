"""Inputs of the registered queries: the tables, and texts made from them, as SQL that both engines read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def placed_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table with place: where a row stands in it, in the order of its files' paths and of their rows."""
    return table(spark, sf_dir, name).withColumn("place", F.struct("_metadata.file_path", "_metadata.row_index"))


def from_sql(spark: SparkSession, sf_dir: str, sql: str, read: Callable[[SparkSession, str, str], DataFrame] = table) -> DataFrame:
    """The SQL over the tables that it names, each bound as an argument of the one statement."""
    import re

    used = [t for t in TABLES if re.search(rf"\b{t}\b", sql)]
    return spark.sql(re.sub(rf"\b({'|'.join(TABLES)})\b", r"{\1}", sql), **{t: read(spark, sf_dir, t) for t in used}) if used else spark.sql(sql)


#: IDs with their check digits (the last wrong for each third), phone numbers, IBANs (wrong for each fifth).
_DIGITS = ", ".join(f"cast(substring(base, {i}, 1) as int) as d{i}" for i in range(1, 10))
IDS = f"""
select c_custkey, concat(base, cast(t as string), cast((d1 + d2 + d3 + d4 + d5 + d6 + d7 + d8 + d9 + t + case when c_custkey % 3 = 0 then 1 else 0 end) % 10 as string)) as tckn
from (select *, ((7 * (d1 + d3 + d5 + d7 + d9) - (d2 + d4 + d6 + d8)) % 10 + 10) % 10 as t
      from (select *, {_DIGITS} from (select c_custkey, cast(100000000 + c_custkey * 7919 % 800000000 as string) as base from customer) x) y) z
"""
ID_TEXTS = f"select c_custkey, concat('Kimlik no: ', tckn, case when c_custkey % 7 = 0 then '1' else '' end, ' (', tckn, ')') as text from ({IDS}) i"
PHONE_TEXTS = """
select c_custkey, concat('Telefon: ', case c_custkey % 4 when 0 then '0' when 1 then '+90 ' when 2 then '0090-' else '' end, '5', lpad(cast(c_custkey % 100 as string), 2, '0'), ' ',
  lpad(cast(c_custkey * 7 % 1000 as string), 3, '0'), case when c_custkey % 2 = 0 then ' ' else '-' end, lpad(cast(c_custkey * 13 % 100 as string), 2, '0'), ' ',
  lpad(cast(c_custkey * 17 % 100 as string), 2, '0'), case when c_custkey % 6 = 0 then '7' else '' end, ', saat 9') as text from customer
"""
#: 22 digits of an account; moved to the front of 292700 they give the check digits modulo 97.
IBAN_TEXTS = """
select c_custkey, concat('Hesap ', case when c_custkey % 2 = 0 then 'TR' else 'tr' end, checks, ' ', substring(acct, 1, 4), ' ', substring(acct, 5, 4), ' ', substring(acct, 9, 4), ' ',
  substring(acct, 13, 4), ' ', substring(acct, 17, 4), ' ', substring(acct, 21, 2), '.') as text
from (select c_custkey, acct, lpad(cast(case when c_custkey % 5 = 0 then (98 - rest) % 97 + 1 else 98 - rest end as string), 2, '0') as checks
  from (select c_custkey, acct, cast(cast(concat(acct, '292700') as decimal(38, 0)) % 97 as int) as rest
    from (select c_custkey, concat('0006100', lpad(cast(c_custkey * 9973 as string), 15, '0')) as acct from customer) x) y) z
"""
