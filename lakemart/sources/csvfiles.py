"""CSV files with a header line and a declared schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# Column names and types of the retail star files.
STAR_SCHEMAS = {
    "dim_customer": (
        "customer_sk long, customer_code string, first_name string, last_name string, gender string, "
        "email string, phone string, loyalty_tier string, signup_date date"
    ),
    "dim_date": (
        "date_sk long, date date, day int, month int, month_name string, quarter int, year int, "
        "day_of_week int, day_name string, is_weekend boolean, is_month_end boolean, "
        "is_month_start boolean, is_quarter_end boolean, is_quarter_start boolean"
    ),
    "dim_product": (
        "product_sk long, product_code string, product_name string, department string, category string, "
        "supplier_sk long, list_price decimal(18,2), uom string"
    ),
    "dim_store": (
        "store_sk long, store_code string, store_name string, city string, state_province string, "
        "region string, country string, open_date date, sq_ft int"
    ),
    "fact_returns": (
        "sales_id long, date_sk long, store_sk long, product_sk long, returned_qty int, "
        "return_reason string, refund_amount decimal(18,2)"
    ),
}

# What the parser hands out for an empty field; a quoted empty field stays ''.
NO_FIELD = "\u0000"


def read_csv(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """Strict read: the header must name the schema's columns and a malformed row fails the job.

    Empty lines are skipped; an empty field is NULL and a quoted empty field is ''.
    """
    return (
        spark.read.schema(schema)
        .option("header", True)
        .option("enforceSchema", False)
        .option("nullValue", NO_FIELD)
        .option("mode", "FAILFAST")
        .csv(path)
    )


def read_star(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return read_csv(spark, f"{folder}/{name}.csv", STAR_SCHEMAS[name])


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).csv(path)
