"""The declared landing tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakemart.sources.tables import lower_case_names

# Names of the landing tables and their columns. No source states
# the types; they follow from how the models use the columns.
LANDING = {
    "customers": (
        "ID long, sync_token string, display_name string, company_name string, fully_qualified_name string, "
        "print_on_check_name string, active boolean, taxable boolean, job boolean, bill_with_parent boolean, "
        "is_project boolean, balance decimal(18,2), balance_with_jobs decimal(18,2), bill_addr_line1 string, "
        "bill_addr_city string, bill_addr_state string, bill_addr_postal_code string, bill_addr_country string, "
        "ship_addr_line1 string, ship_addr_city string, ship_addr_state string, ship_addr_postal_code string, "
        "ship_addr_country string, primary_phone string, primary_email string, preferred_delivery_method string, "
        "sales_term_id long, sales_term_name string, currency_code string, default_tax_code_id string, notes string, "
        "created_at timestamp_ntz, updated_at timestamp_ntz, load_time timestamp_ntz"
    ),
    "deals": (
        "deal_id long, is_archived boolean, created_at timestamp_ntz, updated_at timestamp_ntz, url string, "
        "dealname string, dealstage string, notes_last_updated timestamp_ntz, notes_last_contacted timestamp_ntz, "
        "dealtype string, deal_source string, amount decimal(18,2), description string, num_associated_contacts long, "
        "closedate timestamp_ntz, deal_location string, mdc_quote_id long, pipeline string, hs_acv decimal(18,2), "
        "hs_Arr decimal(18,2), load_time timestamp_ntz"
    ),
    "parsed_quotes": (
        "quote_id long, is_archived boolean, created_at timestamp_ntz, updated_at timestamp_ntz, url string, "
        "hs_status string, hs_payment_status string, hs_payment_date timestamp_ntz, hs_expiration_date timestamp_ntz, "
        "hs_render_status string, hs_tcv decimal(18,2), hs_title string, hs_quote_amount decimal(18,2), "
        "load_time timestamp_ntz"
    ),
    "qb_invoices": (
        "id long, sync_token string, doc_number string, txn_date date, due_date date, total_amt decimal(18,2), "
        "balance decimal(18,2), customer_id long, customer_name string, department_id string, bill_addr_city string, "
        "bill_addr_state string, bill_addr_postal_code string, ship_addr_city string, bill_email string, "
        "print_status string, email_status string, total_tax decimal(18,2), allow_online_payment boolean, "
        "delivery_type string, created_at timestamp_ntz, updated_at timestamp_ntz, load_time timestamp_ntz"
    ),
    "invoice_relation": (
        "ID long, INVOICE_ID long, EXTERNAL_ID string, CREATED_AT timestamp_ntz, UPDATED_AT timestamp_ntz, "
        "DELETED_AT timestamp_ntz, TRANSFORM_TS timestamp_ntz"
    ),
    "assoc_quotes_companies": "quote_id long, company_id long, label string",
    "assoc_quotes_deals": "quote_id long, deal_id long, label string",
}


#: Tables that pass through as they come, with or without each declared column.
BRIDGES = ("assoc_quotes_companies", "assoc_quotes_deals")


def landing_schema(name: str) -> T.StructType:
    return T.StructType.fromDDL(LANDING[name])


def conform(df: DataFrame, name: str) -> DataFrame:
    """Cast to the declared types, in the declared order; a missing column is NULL."""
    df = lower_case_names(df)
    return df.select(
        *[
            (F.col(f.name.lower()) if f.name.lower() in df.columns else F.lit(None)).cast(f.dataType).alias(f.name.lower())
            for f in landing_schema(name)
        ]
    )


def read_landing(spark: SparkSession, database: str, name: str) -> DataFrame:
    """A landing table of a database: its declared columns as ``conform`` has them, then all others as they are.

    A declared column that is missing is an error, save in a bridge table, which passes through as it comes.
    """
    landed = lower_case_names(spark.table(f"{database}.{name}"))
    declared = [f.name.lower() for f in landing_schema(name)]
    missing = [c for c in declared if c not in landed.columns]
    if missing and name not in BRIDGES:
        raise ValueError(f"{database}.{name} lacks declared columns: {', '.join(missing)}")
    types = {f.name.lower(): f.dataType for f in landing_schema(name)}
    known = [F.col(c).cast(types[c]).alias(c) for c in declared if c in landed.columns]
    return landed.select(*known, *[F.col(f"`{c}`") for c in landed.columns if c not in types])
