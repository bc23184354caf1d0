"""The declared tables: what is cleaned, loaded, merged and versioned, and on which keys."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakemart.functions.clean import as_date, blank_if_null, first_present, zero_if_null
from lakemart.operators.dedupe import latest_per_key
from lakemart.operators.merge import merge_distinct, merge_latest
from lakemart.operators.scd2 import scd2_delta, scd2_seed
from lakemart.operators.snapshot import is_open, snapshot_delta, snapshot_open

# ---- column helpers: each takes names separated by blanks ----


def _kept(names: str) -> list[Column]:
    return [F.col(n) for n in names.split()]


def _blanked(names: str) -> list[Column]:
    return [blank_if_null(n).alias(n) for n in names.split()]


def _renamed(**names: str) -> list[Column]:
    return [F.col(old).alias(new) for old, new in names.items()]


def _dated(**names: str) -> list[Column]:
    return [as_date(old).alias(new) for old, new in names.items()]


# ---- transform layer ----


@dataclass(frozen=True)
class Transform:
    """Cleans one landing table and adds the days not loaded yet.

    Without ``load_time`` the table is rebuilt in full. ``by_day`` partitions it
    by ``load_column``, for tables whose days fill files of good size: the newest
    day is then read from the catalog instead of one column of the table.
    """

    clean: Callable[[DataFrame], DataFrame]
    load_time: str | None = None
    load_column: str = "load_dt"
    by_day: bool = False


# Names and order of the columns of every table.
def clean_customers(raw: DataFrame) -> DataFrame:
    return raw.select(
        *_renamed(id="customer_id"),
        *_kept("sync_token display_name"),
        first_present("company_name", "fully_qualified_name").alias("company_name"),
        *_kept("fully_qualified_name print_on_check_name active taxable job bill_with_parent is_project"),
        *_kept("balance balance_with_jobs"),
        *_blanked("bill_addr_line1 bill_addr_city bill_addr_state bill_addr_postal_code bill_addr_country"),
        *_blanked("ship_addr_line1 ship_addr_city ship_addr_state ship_addr_postal_code ship_addr_country"),
        *_blanked("primary_phone primary_email"),
        *_kept("preferred_delivery_method"),
        zero_if_null("sales_term_id").alias("sales_term_id"),
        *_blanked("sales_term_name"),
        *_kept("currency_code default_tax_code_id"),
        *_blanked("notes"),
        *_dated(created_at="created_dt", updated_at="updated_dt", load_time="load_dt"),
    )


def clean_deals(raw: DataFrame) -> DataFrame:
    return raw.select(
        *_kept("deal_id is_archived"),
        *_renamed(created_at="created_dt", updated_at="updated_dt"),
        *_kept("url dealname dealstage"),
        *_dated(notes_last_updated="notes_last_updated_dt", notes_last_contacted="notes_last_contacted_dt"),
        *_kept("dealtype"),
        blank_if_null("deal_source").alias("dealsource"),
        *_kept("amount"),
        *_blanked("description"),
        *_kept("num_associated_contacts"),
        *_dated(closedate="closed_dt"),
        *_kept("deal_location"),
        *_renamed(mdc_quote_id="quote_id"),
        *_kept("pipeline"),
        *_renamed(hs_acv="acv", hs_arr="arr"),
        *_dated(load_time="load_dt"),
    )


def clean_quotes(raw: DataFrame) -> DataFrame:
    return raw.select(
        *_kept("quote_id is_archived"),
        *_renamed(created_at="created_dt", updated_at="updated_dt"),
        *_kept("url"),
        *_renamed(hs_status="status", hs_payment_status="payment_status"),
        *_dated(hs_payment_date="payment_dt", hs_expiration_date="expiration_dt"),
        blank_if_null("hs_render_status").alias("render_status"),
        *_renamed(hs_tcv="tcv", hs_title="title", hs_quote_amount="quote_amount"),
        *_dated(load_time="load_dt"),
    )


def clean_invoices(raw: DataFrame) -> DataFrame:
    return raw.select(
        *_kept("id sync_token doc_number"),
        *_renamed(txn_date="txn_dt", due_date="due_dt", total_amt="total_amount"),
        *_kept("balance customer_id customer_name department_id"),
        *_blanked("bill_addr_city bill_addr_state bill_addr_postal_code ship_addr_city bill_email"),
        *_kept("print_status email_status total_tax allow_online_payment"),
        *_blanked("delivery_type"),
        *_dated(created_at="created_dt", updated_at="updated_dt", load_time="load_dt"),
    )


def clean_invoice_relation(raw: DataFrame) -> DataFrame:
    return raw.select(
        *_kept("id invoice_id external_id"),
        *_renamed(created_at="created_dt", updated_at="updated_dt", deleted_at="deleted_dt"),
        *_dated(transform_ts="load_dt"),
    )


def as_landed(raw: DataFrame) -> DataFrame:
    return raw.select("*")


TRANSFORMS = {
    "customers": Transform(clean_customers, "load_time"),
    "deals": Transform(clean_deals, "load_time"),
    "parsed_quotes": Transform(clean_quotes, "load_time"),
    "qb_invoices": Transform(clean_invoices, "load_time"),
    "invoice_relation": Transform(clean_invoice_relation, "transform_ts"),
    "assoc_quotes_companies": Transform(as_landed),
    "assoc_quotes_deals": Transform(as_landed),
}

# ---- consumption layer ----

# Equal update times are settled by the load date, then by the columns the table
# takes, so that every run picks the same row and no other column is read.


def _ties(source: DataFrame, updated: str, taken: list[str]) -> tuple[str, ...]:
    load = ["load_dt"] if "load_dt" in source.columns else []
    return tuple(dict.fromkeys(load + [c for c in taken if c != updated]))


@dataclass(frozen=True)
class Versioned:
    """A type 2 dimension."""

    source: str
    key: str
    tracked: tuple[str, ...]
    passthrough: tuple[str, ...]
    updated: str = "updated_dt"
    match_scope: str = "any"

    @property
    def is_open(self) -> Column:
        return F.col("is_active")

    def _settings(self, source: DataFrame) -> dict:
        return dict(
            source=source,
            key=self.key,
            updated=self.updated,
            tracked=list(self.tracked),
            passthrough=self.passthrough,
            ties=_ties(source, self.updated, [*self.tracked, *self.passthrough]),
        )

    def first(self, source: DataFrame, run_time) -> DataFrame:
        return scd2_seed(**self._settings(source))

    def delta(self, open_rows: DataFrame, versions: DataFrame, source: DataFrame, run_time) -> DataFrame:
        return scd2_delta(open_rows, versions, match_scope=self.match_scope, **self._settings(source))


@dataclass(frozen=True)
class Merged:
    """The newest source row per key, merged."""

    source: str
    keys: tuple[str, ...]
    columns: tuple[str, ...] = ()
    update_columns: tuple[str, ...] = ()
    updated: str = "updated_dt"
    null_safe_keys: bool = False

    def build(self, target: DataFrame | None, source: DataFrame, new_only: bool = False) -> DataFrame:
        """``new_only``: the source holds new loads only, so a late row may be older than the stored one."""
        keys, names = list(self.keys), list(self.columns) or source.columns
        ties = _ties(source, self.updated, [c for c in names if c not in keys])
        if target is None:
            return latest_per_key(source, keys, self.updated, ties).select(*names)
        return merge_latest(
            target,
            source,
            keys,
            self.updated,
            ties,
            list(self.update_columns) or None,
            self.null_safe_keys,
            columns=names,
            not_older=self.updated if new_only else None,
        )


@dataclass(frozen=True)
class Bridged:
    """The distinct source rows, merged; two different rows of one key are an error."""

    source: str
    keys: tuple[str, ...]

    def build(self, target: DataFrame | None, source: DataFrame, new_only: bool = False) -> DataFrame:
        if target is None:
            return source.distinct()
        return merge_distinct(target, source, list(self.keys))


@dataclass(frozen=True)
class Snapshot:
    """Check-based history of a frame that is no table itself."""

    source: str
    key: str
    check_columns: tuple[str, ...]
    prepare: Callable[[DataFrame], DataFrame] = as_landed

    @property
    def is_open(self) -> Column:
        return is_open()

    def first(self, source: DataFrame, run_time) -> DataFrame:
        return snapshot_open(self.prepare(source), self.key, run_time)

    def delta(self, open_rows: DataFrame, versions: DataFrame, source: DataFrame, run_time) -> DataFrame:
        return snapshot_delta(open_rows, self.prepare(source), self.key, list(self.check_columns), run_time)


def current_customers(customers: DataFrame) -> DataFrame:
    """The newest row of every customer; never stored."""
    others = [c for c in customers.columns if c != "customer_id"]
    return latest_per_key(customers, "customer_id", "updated_dt", _ties(customers, "updated_dt", others))


# Keys, tracked, passed and checked columns of every table.
CONSUMPTION = {
    "dim_deals": Versioned(
        "deals",
        "deal_id",
        tracked=tuple(
            "is_archived url dealname dealstage notes_last_updated_dt notes_last_contacted_dt dealtype dealsource "
            "description num_associated_contacts closed_dt deal_location pipeline".split()
        ),
        passthrough=("created_dt", "updated_dt", "quote_id", "load_dt"),
    ),
    "dim_quotes": Versioned(
        "parsed_quotes",
        "quote_id",
        tracked=tuple("is_archived url status payment_status payment_dt expiration_dt render_status title".split()),
        passthrough=("created_dt", "updated_dt", "load_dt"),
    ),
    "fact_deals": Merged(
        "deals",
        ("deal_id", "quote_id"),
        columns=tuple("deal_id quote_id amount acv arr created_dt updated_dt closed_dt load_dt".split()),
        update_columns=("amount", "acv", "arr", "updated_dt", "closed_dt"),
    ),
    "dim_invoices": Merged(
        "qb_invoices",
        ("id",),
        columns=tuple(
            "id sync_token doc_number txn_dt due_dt customer_id customer_name department_id bill_addr_city "
            "bill_addr_state bill_addr_postal_code ship_addr_city bill_email print_status email_status total_tax "
            "allow_online_payment delivery_type created_dt updated_dt".split()
        ),
    ),
    "dim_invoice_relation": Merged("invoice_relation", ("invoice_id",)),
    "dim_assoc_quotes_companies": Bridged("assoc_quotes_companies", ("quote_id", "company_id")),
    "dim_assoc_quotes_deals": Bridged("assoc_quotes_deals", ("quote_id", "deal_id")),
    "dim_customers": Snapshot(
        "customers",
        "customer_id",
        check_columns=tuple(
            "sync_token display_name company_name fully_qualified_name print_on_check_name active taxable job "
            "bill_with_parent is_project balance balance_with_jobs bill_addr_line1 bill_addr_city bill_addr_state "
            "bill_addr_postal_code bill_addr_country ship_addr_line1 ship_addr_city ship_addr_state "
            "ship_addr_postal_code ship_addr_country primary_phone primary_email preferred_delivery_method "
            "sales_term_id sales_term_name currency_code default_tax_code_id notes updated_dt".split()
        ),
        prepare=current_customers,
    ),
}
