"""Typed readers and writers for the receivables tables (SRC-*, SNK-*).

Readers match columns by name (a CSV by its header, which is all that is read ahead; types come from the fixed schemas,
not from an inference pass), accept CSV or parquet, and return lazy DataFrames. Optional tables come back empty with their schema, so downstream operators keep one code path.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from receivables.functions import dates
from receivables.sources import workbook

CUSTOMERS_SCHEMA = (
    "customer_id string, name string, email string, phone string, industry string, country string, state string, "
    "payment_terms_days int, credit_limit double, created_at string"
)
INVOICES_SCHEMA = (
    "invoice_id string, customer_id string, issue_date string, due_date string, invoice_amount double, "
    "currency string, status string, invoice_type string, channel string, created_at string"
)
PAYMENTS_SCHEMA = "payment_id string, invoice_id string, payment_date string, amount double, method string, status string"
ACTIONS_SCHEMA = "action_id string, invoice_id string, action_type string, action_date string, notes string, outcome string"
SCHEDULE_SCHEMA = (
    "invoice_id string, customer_id string, attempt_number int, scheduled_date string, action_type string, "
    "days_from_last_contact int, estimated_days_overdue int, status string, reschedule_reason string, "
    "completed_date string, completion_notes string, cancellation_reason string, cancelled_date string"
)
TRANSACTIONS_SCHEMA = (
    "invoice_no string, stock_code string, description string, quantity double, invoice_date string, "
    "unit_price double, customer_id double, country string"
)

DATE_COLUMNS = {
    "customers": ["created_at"],
    "invoices": ["issue_date", "due_date", "created_at"],
    "payments": ["payment_date"],
    "actions": ["action_date"],
    "schedule": ["scheduled_date", "completed_date", "cancelled_date"],
}
SCHEMAS = {
    "customers": CUSTOMERS_SCHEMA, "invoices": INVOICES_SCHEMA, "payments": PAYMENTS_SCHEMA,
    "actions": ACTIONS_SCHEMA, "schedule": SCHEDULE_SCHEMA,
}


# The spellings of the retail export's columns (letters and digits, lower case).
TRANSACTION_COLUMNS = {
    "invoice_no": ("invoiceno", "invoice"), "stock_code": ("stockcode",), "description": ("description",), "quantity": ("quantity",),
    "invoice_date": ("invoicedate",), "unit_price": ("unitprice", "price"), "customer_id": ("customerid",), "country": ("country",),
}


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    jpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(jpath)


def column_types(table: str) -> dict[str, str]:
    """Column -> type of a table's schema, in order."""
    return _types(SCHEMAS[table])


def _types(schema: str) -> dict[str, str]:
    return dict(column.split() for column in schema.split(", "))


def _read_csv(spark: SparkSession, path: str, types: dict[str, str]) -> DataFrame:
    """A CSV by its own header: the columns stand in the file's order with their known types (others are strings), and
    every file of a folder must have that header. A value that does not parse is NULL."""
    header = spark.read.option("header", True).csv(path).columns
    schema = ", ".join(f"`{c}` {types.get(c, 'string')}" for c in header)
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)


def read_table(spark: SparkSession, path: str, table: str, fmt: str | None = None, parse_dates: bool = True) -> DataFrame:
    """Read one table by column name; date strings become DATE (multi-format, bad -> NULL, DQ-14).

    The known columns come first, in the schema's order, then any others of the file. An optional column that the file
    lacks is NULL; a required one stays absent, so that DQ-1 reports it.
    """
    from receivables.operators.quality import REQUIRED

    fmt = fmt or ("parquet" if path.endswith(".parquet") else "csv")
    types = column_types(table)
    df = _read_csv(spark, path, types) if fmt == "csv" else spark.read.parquet(path)
    required = set(REQUIRED.get(table, ()))
    known = [F.col(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in types.items() if c in df.columns or c not in required]
    df = df.select(*known, *[F.col(f"`{c}`") for c in df.columns if c not in types])
    if parse_dates:
        for c in DATE_COLUMNS.get(table, []):
            if c in df.columns and dict(df.dtypes)[c] == "string":
                parsed = dates.parse_date(F.col(c))
                df = df.withColumn(c, parsed if table == "actions" else parsed.cast("date"))
    return df


CELL_FILE, CELL_RECORD = "_file", "_record"


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with every cell as its text: the columns of its header as strings, ``_file`` (the file's name) and ``_record``, the
    text of a line that does not have the header's number of cells (else NULL)."""
    header = spark.read.option("header", True).csv(path).columns
    schema = ", ".join(f"`{c}` string" for c in [*header, CELL_RECORD])
    # Without pruning, as a line's cells are counted only where all of them are parsed.
    reader = spark.read.schema(schema).option("header", True).option("columnNameOfCorruptRecord", CELL_RECORD).option("columnPruning", False)
    return reader.csv(path).select("*", F.col("_metadata.file_name").alias(CELL_FILE))


def cell_value(column: str, type_name: str, is_date: bool):
    """A cell's value, NULL where it is empty or cannot be read. Integers may be written with a zero fraction."""
    text = F.trim(F.col(f"`{column}`"))
    if is_date:
        return dates.parse_date(text)
    if type_name == "int":
        number = text.try_cast("double")
        return F.when(number == F.floor(number), number.try_cast("int"))
    if type_name == "double":
        number = text.try_cast("double")
        return F.when(~F.isnan(number), number)
    return F.col(f"`{column}`")


def typed_cells(cells: DataFrame, table: str) -> DataFrame:
    """The typed table of ``read_cells``: known columns first, unreadable cells NULL; ``_file`` and ``_record`` stay."""
    types, days = column_types(table), DATE_COLUMNS.get(table, [])
    known = []
    for c, t in types.items():
        if c in cells.columns:
            value = cell_value(c, t, c in days)
            known.append((value.cast("date") if c in days and table != "actions" else value).alias(c))
    return cells.select(*known, *[F.col(f"`{c}`") for c in cells.columns if c not in types])


def empty_table(spark: SparkSession, table: str) -> DataFrame:
    return spark.createDataFrame([], SCHEMAS[table])


class DataLoader:
    """SRC-1..SRC-6: load the receivables tables from a directory (CSV or parquet, by file name).

    ``customers`` and ``invoices`` are required (FileNotFoundError when missing); ``payments`` is optional
    (``None`` when missing, so callers take the no-payments branches); ``actions`` is optional and comes back empty.
    """

    def __init__(self, spark: SparkSession, data_dir: str):
        self.spark = spark
        self.data_dir = data_dir.rstrip("/")

    def _find(self, name: str) -> str | None:
        for ext in (".parquet", ".csv"):
            p = f"{self.data_dir}/{name}{ext}"
            if _exists(self.spark, p):
                return p
        return None

    def _required(self, name: str) -> DataFrame:
        p = self._find(name)
        if p is None:
            raise FileNotFoundError(f"{name} not found in {self.data_dir}")
        return read_table(self.spark, p, name)

    def load_customers(self) -> DataFrame:
        return self._required("customers")

    def load_invoices(self) -> DataFrame:
        return self._required("invoices")

    def load_payments(self) -> DataFrame | None:
        p = self._find("payments")
        return read_table(self.spark, p, "payments") if p else None

    def load_actions(self) -> DataFrame:
        p = self._find("actions")
        if p is None:
            return empty_table(self.spark, "actions")
        return read_table(self.spark, p, "actions")

    def bad_cells(self) -> DataFrame:
        """Cells and lines of the directory's CSV files that cannot be read (``quality.bad_cells`` of every table)."""
        from receivables.operators import quality

        out = self.spark.createDataFrame([], quality.CELL_SCHEMA)
        for name in ("customers", "invoices", "payments"):
            p = self._find(name)
            if p is not None and p.endswith(".csv"):
                out = out.unionByName(quality.bad_cells(read_cells(self.spark, p), name))
        return out

    def load_all(self, validate: bool = True):
        """SRC-5: all four tables; with ``validate`` raise when any DQ rule reports an error."""
        customers, invoices, payments, actions = (
            self.load_customers(), self.load_invoices(), self.load_payments(), self.load_actions()
        )
        if validate:
            from receivables.operators import quality

            errors = quality.validate_all(customers, invoices, payments).where(F.col("severity") == "error")
            first = errors.limit(5).collect()  # at most 5 example rows reach the driver
            if first:
                said = [f"{r['table']}/{r['rule']}/{r['key']}" for r in first]
                said += [f"{r['file']}: {r['message']} ({r['key']})" for r in self.bad_cells().limit(5).collect()]
                raise ValueError("Validation failed: " + "; ".join(said))
        return customers, invoices, payments, actions


def read_schedule(spark: SparkSession, path: str) -> DataFrame:
    """SRC-8: read a saved schedule and re-parse its dates."""
    return read_table(spark, path, "schedule")


def read_transactions(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    """SRC-7: raw retail lines, from the spreadsheet itself (``.xlsx``, or a folder of them with ``fmt="workbook"``) or its CSV
    export, by their header; columns renamed to the ingest vocabulary.

    ``line_no`` is a hash of the line's own columns: it gives lines of one invoice an order that does not depend on how the
    files are split (equal lines are interchangeable), nor on the format.
    """
    fmt = fmt or ("workbook" if path.endswith((".xlsx", ".xlsm")) else "csv")
    cells = workbook.read(spark, path) if fmt == "workbook" else spark.read.option("header", True).csv(path)
    header = {re.sub("[^a-z0-9]", "", c.lower()): c for c in cells.columns}
    names = {name: next((header[s] for s in spellings if s in header), None) for name, spellings in TRANSACTION_COLUMNS.items()}
    missing = [name for name, c in names.items() if c is None and name != "description"]
    if missing:
        raise ValueError(f"{path} has no column for {missing}")
    types = _types(TRANSACTIONS_SCHEMA)
    if fmt == "workbook":
        df = cells.select(*[F.col(f"`{c}`").try_cast(types[name]).alias(name) for name, c in names.items() if c])
    else:
        raw = _read_csv(spark, path, {c: types[name] for name, c in names.items() if c})
        df = raw.select(*[F.col(f"`{c}`").alias(name) for name, c in names.items() if c])
    return df.select(
        "invoice_no", "stock_code", F.xxhash64(*[F.col(n) for n in sorted(df.columns)]).alias("line_no"), "quantity", "unit_price",
        dates.parse_date(F.col("invoice_date")).alias("invoice_date"), F.col("customer_id").alias("customer_key"), "country",
    )


def save(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite", partition_by: list[str] | None = None) -> None:
    """SNK-1 / SNK-3: write a table (parent directories are created by the writer)."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.format(fmt).save(path)


def append(df: DataFrame, path: str, fmt: str = "parquet", batch_id: str | None = None) -> None:
    """SNK-2: append new rows (e.g. logged actions) instead of rewriting the table. With a ``batch_id`` the rows are a partition
    of that name, and a repeated append replaces it (Spark's dynamic partition overwrite)."""
    if batch_id is None:
        save(df, path, fmt=fmt, mode="append")
    else:
        tagged = df.withColumn("batch_id", F.lit(batch_id))
        tagged.write.format(fmt).mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").save(path)


def report(ar_summary: DataFrame, aging_summary: DataFrame, as_of) -> DataFrame:
    """SNK-4: one-row JSON-ready report {as_of, ar_summary, aging_summary[]} (write with ``save(fmt='json')``).

    The aging summary has at most six rows, so collecting it into an array inside one row is bounded.
    """
    from receivables.functions.expr import as_of_lit

    aging = aging_summary.agg(F.collect_list(F.struct(*aging_summary.columns)).alias("aging_summary"))
    return ar_summary.select(F.struct(*ar_summary.columns).alias("ar_summary")).crossJoin(aging).select(
        as_of_lit(as_of).cast("string").alias("as_of"), "ar_summary", "aging_summary"
    )
