"""Labels, recordings, XML and the sinks: reports, baselines and the request log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.functions.dates import compact_date
from ledgerlens.functions.words import FIELDS

LABEL = (
    "document string, source string, reference_date date, config struct<document_type:string,max_age_days:int,allowed_currencies:array<string>,required_fields:array<string>,"
    "expected_customer_tax_id:string>, difficulty array<string>, expected struct<" + ",".join(f"{f}:string" for f in FIELDS) + ",verdict:string>, notes string"
)
RECORDING = "text string, model string, input_tokens bigint, output_tokens bigint, latency_ms bigint, cache_read_tokens bigint, cache_write_tokens bigint"


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """Every label file below a folder (``*.expected.json``, one object each), with ``case_id`` from its name."""
    files = spark.read.schema(LABEL).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.expected.json").json(path)
    return files.withColumn("case_id", F.regexp_extract(F.input_file_name(), r"([^/]+)\.expected\.json$", 1))


def read_cases(spark: SparkSession, path: str, members: DataFrame | None = None, config: Column | None = None) -> DataFrame:
    """The label files below a folder, in the order of their names; only those whose ``case_id`` is in ``members`` (a split), and with
    ``config`` where a file has none."""
    cases = read_labels(spark, path)
    if members is not None:
        cases = cases.join(members.select("case_id").distinct(), "case_id", "left_semi")
    if config is not None:
        kind = cases.schema["config"].dataType
        cases = cases.withColumn("config", F.coalesce("config", config.cast(kind)))
    return cases.orderBy("case_id")


def default_config() -> Column:
    """The configuration of cases that state none: ninety days, two currencies, four fields."""
    words = lambda *w: F.array(*map(F.lit, w))
    return F.struct(
        F.lit("invoice").alias("document_type"), F.lit(90).alias("max_age_days"), words("EUR", "GBP").alias("allowed_currencies"),
        words("supplier_name", "invoice_number", "invoice_date", "total_amount").alias("required_fields"), F.lit(None).cast("string").alias("expected_customer_tax_id"),
    )


def read_recording_files(spark: SparkSession, path: str) -> DataFrame:
    """Recorded replies ``<folder>/<model>/<32 hex digits>.json``, one file each, as a table keyed by folder and request."""
    files = spark.read.schema(RECORDING).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(path)
    name = F.input_file_name()
    return files.withColumns({"asked_model": F.regexp_extract(name, r"([^/]+)/[^/]+\.json$", 1), "request_key": F.regexp_extract(name, r"([0-9a-f]{32})\.json$", 1), "recorded": F.lit(True)})


STORED = f"request_key string, asked_model string, {RECORDING}"


def read_recordings(spark: SparkSession, path: str) -> DataFrame:
    """The table that ``write_recordings`` appends to; all that is in it is recorded."""
    return spark.read.schema(STORED).parquet(path).withColumn("recorded", F.lit(True))


def write_recordings(df: DataFrame, path: str) -> None:
    """Appends replies that were missing, in files by model; key and model are stored with them, ``recorded`` is not."""
    columns = [c.strip().split(" ") for c in STORED.split(",")]
    df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in columns]).write.mode("append").partitionBy("asked_model").parquet(path)


def read_ground_truth(spark: SparkSession, path: str, column: str = "ground_truth") -> DataFrame:
    """The JSON of a Parquet column of ground truth, one row each: ``document`` (the file and its place in it) and ``gt`` as a variant. Only that column is read."""
    rows = spark.read.parquet(path)
    return rows.select(F.concat_ws("#", F.col("_metadata.file_name"), F.col("_metadata.row_index").cast("string")).alias("document"), F.try_parse_json(column).alias("gt"))


def xml_fields(xml: Column) -> Column:
    """The ten fields of an embedded CII invoice; the amount in the currency of the invoice is preferred, tax ids with scheme VA."""
    one = lambda p: F.nullif(F.xpath_string(xml, F.lit(p)), F.lit(""))
    local = lambda *names: "".join(f"/*[local-name()='{n}']" for n in names)
    any_ = lambda *names: "//*[local-name()='" + names[0] + "']" + local(*names[1:])
    party = lambda role: any_(f"{role}TradeParty")
    vat = lambda role: party(role) + local("SpecifiedTaxRegistration", "ID") + "[@schemeID='VA']"
    currency = one(any_("InvoiceCurrencyCode"))
    total = any_("SpecifiedTradeSettlementHeaderMonetarySummation")
    money = lambda name: (F.coalesce(one(f"{total}{local(name)}[@currencyID=//*[local-name()='InvoiceCurrencyCode']]"), one(total + local(name)))).try_cast("decimal(38,6)")
    made = {
        "supplier_name": one(party("Seller") + local("Name")), "invoice_number": one(any_("ExchangedDocument", "ID")),
        "invoice_date": compact_date(one(any_("ExchangedDocument", "IssueDateTime", "DateTimeString"))), "total_amount": money("GrandTotalAmount"), "currency": currency,
        "tax_id": one(vat("Seller")), "subtotal_amount": money("TaxBasisTotalAmount"), "tax_amount": money("TaxTotalAmount"), "customer_name": one(party("Buyer") + local("Name")),
        "customer_tax_id": one(vat("Buyer")),
    }
    return F.struct(*[made[f].alias(f) for f in FIELDS])


def audit(df: DataFrame, text: str = "text") -> DataFrame:
    """One JSON line for each request without its content: length and the first 16 figures of the hash."""
    own = [c for c in df.columns if c != text]
    return df.select(F.to_json(F.struct(*own, F.length(text).alias("chars"), F.substring(F.sha2(text, 256), 1, 16).alias("document_hash"))).alias("line"))


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The rows of ``new``, and those of ``old`` whose key it has not; columns of ``new`` that are null keep their old value."""
    columns = [c for c in new.columns if c != key]
    return old.alias("o").join(new.alias("n"), key, "full").select(key, *[F.coalesce(f"n.{c}", f"o.{c}").alias(c) for c in columns])


def markdown(df: DataFrame, columns: list[str], title: str | None = None) -> DataFrame:
    """A report as ``(place, line)``: the title, the head of a Markdown table, and a line for each row in the order of the columns."""
    head = ([f"# {title}", ""] if title else []) + ["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns)]
    top = df.sparkSession.createDataFrame(list(enumerate(head)), "place int, line string")
    cell = lambda c: F.replace(F.coalesce(F.col(c).cast("string"), F.lit("n/a")), F.lit("|"), F.lit("\\|"))
    rows = df.orderBy(*columns).select(F.lit(len(head)).alias("place"), F.concat(F.lit("| "), F.concat_ws(" | ", *map(cell, columns)), F.lit(" |")).alias("line"))
    return top.unionByName(rows).orderBy("place", "line")


def write_report(df: DataFrame, path: str, columns: list[str], title: str | None = None) -> None:
    """The report as one text file in a folder; reports have as many lines as there are configurations."""
    markdown(df, columns, title).coalesce(1).sortWithinPartitions("place", "line").select("line").write.mode("overwrite").text(path)
