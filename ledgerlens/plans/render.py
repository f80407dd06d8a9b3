"""Invoices rendered from orders: a round trip whose truth is known from columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.plans.runtime import table

LAYOUTS = 3


def invoices(spark: SparkSession, folder: str) -> DataFrame:
    """``(o_orderkey, truth..., pages)``: one invoice for each order that has a customer, in one of three layouts.

    English with ISO dates, Spanish with decimal commas and day-first dates, and a table of labels that is followed by its values.
    """
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    customers = table(spark, folder, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    df = orders.join(customers, "o_custkey")
    total = F.col("o_totalprice").cast("decimal(18,2)")
    df = df.withColumns({
        "layout": F.pmod("o_orderkey", F.lit(LAYOUTS)).cast("int"), "total": total, "subtotal": F.round(total / F.lit("1.21").cast("decimal(4,2)"), 2).cast("decimal(18,2)"),
        "issued": F.to_date("o_orderdate"), "number": F.format_string("INV-%08d", F.col("o_orderkey")), "supplier": F.format_string("Nation %02d Works Ltd", F.col("c_nationkey")),
        "customer": F.format_string("Harbour House %d GmbH", F.col("o_custkey")), "vat": F.format_string("GB%09d", F.pmod(F.col("o_custkey") * 7919, F.lit(1_000_000_000))),
        "customer_vat": F.format_string("DE%09d", F.col("o_custkey")),
    }).withColumn("tax", (F.col("total") - F.col("subtotal")).cast("decimal(18,2)"))
    en = lambda c: F.format_number(F.col(c), 2)
    es = lambda c: F.translate(F.format_number(F.col(c), 2), ",.", ".,")
    english = F.concat(
        F.col("supplier"), F.lit("\nVAT Reg. No: "), F.col("vat"), F.lit("\n\nINVOICE\n\nInvoice No: "), F.col("number"), F.lit("\nInvoice date: "), F.date_format("issued", "yyyy-MM-dd"),
        F.lit("\n\nBill to:\n"), F.col("customer"), F.lit("\nVAT: "), F.col("customer_vat"), F.lit("\n\nSubtotal   "), en("subtotal"), F.lit("\nVAT 21%   "), en("tax"), F.lit("\nTotal due (EUR)   "), en("total"), F.lit("\n"),
    )
    spanish = F.concat(
        F.lit("FACTURA\nFactura nº: "), F.col("number"), F.lit("\n\nEmisor: "), F.col("supplier"), F.lit("\nNIF: "), F.col("vat"), F.lit("\n\nFacturar a:\n"), F.col("customer"), F.lit("\nNIF: "),
        F.col("customer_vat"), F.lit("\n\nFecha de emisión: "), F.date_format("issued", "dd/MM/yyyy"), F.lit("\nBase imponible: "), es("subtotal"), F.lit(" €\nIVA 21%: "), es("tax"), F.lit(" €\nTotal a pagar: "),
        es("total"), F.lit(" €\n"),
    )
    values = F.concat(
        F.lit("From: "), F.col("supplier"), F.lit("\nVAT number: "), F.col("vat"), F.lit("\nInvoice "), F.col("number"), F.lit("\nDate of issue:\n"), F.date_format("issued", "d MMMM yyyy"),
        F.lit("\n\nSold to: "), F.col("customer"), F.lit("\nVAT: "), F.col("customer_vat"), F.lit("\n\nSUMMARY\nNet amount\nTotal VAT\nTotal amount\n"), en("subtotal"), F.lit("\n"), en("tax"), F.lit("\n"), en("total"),
        F.lit("\nAll amounts in GBP\n"),
    )
    text = F.when(F.col("layout") == 0, english).when(F.col("layout") == 1, spanish).otherwise(values)
    return df.select("o_orderkey", "layout", F.array(text).alias("pages"))
