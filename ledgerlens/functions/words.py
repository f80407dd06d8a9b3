"""Word lists that dates, amounts and identifiers are read with; fixed values, in natural order."""

from __future__ import annotations

# Names and short forms of the months in English, Spanish, French, German, Italian, Portuguese, Dutch and
# Polish, lower case and without accents.
MONTH_NAMES: tuple[str, ...] = (
    "january jan enero janvier janv januar janner gennaio janeiro januari stycznia",
    "february feb febrero fevrier fevr februar febbraio fevereiro februari lutego",
    "march mar marzo mars marz marco maart marca",
    "april apr abril avril avr aprile kwietnia",
    "may mayo mai maggio maio mei maja",
    "june jun junio juin juni giugno junho czerwca",
    "july jul julio juillet juil juli luglio julho lipca",
    "august aug agosto aout augustus sierpnia",
    "september sep sept septiembre setiembre septembre settembre setembro wrzesnia",
    "october oct octubre octobre oktober okt ottobre outubro pazdziernika",
    "november nov noviembre novembro listopada",
    "december dec diciembre decembre dezember dez dicembre dezembro grudnia",
)
MONTHS: dict[str, int] = {name: k for k, names in enumerate(MONTH_NAMES, 1) for name in names.split()}

# Short forms that p2 also reads, beyond those above.
MORE_MONTHS: dict[str, int] = {
    "ene": 1, "fev": 2, "mrt": 3, "mrz": 3, "abr": 4, "mag": 5, "giu": 6, "lug": 7, "ago": 8, "set": 9, "out": 10, "ott": 10, "novembre": 11, "dic": 12, "gen": 1,
    "styczen": 1, "luty": 2, "marzec": 3, "kwiecien": 4, "maj": 5, "czerwiec": 6, "lipiec": 7, "sierpien": 8, "wrzesien": 9, "pazdziernik": 10, "listopad": 11, "grudzien": 12,
}

#: Letters with accents and their plain form, for ``translate``; sharp s is two letters and is replaced apart.
ACCENTED = "àáâãäåāăąçćčďđèéêëēėęěìíîïīįłñńňòóôõöøōőřśšşťùúûüūůűýÿźżž"
UNACCENTED = "aaaaaaaaacccddeeeeeeeeiiiiiilnnnoooooooorssstuuuuuuuyyzzz"

# Codes that are read as a currency, currencies with three decimals, and what a document must not be taken for.
ISO_CURRENCIES: tuple[str, ...] = tuple(
    "EUR GBP USD CHF SEK NOK DKK ISK PLN CZK HUF RON BGN RSD UAH RUB TRY ILS AED SAR QAR KWD BHD OMR EGP MAD NGN KES "
    "ZAR INR PKR BDT LKR CNY HKD TWD JPY KRW SGD MYR THB IDR PHP VND AUD NZD CAD MXN BRL ARS CLP COP PEN UYU JOD TND LYD IQD".split()
)
THREE_DECIMALS: tuple[str, ...] = ("KWD", "BHD", "OMR", "JOD", "TND", "LYD", "IQD")
# Symbols, longer ones first; the flag tells that several currencies share it.
SYMBOLS: tuple[tuple[str, str, bool], ...] = (
    ("US$", "USD", False), ("AU$", "AUD", False), ("CA$", "CAD", False), ("NZ$", "NZD", False), ("HK$", "HKD", False), ("MX$", "MXN", False), ("NT$", "TWD", False),
    ("A$", "AUD", False), ("C$", "CAD", False), ("S$", "SGD", False), ("R$", "BRL", False), ("$", "USD", True), ("€", "EUR", False), ("£", "GBP", False),
    ("₹", "INR", False), ("₩", "KRW", False), ("₺", "TRY", False), ("₽", "RUB", False), ("₪", "ILS", False), ("₫", "VND", False), ("฿", "THB", False), ("¥", "JPY", True),
)
# Written names of currencies, as patterns of the JVM.
CURRENCY_WORDS: tuple[tuple[str, str, bool], ...] = (
    (r"(?iu)(?<!\p{L})(?:zł|złotych|złoty|zloty)(?!\p{L})", "PLN", False), (r"(?<!\p{L})Kč(?!\p{L})", "CZK", False), (r"(?<!\p{L})(?:Ft|forint)(?!\p{L})", "HUF", False),
    (r"(?<!\p{L})kr\.?(?!\p{L})", "SEK", True), (r"(?U)(?<!\p{L})S?Fr\.(?!\w)", "CHF", False), (r"(?iuU)\b(?:swiss francs?|francs? suisses?|schweizer franken)\b", "CHF", False),
    (r"(?iuU)\beuros?\b", "EUR", False), (r"(?iuU)\bpounds? sterling\b", "GBP", False), (r"(?iuU)\bus dollars?\b", "USD", False), (r"(?iuU)\brupees?\b", "INR", False),
    (r"(?iuU)\byen\b", "JPY", False),
)
# Prefixes of VAT numbers, those of them outside the EU scheme, and the states of US addresses.
VAT_PREFIXES: tuple[str, ...] = tuple("AT BE BG CY CZ DE DK EE EL ES FI FR GB HR HU IE IT LT LU LV MT NL PL PT RO SE SI SK XI CH NO".split())
NOT_EU_VAT: tuple[str, ...] = ("CH", "NO")
US_STATES: tuple[str, ...] = tuple(
    "AL AK AZ AR CA CO CT DE DC FL GA HI ID IL IN IA KS KY LA ME MD MA MI MN MS MO MT NE NV NH NJ NM NY NC ND OH OK OR PA RI SC SD TN TX UT VT VA WA WV WI WY".split()
)
# Titles of credit notes, looked for in the first lines that are not blank.
CREDIT_NOTE = (
    r"(?iuU)\b(?:credit\s+note|credit\s+memo|nota\s+de\s+cr[eé]dito|nota\s+de\s+abono|factura\s+de\s+abono|avoir|gutschrift|nota\s+di\s+credito|creditnota|creditfactuur)\b"
)
TITLE_LINES = 15
#: The ten fields in their order, and the kinds among them.
FIELDS: tuple[str, ...] = (
    "supplier_name", "invoice_number", "invoice_date", "total_amount", "currency", "tax_id", "subtotal_amount", "tax_amount", "customer_name", "customer_tax_id",
)
AMOUNT_FIELDS: tuple[str, ...] = ("total_amount", "subtotal_amount", "tax_amount")
ID_FIELDS: tuple[str, ...] = ("invoice_number", "tax_id", "customer_tax_id")
BRIEF_FIELDS: tuple[str, ...] = FIELDS[:6]
