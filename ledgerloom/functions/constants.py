"""Names, patterns and word lists that results depend on. Kept together, as plain text, in natural order."""

# The standard transaction schema, in output order.
STANDARD_COLUMNS = ("EGP Converter", "EGP", "GBP", "Euros", "USD", "V.NO", "Hotel", "Date", "Adult", "Child", "Inf", "Total", "Notes", "Net")
MONEY_COLUMNS = ("EGP", "GBP", "Euros", "USD", "Total", "Net", "EGP Converter")
COUNT_COLUMNS = ("Adult", "Child", "Inf")
TEXT_COLUMNS = ("V.NO", "Hotel")

# Columns of a JSON reply's rows, in their order; replies with others are rejected.
REPLY_COLUMNS = ("Date", "Hotel", "V.NO", "Adult", "Child", "Inf", "EGP", "USD", "Euros", "GBP", "Total", "Net", "Notes")

# Exchange rates to EGP unless others are given.
RATES = {"USD": 50.0, "Euros": 55.0, "GBP": 65.0}

# Aliases by standard column (lower case); other lists would map headers otherwise.
ALIASES = {
    "Date": ["date", "dt", "day", "date of service", "service date", "invoice date", "trip date", "التاريخ", "تاريخ", "اليوم"],
    "Hotel": ["hotel", "hotel name", "property", "resort", "الفندق", "فندق", "الاوتيل", "الأوتيل"],
    "V.NO": ["v.no", "v no", "vno", "voucher", "voucher no", "voucher number", "no.", "n.", "ref", "reference", "رقم", "فاوتشر", "رقم الفاوتشر"],
    "Adult": ["adult", "adults", "ad.", "pax", "بالغ", "بالغين", "فرد", "أفراد"],
    "Child": ["child", "children", "ch.", "chd", "طفل", "أطفال", "اطفال"],
    "Inf": ["inf", "infant", "infants", "inf.", "رضيع", "رضع"],
    "Total": ["total", "totals", "subtotal", "grand total", "cost", "amount", "price", "collect", "collection", "اجمالي", "إجمالي", "الإجمالي", "الاجمالي", "التكلفة", "السعر", "المجموع"],
    "Net": ["net", "net invoice", "net amount", "صافي", "الصافي", "صافى"],
    "USD": ["usd", "us$", "dollar", "dollars", "دولار"],
    "Euros": ["eur", "euro", "euros", "eue", "يورو"],
    "GBP": ["gbp", "pound", "pounds", "sterling", "£", "استرليني"],
    "EGP": ["egp", "l.e", "le", "cash le", "rest le", "egyptian pound", "egyptian pounds", "جنيه", "م.ج", "ج.م", "الجنيه المصري"],
    "EGP Converter": ["egp converter", "egp conveter", "converter", "conveter", "conversion", "conv"],
    "Notes": ["notes", "note", "remarks", "remark", "comment", "comments", "ملاحظات", "ملاحظة", "ملحوظات"],
}

# Thresholds of fuzzy header matching.
FUZZY_ACCEPT = 0.80
PROFILE_KEY_MATCH = 0.85
PROFILE_COVERAGE = 0.6
TEMPLATE_LABEL_MATCH = 0.50

# Patterns of currencies, totals and labels as documents write them; i: in either case.
CID = r"\(cid:\d+\)"
ARABIC = r"[؀-ۿݐ-ݿࢠ-ࣿﭐ-﷿ﹰ-﻿]"
CURRENCY_CODE = r"(?iU)\b(EGP|USD|EUR|EURO|GBP|POUNDS?|L\.?E)\b"
CURRENCY_SYMBOL = r"[$€£¥]"
CONVERTER_HEADER = r"(?iU)convert|conveter|\bconv\b"
TOTAL_HEADER = r"(?iU)\b(total|sub\s?total|grand|cost|net|amount|price|collect\w*|balance|due)\b"
CURRENCY_HEADERS = (
    ("GBP", r"(?iU)eng\s*\$"),
    ("USD", r"(?iU)\$|us\$|\busd\b|\bdollars?\b"),
    ("Euros", r"(?iU)€|\beur\b|\beuros?\b|\beue\b"),
    ("EGP", r"(?iU)\begp\b|l\.e\.?|\ble\b|egyptian pounds?|جنيه|م\.ج|ج\.م"),
    ("GBP", r"(?iU)£|\bgbp\b|\bpounds?\b|sterling"),
)
SUMMARY_LABEL = r"(?iU)\b(total|sub\s?total|grand\s?total|collection|net)\b"
SUMMARY_CELL = r"(?iU)^(total|sub\s?total|grand\s?total|rest|net|collection|cost)\s*:"
SUMMARY_ROW = r"(?iU)^(total|sub\s?total|grand\s?total|net)\b"
INVOICE_LABEL = r"(?iU)\binvoice\s*(?:no|num|number|date)\b\.?"

# Words that tell amounts, totals and texts apart in headers and first cells.
MONEY_HEADER_WORDS = ("usd", "egp", "eur", "eue", "euro", "gbp", "pound", "collect", "cost", "net", "total", "amount", "price", "dollar", "egy le", "cash")
TOTAL_LABELS = ("total", "totals", "grand total", "subtotal", "sub total")
SUMMARY_WORDS = (
    "total", "totals", "subtotal", "sub total", "grand total", "net", "collection", "collected", "cost", "costs", "rest", "price", "amount",
    "اجمالي", "إجمالي", "الإجمالي", "الاجمالي", "صافي", "الصافي", "المجموع", "مجموع", "الباقي",
)
TEXT_HEADER_WORDS = ("date", "hotel", "v.no", "voucher", "room", "guest", "name", "tour", "trip", "nat", "info", "note", "contact", "phone", "tel")
MONEY_OVERRIDE_WORDS = ("$", "€", "£", "usd", "egp", "eur", "gbp", "cost", "total", "rest")
NUMERIC_HEADER_WORDS = (
    "rest", "rate", "paid", "balance", "price", "amount", "cost", "total", "net",
    "adult", "adults", "child", "children", "ch", "inf", "infant", "infants", "pax", "count", "qty", "quantity", "dive", "intro",
    "اجمالي", "إجمالي", "الإجمالي", "الاجمالي", "صافي", "الصافي", "المجموع", "مجموع", "الباقي", "باقي", "سعر", "مبلغ", "تكلفة", "مدفوع", "كبار", "أطفال", "اطفال", "رضع", "عدد",
)
BLANK_MARKS = ("", "-", "--", "—")
LABEL_COLUMNS = ("Hotel", "Date", "V.NO", "Notes")

# File types that are read.
IMAGE_SUFFIXES = (".jpg", ".jpeg", ".png")
DOCUMENT_SUFFIXES = (".pdf", ".jpg", ".jpeg", ".png")

# Layout thresholds in pixels and fractions, which decide rows and columns.
OCR_CHARS_PER_PAGE = 40
ROW_TOLERANCE = 0.5
GUTTER_SHARE = 0.012
HEADER_LEAST_BOXES = 4
HEADER_LEAST_SPAN = 0.6
HEADER_MERGE_SHARE = 0.005
SNAP_TOLERANCE = 0.6
REVIEW_TOLERANCE = 1.0
