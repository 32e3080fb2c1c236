"""Column functions on readings: one spelling for values that several readers wrote."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Full-width, Arabic-Indic and extended Arabic-Indic digits, decimal commas and minus signs.
ODD = "０１２３４５６７８９" + "٠١٢٣٤٥٦٧٨٩" + "۰۱۲۳۴۵۶۷۸۹" + ",，．٫" + "−–—‐‑‒－﹣" + "＋"
PLAIN = "0123456789" * 3 + "...." + "--------" + "+"
#: Blanks inside a reading, all dropped: Unicode white space and zero-width characters.
BLANKS = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85   " + "".join(map(chr, range(0x2000, 0x200E))) + "    　⁠﻿"


def plain_reading(value: Column) -> Column:
    """Without blanks, with a decimal point, a plain minus, ordinary digits and no leading plus; '' becomes null."""
    return F.nullif(F.ltrim(F.translate(value, ODD + BLANKS, PLAIN), F.lit("+")), F.lit(""))
