"""The closed-form token estimate as a column expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The code point ranges that count one token a character.
CJK_RANGES = [(0x4E00, 0x9FFF), (0x3400, 0x4DBF), (0x20000, 0x2A6DF), (0x2A700, 0x2B73F), (0x2B740, 0x2B81F), (0xF900, 0xFAFF), (0x3007, 0x3007)]


def cjk_class() -> str:
    return "".join(rf"\x{{{a:X}}}" if a == b else rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in CJK_RANGES)


def approx_tokens(text: Column) -> Column:
    """floor(ASCII bytes / 4 + CJK characters + other UTF-8 bytes / 2) as a long. Every term is a multiple of a quarter, so doubles are exact."""
    ascii_only = F.length(F.regexp_replace(text, r"[^\x00-\x7F]", ""))
    cjk = F.regexp_replace(text, f"[^{cjk_class()}]", "")
    other = F.octet_length(text) - ascii_only - F.octet_length(cjk)
    return F.floor(ascii_only / F.lit(4.0) + F.length(cjk) + other / F.lit(2.0)).cast("long")


def approx_tokens_binary(content: Column) -> Column:
    """The same for bytes; those that are not UTF-8 count half a token per byte above 127 and a quarter per other byte."""
    as_text = content.cast("string")
    latin = F.decode(content, "ISO-8859-1")
    low = F.length(F.regexp_replace(latin, r"[^\x00-\x7F]", ""))
    rough = F.floor(low / F.lit(4.0) + (F.length(latin) - low) / F.lit(2.0)).cast("long")
    return F.when(F.is_valid_utf8(as_text), approx_tokens(as_text)).otherwise(rough)
