"""IP address test."""

from pyspark.sql import Column
from pyspark.sql import functions as F

_BYTE = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IPV4 = rf"{_BYTE}(?:\.{_BYTE}){{3}}"
_GROUP = "[0-9a-fA-F]{1,4}"


def _ipv6() -> str:
    """Eight groups, or fewer with one ``::``; the last two groups may be an IPv4 address."""
    forms = [f"(?:{_GROUP}:){{7}}{_GROUP}", f"(?:{_GROUP}:){{6}}{IPV4}"]
    for before in range(8):
        head = f"(?:{_GROUP}(?::{_GROUP}){{{before - 1}}})" if before else ""
        after = 7 - before
        tail = f"(?:{_GROUP}(?::{_GROUP}){{0,{after - 1}}})?" if after else ""
        forms.append(f"{head}::{tail}")
        if after >= 2:
            forms.append(f"{head}::(?:{_GROUP}:){{0,{after - 2}}}{IPV4}")
    return "|".join(forms)


IPV6 = _ipv6()


def is_ip(text: Column) -> Column:
    return text.rlike(rf"\A(?:{IPV4})\z") | text.rlike(rf"\A(?:{IPV6})\z")
