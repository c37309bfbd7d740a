from commsight.functions.text import (
    asn_label,
    blank_to_null,
    code_case,
    last_token,
    linked_name,
    normalize_text,
    percent_text,
    percent_value,
    status_label,
    strip_suffix,
    strip_text,
    title_case,
    words,
)

__all__ = [
    "asn_label",
    "blank_to_null",
    "code_case",
    "last_token",
    "linked_name",
    "normalize_text",
    "percent_text",
    "percent_value",
    "status_label",
    "strip_suffix",
    "strip_text",
    "title_case",
    "words",
]
