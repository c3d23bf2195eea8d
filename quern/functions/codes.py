"""Error codes. Numbers and names of the error codes that validation reports."""

from __future__ import annotations

CODES = {
    "NONE": 0x00, "UNEXPECTED_TOKEN": 0x01, "NOT_INTEGER": 0x02, "NUMBER": 0x03, "TOO_FEW_PROPS": 0x04, "TOO_MANY_PROPS": 0x05, "MISSING_REQUIRED_PROPERTIES": 0x06,
    "SPLIT_CONDITION": 0x07, "BAD_PROPERTY_NAME": 0x08, "MATCH_CASE": 0x09, "STRING": 0x0A, "LENGTH_TOO_SHORT": 0x0B, "LENGTH_TOO_LONG": 0x0C, "ARRAY": 0x0D,
    "TOO_FEW_ITEMS": 0x0E, "TOO_MANY_ITEMS": 0x0F, "UNSATISFIED_CONTAINS": 0x10, "NOT_MULTIPLE": 0x11, "NOT_UNIQUE": 0x12, "JSON": 0x20,
}
NAMES = {v: k for k, v in CODES.items()}
