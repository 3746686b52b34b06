"""Column helpers: values, fields and multi-valued columns."""

from weftline.functions.values import as_boolean, as_double, as_long, as_text, condition, fields, first, is_multi, is_record, records, strip_tokens, value

__all__ = ["as_boolean", "as_double", "as_long", "as_text", "condition", "fields", "first", "is_multi", "is_record", "records", "strip_tokens", "value"]
