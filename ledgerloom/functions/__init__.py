"""Scalar functions, as Columns and as SQL functions of a session."""

from ledgerloom.functions.scalars import SQL_FUNCTIONS, field_name, js_number, key_of, register, relative_match, signed_relative_match, text_of, tolerance_match

__all__ = ["SQL_FUNCTIONS", "field_name", "js_number", "key_of", "register", "relative_match", "signed_relative_match", "text_of", "tolerance_match"]
