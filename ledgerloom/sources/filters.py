"""Source filters: nine operators in the SQL dialect and in the text dialect of CSV samples.

Filters become Columns, never SQL strings, so that quoting can't go wrong and Parquet and JDBC scans get them pushed
down.  ``to_sql_where`` gives the text form for sources that take a WHERE clause.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPS = ("eq", "neq", "gt", "gte", "lt", "lte", "between", "in", "like")
SIGN = {"eq": "=", "neq": "!=", "gt": ">", "gte": ">=", "lt": "<", "lte": "<="}


@dataclass(frozen=True)
class FilterCondition:
    """value: a text, a number, or a list of texts."""

    column: str
    op: str
    value: str | float | tuple[str, ...]

    def __post_init__(self):
        if self.op not in OPS:
            raise ValueError(f"unknown filter operator {self.op!r}")
        v = self.value
        if isinstance(v, list):
            object.__setattr__(self, "value", v := tuple(v))
        if isinstance(v, bool) or not isinstance(v, (str, int, float, tuple)) or isinstance(v, tuple) and not all(isinstance(x, str) for x in v):
            raise ValueError(f"a filter value is a text, a number or a list of texts, not {v!r}")

    @classmethod
    def from_dict(cls, d: dict) -> FilterCondition:
        return cls(d["column"], d["op"], d["value"])

    @property
    def kind(self) -> str:
        return "text" if isinstance(self.value, str) else "list" if isinstance(self.value, tuple) else "number"

    @property
    def fits(self) -> bool:
        """Whether the value suits the operator; if not, the condition asks for less (see each dialect)."""
        if self.op in SIGN:
            return self.kind != "list"
        if self.op == "between":
            return self.kind == "list" and len(self.value) == 2
        return self.kind == ("list" if self.op == "in" else "text")


def format_number(n: float) -> str:
    """Whole numbers without a fraction, others in their shortest form."""
    if math.isfinite(n) and n == math.floor(n):
        return str(int(n))
    return repr(float(n)) if math.isfinite(n) else {"inf": "inf", "-inf": "-inf"}.get(str(n), "NaN")


def _compare(column: Column, op: str, value) -> Column:
    return {"eq": column.__eq__, "neq": column.__ne__, "gt": column.__gt__, "gte": column.__ge__, "lt": column.__lt__, "lte": column.__le__}[op](F.lit(value))


def _name(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def _whole(c: FilterCondition) -> FilterCondition:
    """A whole number given as a float, as JSON does, as an integer: compared with an integral column it then reaches the scan."""
    if isinstance(c.value, float) and c.value.is_integer() and abs(c.value) <= 1 << 53:
        return FilterCondition(c.column, c.op, int(c.value))
    return c


def sql_condition(c: FilterCondition) -> Column:
    """The SQL dialect: types compare as types, null rows drop, a value that doesn't suit asks for not null."""
    column = _name(c.column)
    if not c.fits:
        return column.isNotNull()
    if c.op in SIGN:
        return _compare(column, c.op, c.value)
    if c.op == "between":
        return column.between(F.lit(c.value[0]), F.lit(c.value[1]))
    if c.op == "in":
        return column.isin(*c.value) if c.value else F.lit(False)
    return column.like(c.value)


def csv_condition(c: FilterCondition) -> Column:
    """The text dialect: cells compare as text, an empty cell is an empty text, LIKE ignores case and knows no escape."""
    cell = F.coalesce(_name(c.column).cast("string"), F.lit(""))
    if not c.fits:
        return F.lit(True)
    if c.op in SIGN:
        return _compare(cell, c.op, c.value if c.kind == "text" else format_number(c.value))
    if c.op == "between":
        return (cell >= c.value[0]) & (cell <= c.value[1])
    if c.op == "in":
        return cell.isin(*c.value) if c.value else F.lit(False)
    return cell.ilike(c.value.replace("\\", "\\\\"))


def apply_filters(df: DataFrame, conditions: list[FilterCondition], dialect: str = "sql") -> DataFrame:
    """All conditions hold.  The text dialect skips unknown columns; the SQL dialect raises."""
    if dialect == "csv":
        conditions = [c for c in conditions if c.column in df.columns]
    kinds = {name.lower(): kind for name, kind in df.dtypes}
    conditions = [_whole(c) if kinds.get(c.column.lower()) in ("tinyint", "smallint", "int", "bigint") else c for c in conditions]
    own = [(csv_condition if dialect == "csv" else sql_condition)(c) for c in conditions]
    return df.where(reduce(Column.__and__, own)) if own else df


def to_sql_where(conditions: list[FilterCondition]) -> str:
    """A WHERE clause with a leading space; empty without conditions."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"

    def one(c: FilterCondition) -> str:
        column = '"' + c.column.replace('"', '""') + '"'
        literal = format_number(c.value) if c.kind == "number" else quoted(c.value) if c.kind == "text" else ""
        if not c.fits:
            return f"{column} IS NOT NULL"
        if c.op in SIGN:
            return f"{column} {SIGN[c.op]} {literal}"
        if c.op == "between":
            return f"{column} BETWEEN {quoted(c.value[0])} AND {quoted(c.value[1])}"
        if c.op == "in":
            return f"{column} IN ({', '.join(map(quoted, c.value))})" if c.value else "FALSE"
        return f"{column} LIKE {literal}"

    return " WHERE " + " AND ".join(map(one, conditions)) if conditions else ""


#: What a filter chip of a given type asks for, where it has no operator of its own.
CHIP_OPS = {"date_range": "between", "amount_range": "gte", "text_match": "like"}


def chip_conditions(chips: list[dict], side: str, columns: list[str]) -> list[FilterCondition]:
    """Conditions of one side from filter chips: {scope, field_a, field_b, type, value, op?, raw_value?}.  Chips on unknown columns drop."""
    out = []
    for chip in chips:
        column = chip.get("field_a" if side == "left" else "field_b")
        if chip.get("scope") not in ("both", side) or column not in columns:
            continue
        kind, value = chip.get("type"), chip.get("value")
        if chip.get("op") and chip.get("raw_value") is not None:
            out.append(FilterCondition(column, chip["op"], chip["raw_value"]))
        elif kind in CHIP_OPS and (isinstance(value, (list, tuple)) if kind == "date_range" else value is not None):
            out.append(FilterCondition(column, CHIP_OPS[kind], f"%{value}%" if kind == "text_match" else value))
    return out
