"""Derived columns (P10-P12): convention products and products named in a plan."""

from __future__ import annotations

import ast
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.names import resolve_column


def _q(name: str) -> Column:
    return F.col(f"`{name}`")


def product(df: DataFrame, a: str, b: str) -> Column:
    """``a * b``; whole-number columns multiply as decimals, so no product overflows."""
    whole = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
    if all(isinstance(df.schema[c].dataType, whole) for c in (a, b)):
        return (_q(a).cast("decimal(19,0)") * _q(b).cast("decimal(19,0)")).cast("decimal(38,0)")
    return _q(a) * _q(b)


def _parsed(text: str | None) -> ast.AST | None:
    try:
        return ast.parse((text or "").strip(), mode="eval")
    except SyntaxError:
        return None


def _reference(node: ast.AST) -> str | None:
    """The name in ``df['name']``."""
    if isinstance(node, ast.Subscript) and isinstance(node.value, ast.Name) and node.value.id == "df" and isinstance(node.slice, ast.Constant):
        return node.slice.value if isinstance(node.slice.value, str) else None
    return None


def _in_order(text: str | None) -> Iterator[ast.AST]:
    """The nodes of a formula in the order they are written."""
    tree = _parsed(text)
    nodes = [n for n in ast.walk(tree) if isinstance(n, ast.expr)] if tree else []
    return iter(sorted(nodes, key=lambda n: (n.lineno, n.col_offset, -n.end_col_offset)))


def convention_columns(df: DataFrame) -> DataFrame:
    """P10: ``quantity*unitprice -> total_sales``, ``price*qty -> total_amount``,
    ``revenue := total_sales`` when there is no ``revenue``. One projection."""
    cols = set(df.columns)
    new: dict[str, Column] = {}
    if {"quantity", "unitprice"} <= cols:
        new["total_sales"] = product(df, "quantity", "unitprice")
    if {"price", "qty"} <= cols:
        new["total_amount"] = product(df, "price", "qty")
    if "revenue" not in cols and ("total_sales" in cols or "total_sales" in new):
        new["revenue"] = new.get("total_sales", _q("total_sales"))
    return df.withColumns(new) if new else df


def plan_texts(plan: dict) -> list[str]:
    """Formula texts of a plan that may name products: KPI formulas and chart y columns
    written with parentheses."""
    out = [k.get("formula") or "" for k in plan.get("kpis", []) or []]
    for c in plan.get("charts", []) or []:
        y = c.get("y_column") or ""
        if "(" in y and ")" in y:
            out.append(y)
    return out


def references(text: str | None) -> list[str]:
    """The column names a formula refers to as ``df['name']``, in order."""
    return [r for r in map(_reference, _in_order(text)) if r is not None]


def product_columns(df: DataFrame, texts: list[str]) -> DataFrame:
    """Every product of two column references becomes ``a_b_product`` where both columns
    are present.

    Only the short name is made; the reference's second column, named by the literal
    formula text, is never usable and is left out.
    """
    new: dict[str, Column] = {}
    for t in texts:
        for n in _in_order(t):
            if isinstance(n, ast.BinOp) and isinstance(n.op, ast.Mult):
                pair = _reference(n.left), _reference(n.right)
                name = "{}_{}_product".format(*pair)
                if set(pair) <= set(df.columns) and name not in df.columns:
                    new[name] = product(df, *pair)
    return df.withColumns(new) if new else df


def chart_product(df: DataFrame, y_ref: str) -> tuple[DataFrame, str | None]:
    """A chart ``y_column`` that names two or more columns becomes the product ``a_x_b``
    of the first two, each resolved by name; ``(df, None)`` where that cannot be done."""
    if y_ref in df.columns:
        return df, y_ref
    pair = [resolve_column(r, df.columns) for r in references(y_ref)[:2]]
    if len(pair) < 2 or None in pair:
        return df, None
    name = "_x_".join(pair)
    return (df if name in df.columns else df.withColumn(name, product(df, *pair))), name


def derive_for_plan(df: DataFrame, plan: dict) -> DataFrame:
    """P10 then P11 for a plan, before any filtering."""
    return product_columns(convention_columns(df), plan_texts(plan))
