"""Predicate strings in pandas' query grammar as Spark columns.

Comparisons are two-valued as in pandas: a null operand makes `!=` and `not in` true and every other comparison false, so that
`not` keeps the rows that pandas keeps.  NaN is a missing value as null is: in columns of floats, and as what arithmetic
and functions give.
"""

from __future__ import annotations

import ast
import io
import tokenize
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_MATH = {"sqrt": F.sqrt, "abs": F.abs, "sin": F.sin, "cos": F.cos, "tan": F.tan, "exp": F.exp, "log": F.log, "log10": F.log10, "log1p": F.log1p, "expm1": F.expm1, "floor": F.floor, "ceil": F.ceil, "arcsin": F.asin, "arccos": F.acos, "arctan": F.atan, "sinh": F.sinh, "cosh": F.cosh, "tanh": F.tanh}
_COMPARE = {ast.Eq: "==", ast.NotEq: "!=", ast.Lt: "<", ast.LtE: "<=", ast.Gt: ">", ast.GtE: ">="}


def _prepare(text: str) -> tuple[str, dict[str, tuple[str, str]]]:
    """Python source for ast, and what its placeholder names stand for: ("var", name) or ("column", name)."""
    names: dict[str, tuple[str, str]] = {}

    def placeholder(kind: str, name: str) -> str:
        key = f"__p{len(names)}__"
        names[key] = (kind, name)
        return key

    parts = text.split("`")
    if len(parts) % 2 == 0:
        raise ValueError("unbalanced backtick")
    text = "".join(p if k % 2 == 0 else placeholder("column", p) for k, p in enumerate(parts))
    out, tokens = [], list(tokenize.generate_tokens(io.StringIO(text.strip()).readline))
    k = 0
    while k < len(tokens):
        t = tokens[k]
        if t.type == tokenize.OP and t.string == "@" and k + 1 < len(tokens) and tokens[k + 1].type == tokenize.NAME:
            out.append(placeholder("var", tokens[k + 1].string))
            k += 1
        elif t.type == tokenize.OP and t.string in "&|~" and t.string:
            out.append({"&": "and", "|": "or", "~": "not"}[t.string])
        elif t.type not in (tokenize.NEWLINE, tokenize.NL, tokenize.ENDMARKER, tokenize.INDENT, tokenize.DEDENT):
            out.append(t.string)
        k += 1
    return " ".join(out), names


def _missing(value: Any) -> bool:
    return value is None or isinstance(value, float) and value != value


def _there(c: Column) -> Column:
    """A column of floats with null for NaN."""
    return F.when(~F.isnan(c), c)


MANY = 1000
"""Values of a list that stand in a plan as literals, at most; longer ones, and tables, are joined."""


class _Compiler:
    def __init__(self, columns: list[str], id_col: str | None, names, local_dict, global_dict, kinds):
        self.columns, self.id_col, self.names, self.kinds = columns, id_col, names, kinds or {}
        self.scope = {**(global_dict or {}), **(local_dict or {})}
        self.joined: list[tuple[Column, Any]] = []

    def visit(self, node: ast.AST) -> Any:
        method = getattr(self, "on_" + type(node).__name__, None)
        if method is None:
            raise ValueError(f"not supported in a query: {type(node).__name__}")
        return method(node)

    def column(self, node: ast.AST) -> Column:
        value = self.visit(node)
        if isinstance(value, (list, tuple, set)):
            raise ValueError("a list can't stand here")
        return value if isinstance(value, Column) else F.lit(value)

    def name(self, name: str) -> Any:
        if name in self.columns:
            c = F.col(f"`{name}`")
            return _there(c) if self.kinds.get(name) in ("float", "double") else c
        if name == "index" and self.id_col:
            return F.col(f"`{self.id_col}`")
        raise ValueError(f"name {name!r} is no column")

    def on_Expression(self, node):
        return self.visit(node.body)

    def on_Name(self, node):
        if node.id in self.names:
            kind, name = self.names[node.id]
            if kind == "column":
                return self.name(name)
            if name not in self.scope:
                raise ValueError(f"variable @{name} is not in local_dict or global_dict")
            value = self.scope[name]
            if isinstance(value, (str, bytes, Column, DataFrame)) or not hasattr(value, "__iter__"):
                return value.item() if hasattr(value, "item") and getattr(value, "ndim", 1) == 0 else value
            return [x.item() if hasattr(x, "item") else x for x in value]
        return self.name(node.id)

    def on_Constant(self, node):
        return node.value

    def on_List(self, node):
        return [self.visit(x) for x in node.elts]

    on_Tuple = on_Set = on_List

    def on_BoolOp(self, node):
        parts = [F.coalesce(self.column(x).cast("boolean"), F.lit(False)) for x in node.values]
        out = parts[0]
        for p in parts[1:]:
            out = out & p if isinstance(node.op, ast.And) else out | p
        return out

    def on_UnaryOp(self, node):
        if isinstance(node.op, ast.Not):
            return ~F.coalesce(self.column(node.operand).cast("boolean"), F.lit(False))
        value = self.visit(node.operand)
        if isinstance(node.op, ast.USub):
            return -value
        if isinstance(node.op, ast.UAdd):
            return value
        raise ValueError("not supported in a query: " + type(node.op).__name__)

    def is_string(self, node: ast.AST, value: Any) -> bool:
        if isinstance(node, ast.BinOp) and isinstance(node.op, ast.Add):
            return self.is_string(node.left, None) or self.is_string(node.right, None)
        if isinstance(node, ast.Constant):
            value = node.value
        name = self.names.get(node.id, ("column", node.id))[1] if isinstance(node, ast.Name) else None
        return isinstance(value, str) or self.kinds.get(name) == "string"

    def on_BinOp(self, node):
        left, right = self.visit(node.left), self.visit(node.right)
        a, b = (x if isinstance(x, Column) else F.lit(x) for x in (left, right))
        op = type(node.op)
        if op is ast.Add:
            return F.concat(a, b) if self.is_string(node.left, left) or self.is_string(node.right, right) else a + b
        if op is ast.Sub:
            return a - b
        if op is ast.Mult:
            return a * b
        x, y = a.cast("double"), b.cast("double")
        zero = F.when(x.isNull() | (x == 0), None).when(x > 0, float("inf")).otherwise(float("-inf"))
        if op is ast.Div:
            return F.when(y == 0, zero).otherwise(x / F.when(y != 0, y))
        if op is ast.FloorDiv:
            return F.when(y == 0, zero).otherwise(F.floor(x / F.when(y != 0, y)).cast("double"))
        if op is ast.Mod:
            safe = F.when(y != 0, y)
            return x - F.floor(x / safe) * safe
        if op is ast.Pow:
            return _there(F.pow(x, y))
        raise ValueError("not supported in a query: " + op.__name__)

    def on_Compare(self, node):
        out, left = None, node.left
        for op, right in zip(node.ops, node.comparators, strict=True):
            one = self.compare(left, op, right)
            out = one if out is None else out & one
            left = right
        return out

    def compare(self, left, op, right) -> Column:
        listed = self.visit(right)
        if isinstance(listed, (list, tuple, set, DataFrame)) or isinstance(op, (ast.In, ast.NotIn)):
            if not isinstance(listed, (list, tuple, set, DataFrame)):
                raise ValueError("in needs a list")
            if not isinstance(op, (ast.In, ast.NotIn, ast.Eq, ast.NotEq)):
                raise ValueError("a list can be compared by in, not in, == and != only")
            found = self.among(self.column(left), listed)
            return ~found if isinstance(op, (ast.NotIn, ast.NotEq)) else found
        a, b = self.column(left), listed if isinstance(listed, Column) else F.lit(None if _missing(listed) else listed)
        kind = _COMPARE.get(type(op))
        if kind is None:
            raise ValueError("not supported in a query: " + type(op).__name__)
        made = {"==": lambda: a == b, "!=": lambda: a != b, "<": lambda: a < b, "<=": lambda: a <= b, ">": lambda: a > b, ">=": lambda: a >= b}[kind]()
        return F.coalesce(made, F.lit(kind == "!="))

    def among(self, own: Column, listed) -> Column:
        """Is own one of listed; a long list or a table becomes a mark that a join puts beside the row."""
        if isinstance(listed, DataFrame) or len(listed) > MANY:
            self.joined.append((own, listed))
            mark = F.coalesce(F.col(f"_among{len(self.joined) - 1}"), F.lit(False))
            return mark if isinstance(listed, DataFrame) or not any(map(_missing, listed)) else mark | own.isNull()
        found = F.coalesce(own.isin([x for x in listed if not _missing(x)]), F.lit(False))
        return found | own.isNull() if any(map(_missing, listed)) else found

    def on_Call(self, node):
        if isinstance(node.func, ast.Name) and node.func.id in _MATH and not node.keywords:
            made = _MATH[node.func.id](*[self.column(x) for x in node.args])
            return made if node.func.id == "abs" else _there(made.cast("double"))
        if not isinstance(node.func, ast.Attribute):
            raise ValueError("unknown function in a query")
        owner, method = node.func.value, node.func.attr
        args = [self.visit(x) for x in node.args]
        options = {k.arg: self.visit(k.value) for k in node.keywords}
        if isinstance(owner, ast.Attribute) and owner.attr == "str":
            return self.string_method(self.column(owner.value), method, args, options)
        c = self.column(owner)
        if method in ("isna", "isnull"):
            return c.isNull()
        if method in ("notna", "notnull"):
            return c.isNotNull()
        if method == "isin":
            return self.among(c, args[0])
        if method == "between":
            low, high = args[:2]
            inclusive = options.get("inclusive", "both")
            lower = c >= low if inclusive in ("both", "left") else c > low
            upper = c <= high if inclusive in ("both", "right") else c < high
            return F.coalesce(lower & upper, F.lit(False))
        if method == "abs":
            return F.abs(c)
        raise ValueError(f"unknown method in a query: {method}")

    @staticmethod
    def string_method(c: Column, method: str, args, options) -> Column:
        if method == "contains":
            if options.get("regex", True):
                flags = "" if options.get("case", True) else "(?i)"
                return F.coalesce(c.rlike(flags + args[0]), F.lit(False))
            return F.coalesce(c.contains(args[0]) if options.get("case", True) else F.lower(c).contains(args[0].lower()), F.lit(False))
        if method in ("startswith", "endswith"):
            return F.coalesce(getattr(c, method)(args[0]), F.lit(False))
        plain = {"lower": F.lower, "upper": F.upper, "len": F.length, "strip": F.trim}
        if method in plain and not args:
            return plain[method](c)
        raise ValueError(f"unknown string method in a query: {method}")


def compile_query(text: str, columns: list[str], id_col: str | None = None, local_dict=None, global_dict=None, kinds: dict[str, str] | None = None) -> tuple[Column, list]:
    """A query string as a boolean column over a table with these columns; index is the id column, kinds their type names.

    With it come (column, values) of the lists that are to be joined: the k-th one's mark is the column _among<k>.
    """
    try:
        source, names = _prepare(text)
        tree = ast.parse(source, mode="eval")
    except (SyntaxError, tokenize.TokenError) as e:
        raise ValueError(f"can't read the query {text!r}") from e
    compiler = _Compiler(columns, id_col, names, local_dict, global_dict, kinds)
    value = compiler.visit(tree)
    value = value if isinstance(value, Column) else F.lit(value)
    return F.coalesce(value.cast("boolean"), F.lit(False)), compiler.joined


def _values(spark, listed) -> DataFrame:
    """One column of distinct values, without missing ones."""
    if isinstance(listed, DataFrame):
        return listed.select(F.col(f"`{listed.columns[0]}`").alias("_value")).dropna().distinct()
    there = list({x for x in listed if not _missing(x)})
    kinds = {type(x) for x in there}
    kind = "long" if kinds == {int} else "string" if kinds == {str} else "double" if kinds <= {int, float} and kinds else None
    if kind is None:
        return spark.createDataFrame([(x,) for x in there], ["_value"]) if there else spark.createDataFrame([], "_value string")
    return spark.createDataFrame([(float(x) if kind == "double" else x,) for x in there], f"_value {kind}")


def where(table: DataFrame, text: str, id_col: str | None = None, local_dict=None, global_dict=None) -> DataFrame:
    """The rows of table on which a query string holds."""
    condition, joined = compile_query(text, table.columns, id_col, local_dict, global_dict, {f.name: f.dataType.typeName() for f in table.schema})
    out = table
    for k, (own, listed) in enumerate(joined):
        values = _values(table.sparkSession, listed).select(F.col("_value").alias(f"_value{k}"), F.lit(True).alias(f"_among{k}"))
        out = out.join(values, own == F.col(f"_value{k}"), "left")
    return out.where(condition).select([F.col(f"`{c}`") for c in table.columns]) if joined else table.where(condition)
