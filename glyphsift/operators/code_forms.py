"""Canonical forms of Python code: Arrow functions around the standard parser (no Catalyst counterpart exists)."""

from __future__ import annotations

import ast
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from glyphsift.functions import unicode_tables as U
from glyphsift.operators.keyless import residual_variability
from glyphsift.operators.rewrite import canonicalize_c

COMMUTATIVE = (ast.Add, ast.Mult, ast.BitAnd, ast.BitOr, ast.BitXor)
TURNED = {ast.Gt: ast.Lt, ast.GtE: ast.LtE}
EVEN = (ast.Eq, ast.NotEq)


class _Rename(ast.NodeTransformer):
    """Names that the code binds itself to v0, v1, ... in the order of binding; built-ins, imports and attributes keep theirs."""

    def __init__(self) -> None:
        self.bound: dict[str, str] = {}

    def bind(self, name: str) -> str:
        return self.bound.setdefault(name, f"v{len(self.bound)}")

    def visit_FunctionDef(self, node: ast.FunctionDef) -> ast.AST:
        node.name = self.bind(node.name)
        own = node.args
        for p in filter(None, (*own.args, *own.kwonlyargs, own.vararg, own.kwarg)):
            p.arg = self.bind(p.arg)
        return self.generic_visit(node)

    def visit_Name(self, node: ast.Name) -> ast.AST:
        if isinstance(node.ctx, ast.Store) or node.id in self.bound:
            node.id = self.bind(node.id)
        return node


class _Structure(ast.NodeTransformer):
    """Operands whose order means nothing are sorted as they would be written; comparisons point one way. Chains stay."""

    def visit_BinOp(self, node: ast.BinOp) -> ast.AST:
        self.generic_visit(node)
        if isinstance(node.op, COMMUTATIVE):
            node.left, node.right = sorted((node.left, node.right), key=ast.unparse)
        return node

    def visit_BoolOp(self, node: ast.BoolOp) -> ast.AST:
        self.generic_visit(node)
        node.values.sort(key=ast.unparse)
        return node

    def visit_Compare(self, node: ast.Compare) -> ast.AST:
        self.generic_visit(node)
        if len(node.ops) > 1:
            return node
        kind, sides = type(node.ops[0]), [node.left, node.comparators[0]]
        if kind in TURNED:
            sides.reverse()
            node.ops = [TURNED[kind]()]
        elif kind in EVEN:
            sides.sort(key=ast.unparse)
        node.left, node.comparators = sides[0], sides[1:]
        return node


def unfenced(code: str) -> str:
    """Without the marks of Markdown fences, however many; what they hold stays."""
    return re.sub(r"```[a-zA-Z]*\n?", "", code).strip()


def _form(code: str, visitor: type[ast.NodeTransformer]) -> str | None:
    """The code as the visitor leaves it; None if it doesn't parse."""
    try:
        return ast.unparse(visitor().visit(ast.parse(code)))
    except (SyntaxError, ValueError, RecursionError):
        return None


def canonical(code: str) -> str:
    code = unfenced(code)
    form = _form(code, _Rename)
    return form if form is not None else " ".join(re.sub(r"#[^\n]*", "", code).split())


def structural(code: str) -> str:
    code = unfenced(code)
    form = _form(code, _Structure)
    return form if form is not None else code


@F.pandas_udf(StringType())
def canonicalize_python(code: pd.Series) -> pd.Series:
    """Alpha-renamed and unparsed; code that doesn't parse keeps its tokens without comments."""
    return code.map(canonical, na_action="ignore")


@F.pandas_udf(StringType())
def structural_normalize(code: pd.Series) -> pd.Series:
    """One order of operands and one direction of comparisons; code that doesn't parse comes back as it is, but for fences."""
    return code.map(structural, na_action="ignore")


@F.pandas_udf(StringType())
def _unfenced(code: pd.Series) -> pd.Series:
    return code.map(unfenced, na_action="ignore")


def canonicalize_for(lang: str, code: Column) -> Column:
    """By language: ``c`` by its tokens, all else as Python."""
    return canonicalize_c(_unfenced(code)) if lang == "c" else canonicalize_python(code)


def code_tokens(lang: str, code: Column) -> Column:
    """Words and single signs of the canonical form."""
    w = U.word_chars()
    return F.regexp_extract_all(canonicalize_for(lang, code), F.lit(f"([{U.quick(w)}]+|[{U.quick(U.others(w + U.PY_SPACE))}])"), F.lit(1))


def code_variability(samples: DataFrame, lang: str = "python", by: list[str] | None = None) -> DataFrame:
    """``by..., variability`` from ``by..., sample_id, code``: what differs between samples once naming and layout are gone."""
    by = by or ["task"]
    tokens = samples.select(*by, "sample_id", F.explode(code_tokens(lang, F.col("code"))).alias("tok"))
    return residual_variability(tokens, by)


def featurize(samples: DataFrame, k: int = 4) -> DataFrame:
    """``task, sample_id, slot, variant`` from ``task, sample_id, tokens``.

    The most frequent token sequence of a task (the first one seen on ties) is
    the reference; the others are aligned to it.  Its places are the slots:
    insertions are dropped, deletions are ``<del>``, a replaced span stands at
    each place that it covers.  Slots that vary get variant numbers in the order
    of the tokens, k - 1 at most.
    """

    def align(pdf: pd.DataFrame) -> pd.DataFrame:
        from collections import Counter
        from difflib import SequenceMatcher

        pdf = pdf.sort_values("sample_id")
        seqs = [tuple(t) for t in pdf["tokens"]]
        ref = Counter(seqs).most_common(1)[0][0]
        rows = []
        for seq in seqs:
            row = ["<del>"] * len(ref)
            for op, i, j, a, b in SequenceMatcher(None, ref, seq, autojunk=False).get_opcodes():
                if op == "equal":
                    row[i:j] = ref[i:j]
                elif op == "replace":
                    row[i:j] = [" ".join(seq[a:b])] * (j - i)
            rows.append(row)
        out = []
        for slot, column in enumerate(zip(*rows, strict=True)):
            kinds = sorted(set(column))
            if len(kinds) > 1:
                out += [(pdf["task"].iloc[0], s, slot, min(kinds.index(x), k - 1)) for s, x in zip(pdf["sample_id"], column, strict=True)]
        return pd.DataFrame(out, columns=["task", "sample_id", "slot", "variant"])

    return samples.groupBy("task").applyInPandas(align, "task string, sample_id long, slot int, variant int")
