"""Facts about Python source from its syntax tree; plain functions of a string that never raise."""

from __future__ import annotations

import ast
import io
import re
import textwrap
import tokenize
import warnings

FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)
DEF_LINE = re.compile(r"^([ \t]*)(?:async[ \t]+)?def[ \t]")


def tree(source: str | None) -> ast.Module | None:
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            return ast.parse(source or "")
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None


def block_string(source: str, statement: ast.stmt) -> bool:
    """Whether a statement is one triple-quoted string without a prefix."""
    if not (isinstance(statement, ast.Expr) and isinstance(statement.value, ast.Constant) and isinstance(statement.value.value, str)):
        return False
    text = ast.get_source_segment(source, statement) or ""
    if not text.startswith(('"""', "'''")):
        return False
    try:
        kinds = [t.type for t in tokenize.generate_tokens(io.StringIO(text).readline)]
    except (tokenize.TokenError, SyntaxError):
        return False
    return kinds.count(tokenize.STRING) == 1


def documented(source: str, module: ast.Module) -> list[str]:
    return [ast.get_source_segment(source, n) or "" for n in ast.walk(module) if isinstance(n, FUNCTIONS) and any(block_string(source, s) for s in n.body)]


def fragments(source: str) -> list[str]:
    """def blocks by their indent, for a file that does not parse as a whole."""
    lines, out = source.split("\n"), []
    for i, line in enumerate(lines):
        m = DEF_LINE.match(line)
        if not m:
            continue
        end = i + 1
        while end < len(lines) and (not lines[end].strip() or len(lines[end]) - len(lines[end].lstrip()) > len(m[1])):
            end += 1
        out.append(textwrap.dedent("\n".join(lines[i:end])).rstrip())
    return out


def functions(source: str | None) -> list[str]:
    """Texts of all functions with a triple-quoted statement in their body, each once, in order."""
    if not source:
        return []
    module = tree(source)
    if module is not None:
        return list(dict.fromkeys(documented(source, module)))
    found = []
    for part in fragments(source):
        module = tree(part)
        if module is not None and module.body and isinstance(module.body[0], FUNCTIONS) and any(block_string(part, s) for s in module.body[0].body):
            found.append(part)
    return list(dict.fromkeys(found))


def main_name(source: str | None) -> str | None:
    """The first plain function, breadth first."""
    module = tree(source)
    return next((n.name for n in ast.walk(module) if isinstance(n, ast.FunctionDef)), None) if module else None


def complexity(source: str | None) -> int:
    """1 and one for each if, while, for, and each further operand of `and`; 100 if it doesn't parse."""
    module = tree(source)
    if module is None:
        return 100
    branches = sum(isinstance(n, (ast.If, ast.While, ast.For)) for n in ast.walk(module))
    return 1 + branches + sum(len(n.values) - 1 for n in ast.walk(module) if isinstance(n, ast.BoolOp) and isinstance(n.op, ast.And))


def annotated(source: str | None) -> bool:
    """A return or positional annotation of a plain function, or an annotated assignment."""
    module = tree(source)
    if module is None:
        return False
    return any(isinstance(n, ast.AnnAssign) or isinstance(n, ast.FunctionDef) and (n.returns is not None or any(a.annotation for a in n.args.args)) for n in ast.walk(module))


def first_function(source: str | None) -> ast.FunctionDef | ast.AsyncFunctionDef | None:
    module = tree(source)
    return next((n for n in ast.walk(module) if isinstance(n, FUNCTIONS)), None) if module else None


def docstring(source: str | None) -> str:
    f = first_function(source)
    return (ast.get_docstring(f, clean=False) or "").strip() if f else ""


def return_type(source: str | None) -> str:
    f = first_function(source)
    return ast.unparse(f.returns) if f and f.returns else ""


def parameters(source: str | None) -> list[str]:
    """Positional parameters without a default."""
    f = first_function(source)
    return [a.arg for a in f.args.args[: len(f.args.args) - len(f.args.defaults)]] if f else []


def returns(source: str | None) -> bool:
    f = first_function(source)
    return bool(f) and any(isinstance(n, ast.Return) for n in ast.walk(f))


def annotation_marks(source: str | None) -> bool:
    """An arrow anywhere, or a colon in the parameter list."""
    if "->" in (source or ""):
        return True
    f = first_function(source)
    return bool(f) and ":" in ast.unparse(f.args)


def compiles(source: str | None) -> bool:
    return bool(source) and tree(source) is not None
