"""Text predicates and scalars over source code and completions, as Catalyst expressions.

Patterns carry (?d), so that only a line feed ends a line, and (?U), so that white space is that of Unicode.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
BANNED_WORDS = ("TODO", "FIXME", "XXX", "BUG", "HACK", "NOTE", "todo", "fixme", "xxx", "bug", "hack", "note", "DEPRECATED", "deprecated", "debug", "DEBUG", "unimplemented", "UNIMPLEMENTED", "WIP", "wip")
FORBIDDEN_IMPORTS = ("os", "sys", "subprocess", "pathlib", "shutil", "tempfile", "pty", "tty", "docker", "kubernetes", "socket", "multiprocessing", "threading")
REMOVED_IMPORTS = ("os", "sys", "subprocess", "importlib", "socket", "shutil", "pathlib", "pickle", "requests")
TERMINATORS = ("\\nDescription:", "\\nInstruction:", "\\n```", "\\nBelow is a description:")
REMOVED_NOTE = "# Import removed for security: "
IMPORT = r"(?mdU)^\s*(?:from|import)\s+([a-zA-Z0-9_.]+)"
SIGNATURE = r"(?dU)def\s+[a-zA-Z_][a-zA-Z0-9_]*\s*\((.*?)\)"
FENCE = r"(?s)```(?:python)?(.*?)```"
IMPORT_LINE = r"(?dU)(^|\n)(\s*)import\s+{name}.*?($|\n)"
FROM_LINE = r"(?dU)(^|\n)(\s*)from\s+{name}\s+import.*?($|\n)"
# End of fixed values.

EDGES = r"(?U)\A[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z"


def let(c: Column, use: Callable[[Column], Column]) -> Column:
    """use(c) with c computed once, however often it is named: nested uses would else grow without bound in the plan."""
    return F.element_at(F.transform(F.array(c), use), 1)


def strip(c: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(c, EDGES, "")


def no_banned_word(c: Column) -> Column:
    """A conjunction of plain substring tests, which Parquet scans take as filters."""
    return reduce(and_, (~c.contains(w) for w in BANNED_WORDS))


def imports(c: Column) -> Column:
    """Top-level names of the lines that start like imports, each once."""
    return F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(IMPORT), F.lit(1)), lambda m: F.substring_index(m, ".", 1)))


def no_forbidden_import(c: Column) -> Column:
    return ~F.arrays_overlap(imports(c), F.array(*map(F.lit, FORBIDDEN_IMPORTS)))


def has_return(c: Column) -> Column:
    return c.rlike(r"(?U)\breturn\b")


def has_args(c: Column) -> Column:
    """Whether the first one-line parameter list is neither empty nor just self."""
    return ~strip(F.regexp_extract(c, SIGNATURE, 1)).isin("", "self")


def good_seed(c: Column) -> Column:
    """All native quality tests, cheap ones first."""
    return no_banned_word(c) & no_forbidden_import(c) & has_return(c) & has_args(c)


def completion(prompt: Column, output: Column) -> Column:
    """A model's output without the prompt that it repeats."""
    rest = lambda p, o: F.when((p != "") & F.startswith(o, p), F.substring(o, F.length(p) + 1, F.length(o))).otherwise(o)
    return strip(let(prompt, lambda p: let(output, lambda o: rest(p, o))))


def truncated(c: Column, terminators: tuple[str, ...] = TERMINATORS) -> Column:
    """Up to the first terminator. As given they hold a backslash and an n; pass line feeds for the evident intent."""

    def cut(s: Column) -> Column:
        ends = [F.coalesce(F.nullif(F.instr(s, F.lit(t)), F.lit(0)), F.length(s) + 1) for t in terminators]
        return F.substring(s, F.lit(1), F.least(*ends) - 1)

    return strip(let(c, cut))


def code_of(c: Column) -> Column:
    """The first fenced block, or everything without one."""
    return strip(let(c, lambda s: F.when(s.rlike(FENCE), F.regexp_extract(s, FENCE, 1)).otherwise(s)))


def after_mode(c: Column, mode: str) -> Column:
    """The part of a completion that a stage keeps; empty ones are null. mode: S->C, C->I or I->R."""
    if mode not in ("S->C", "C->I", "I->R"):
        raise ValueError(f"unknown mode {mode}")
    return let({"S->C": strip, "C->I": truncated, "I->R": code_of}[mode](c), lambda out: F.when(out != "", out))


def tagged_response(c: Column) -> Column:
    """Between <response> and </response> or the end; from the tenth character on if there is no opening tag."""
    at = F.instr(c, F.lit("<response>"))
    start = F.when(at > 0, at + 10).otherwise(F.lit(10))
    rest = F.substring(c, start, F.length(c))
    return strip(F.substring_index(rest, "</response>", 1))


def replaced(c: Column, pattern: str, by: str, *words: str) -> Column:
    """A replacement that looks for its pattern only in texts that hold the words which every match holds: a search for a
    word costs a small part of one for a pattern."""
    return let(c, lambda s: F.when(reduce(and_, (s.contains(w) for w in words)), F.regexp_replace(s, pattern, by)).otherwise(s))


def without_imports(c: Column) -> Column:
    """Import lines of the named modules (as prefixes) turned to comments."""
    for name in REMOVED_IMPORTS:
        for line, words in ((IMPORT_LINE, ("import",)), (FROM_LINE, ("from", "import"))):
            c = replaced(c, line.replace("{name}", name), f"$1$2{REMOVED_NOTE}{name}$3", name, *words)
    return c


def without_calls(c: Column) -> Column:
    for name in ("open", "eval", "exec"):
        c = replaced(c, rf"(?U){name}\s*\(", f"# {name}(", name)
    return c


def sanitized(c: Column) -> Column:
    return without_calls(without_imports(c))


def humanized(n: Column) -> Column:
    """Bytes with one decimal in B, KB, MB, GB or TB; ties go to the even digit. Tenths are those of the exact value of whole bytes,
    of which a large number's shortest decimal form may be a tie where there is none."""

    def made(unit: str, factor: int) -> Column:
        size = F.abs(n / F.lit(float(factor)))
        tenths = F.rint(size % 1.0 * 10)
        whole = size - size % 1.0 + F.floor(tenths / 10)
        digits = F.when(whole < float(1 << 63), whole.cast("bigint").cast("string")).otherwise(F.format_string("%.0f", whole))
        return F.concat(F.when(n < 0, F.lit("-")).otherwise(F.lit("")), digits, F.format_string(f".%.0f {unit}", tenths % 10))

    out = F.when(n.isNull(), F.lit(None).cast("string"))
    for i, u in enumerate(("B", "KB", "MB", "GB")):
        out = out.when(n < 1024 ** (i + 1), made(u, 1024**i))
    return out.otherwise(made("TB", 1024**4))


def typed(c: Column) -> Column:
    """int, float or string: what a configuration value is read as."""
    return F.when(c.rlike(r"\A[0-9]+\z"), F.lit("int")).when(c.rlike(r"\A(?:[0-9]+\.[0-9]*|\.[0-9]+)\z"), F.lit("float")).otherwise(F.lit("string"))


HARNESS = """

if __name__ == "__main__":
    from inspect import signature
    try:
        wanted = len(signature({name}).parameters)
        print("Result:", {name}(*{{0: (), 1: (5,), 2: (5, 10)}}.get(wanted, (1,) * wanted)))
    except Exception as problem:
        print("Call failed:", problem)
"""


def script(code: Column, name: Column) -> Column:
    """Code with a call of a function by its number of parameters; the code alone without a name."""
    pieces = HARNESS.split("{name}")
    call = F.concat(code, *[x for i, p in enumerate(pieces) for x in ([F.lit(p.replace("{{", "{").replace("}}", "}"))] + ([name] if i < len(pieces) - 1 else []))])
    return F.when(name.isNull(), code).otherwise(call)
