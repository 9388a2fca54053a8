"""Prompts of the three generation stages as constant-folded concatenations, plain and as chat messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MODES = {"S->C": ("seed", "concept"), "C->I": ("concept", "instruction"), "I->R": ("instruction", "response")}
LABELS = {"seed": "Function", "concept": "Description", "instruction": "Instruction", "response": "Response"}
TASKS = {
    "S->C": "Say in a few sentences what the function does and which ideas it uses.",
    "C->I": "Write a programming task whose solution uses what the description says.",
    "I->R": "Solve the task with one Python function in a fenced block.",
}
SYSTEM = {
    "S->C": "You read Python functions and describe them.",
    "C->I": "You turn descriptions of code into tasks.",
    "I->R": "You solve programming tasks in Python.",
}
EXAMPLES = {
    "S->C": [("def area(r):\n    return 3.14159 * r * r", "Computes a circle's area from its radius."), ("def total(xs):\n    return sum(xs)", "Adds up the numbers of a list.")],
    "C->I": [("Computes a circle's area from its radius.", "Write a function that returns the area of a circle."), ("Adds up the numbers of a list.", "Write a function that sums a list of numbers.")],
    "I->R": [("Write a function that returns the area of a circle.", "```python\ndef area(r):\n    return 3.14159 * r * r\n```"), ("Write a function that sums a list of numbers.", "```python\ndef total(xs):\n    return sum(xs)\n```")],
}


def columns(mode: str) -> tuple[str, str]:
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode}")
    return MODES[mode]


def frame(mode: str, examples: bool = True) -> tuple[str, str]:
    """What stands before and after a row's text in a plain prompt."""
    source, target = columns(mode)
    shots = "".join(f"\n\n{LABELS[source]}:\n{a}\n\n{LABELS[target]}:\n{b}" for a, b in EXAMPLES[mode]) + "\n\n" if examples else ""
    return f"{shots}{TASKS[mode]}\n\n{LABELS[source]}:\n", f"\n\n{LABELS[target]}:\n"


def plain(mode: str, examples: bool = True, source: Column | None = None) -> Column:
    before, after = frame(mode, examples)
    return F.concat(F.lit(before), F.col(columns(mode)[0]) if source is None else source, F.lit(after))


def chat(mode: str, examples: bool = True) -> Column:
    """Messages (role, content)."""
    source = columns(mode)[0]
    say = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    shots = [say(r, F.lit(c)) for pair in EXAMPLES[mode] for r, c in zip(("user", "assistant"), pair, strict=True)] if examples else []
    return F.array(say("system", F.lit(SYSTEM[mode])), *shots, say("user", F.col(source)))


def prompted(rows: DataFrame, mode: str, examples: bool = True, chat_format: bool = False, samples: int = 1) -> DataFrame:
    """Adds prompt, and sample_idx where each row is repeated."""
    made = (chat if chat_format else plain)(mode, examples)
    rows = rows.withColumn("prompt", made)
    return rows.withColumn("sample_idx", F.explode(F.sequence(F.lit(0), F.lit(samples - 1)))) if samples > 1 else rows


def inference(instruction: Column) -> Column:
    return F.concat(F.lit("<instruction>\n"), instruction, F.lit("\n</instruction>\n<response>"))
