"""Secret scan: three patterns, and character Markov models of random strings against ordinary identifiers.

Everything that touches rows is a Spark SQL expression. A pattern's places come from split() and
regexp_extract_all(): the pieces between matches and the matches themselves add up to the offsets.

The models are first-order chains over a fixed alphabet. Random strings are generated (hex, base32, base64 and
alphanumeric digests of a counter); ordinary identifiers are made from the words of at most `sample_docs`
documents with the smallest id hashes: plain, snake_case, camelCase, numbered, paths. Both samples carry their label.
Identifiers are not written out: distinct words and the edges of neighbours are counted, and pairs are weighted by
these counts. That gives at most 2 * alphabet^2 rows, from which the driver makes a table of log-likelihood
ratios. A candidate is a run of 20 or more token characters, dots and dashes with 8 different ones or more; it is a span of
kind `markov` if the sum of its ratios is above the threshold (a higher one without a digit) and it meets no pattern's span.

Defined cases: null text is empty and has no spans; an empty table trains on random strings alone; repeated rows
give repeated results; offsets count code points; other columns of the input are not read or are kept as they are.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import Scratch

# Fixed values.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: For these two the runs are maximal, so a length in the pattern drops just what a later test would drop.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}+"
# End of fixed values.
KINDS = ("assign", "access", "hex", "markov")
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_="
#: A whole run of token characters, tried once at its start; dots and dashes in it count for nothing, at its ends they go.
CANDIDATE = r"(?<![A-Za-z0-9+/_=.-])[A-Za-z0-9+/_=.-]{20,}+"
LEAST, DISTINCT = 20, 8
#: For runs with a digit, and for runs without one, where ordinary words are likelier.
THRESHOLD = 10.0
NO_DIGIT = 25.0
SAMPLE_DOCS = 2000
SAMPLE_STRINGS = 20000
CHUNK = 256


def running(lengths: Column, width: int = CHUNK) -> Column:
    """Running sums before each element of an array of ints, chunk by chunk so that long arrays stay cheap."""

    def scan(xs: Column, start: Column) -> Column:
        grown = F.aggregate(xs, F.array(start.cast("long")), lambda acc, x: F.concat(acc, F.array((F.element_at(acc, -1) + x).cast("long"))))
        return grown

    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / width).cast("int")), lambda i: F.slice(lengths, i * width + 1, F.lit(width)))
    offsets = scan(F.transform(chunks, lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)), F.lit(0))
    parts = F.transform(F.arrays_zip(chunks.alias("c"), F.slice(offsets, 1, F.size(chunks)).alias("o")), lambda z: F.slice(scan(z["c"], z["o"]), 1, F.size(z["c"])))
    return F.when(F.size(lengths) > 0, F.flatten(parts)).otherwise(F.array().cast("array<long>"))


SPAN = "array<struct<start:long,kind:int,end:long>>"


def matches(df: DataFrame, kind: str, pattern: str, present: Column, group: int | None = None, least: int = 0) -> DataFrame:
    """Adds __<kind>: the spans of a pattern in __text. present: a cheap test that fails only where nothing matches."""
    name, text = f"__{kind}", F.col("__text")
    none = F.array().cast("array<string>")
    df = df.withColumn(f"{name}_in", present)
    on = F.col(f"{name}_in")
    cols = {
        f"{name}_m": F.when(on, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none),
        f"{name}_p": F.when(on, F.split(text, pattern, -1)).otherwise(none),
    }
    if group is not None:  # of the match alone, which it matches again
        cols[f"{name}_g"] = F.transform(cols[f"{name}_m"], lambda m: F.regexp_extract(m, pattern, group))
    df = df.withColumns(cols)
    m, p = F.col(f"{name}_m"), F.col(f"{name}_p")
    df = df.withColumn(f"{name}_s", F.when(F.size(m) > 0, running(F.zip_with(F.slice(p, 1, F.size(m)), m, lambda a, b: F.length(a) + F.length(b)))).otherwise(F.array().cast("array<long>")))
    s = F.col(f"{name}_s")
    last = F.col(f"{name}_g") if group is not None else m
    spans = F.transform(
        F.arrays_zip(m.alias("m"), p.alias("p"), s.alias("s"), last.alias("g")),
        lambda z: F.struct((z["s"] + F.length(z["p"])).alias("start"), F.lit(KINDS.index(kind)).alias("kind"), (z["s"] + F.length(z["p"]) + F.length(z["m"])).alias("end"), F.length(z["g"]).alias("n"), z["m"].alias("m")),
    )
    spans = F.filter(F.slice(spans, 1, F.size(m)), lambda z: z["n"] >= least)
    return df.withColumn(name, F.when(F.size(m) > 0, spans)).drop(f"{name}_in", *cols, f"{name}_s")


def bare(spans: Column) -> Column:
    return F.coalesce(F.transform(spans, lambda z: F.struct(z["start"].cast("long").alias("start"), z["kind"].cast("int").alias("kind"), z["end"].cast("long").alias("end"))), F.array().cast(SPAN))


def listed(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda z: F.concat_ws(":", F.element_at(names, z["kind"] + 1), z["start"].cast("string"), z["end"].cast("string"))), ",")


def pairs(df: DataFrame, text: str, label: str, weight: Column | None = None) -> DataFrame:
    """Counts of neighbouring characters by label; at most alphabet^2 rows for each label of those that the models know."""
    two = F.transform(F.sequence(F.lit(1), F.length(text) - 1), lambda i: F.substring(F.col(text), i, F.lit(2)))
    rows = df.filter(F.length(text) > 1).select(label, (F.lit(1) if weight is None else weight).alias("w"), F.explode(two).alias("pair"))
    return rows.groupBy(label, "pair").agg(F.sum("w").alias("n"))


def random_strings(spark, count: int, first: int = 0) -> DataFrame:
    """s and random (true): digests of the numbers from `first` on, in five alphabets."""
    digest = F.unhex(F.sha2(F.col("id").cast("string"), 256))
    b64 = F.translate(F.base64(digest), "=", "")
    made = F.array(
        F.lower(F.hex(F.substring(digest, 1, 20))),
        b64,
        F.regexp_replace(b64, "[+/]", ""),
        F.upper(F.regexp_replace(b64, "[+/]", "")),
        F.lower(F.regexp_replace(b64, "[+/]", "")),
    )
    return spark.range(first, first + count).select(F.element_at(made, (F.col("id") % 5 + 1).cast("int")).alias("s"), F.lit(True).alias("random"))


def word_lists(documents: DataFrame, sample_docs: int, skip: int = 0) -> DataFrame:
    """w: the distinct words of the documents with the smallest id hashes, after so many others."""
    ids = documents.select("doc_id").filter(F.col("doc_id").isNotNull()).distinct()
    chosen = ids.orderBy(F.xxhash64("doc_id"), "doc_id").offset(skip).limit(sample_docs)
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("[A-Za-z]{2,}"), F.lit(0))
    return documents.join(chosen, "doc_id", "left_semi").select(F.array_distinct(words).alias("w")).filter(F.size("w") > 2)


#: What joins two words of an identifier, and whether the second word starts with a capital.
JOINS = (("_", False), ("", True), ("/", False))


def number_of(word: Column) -> Column:
    return F.pmod(F.hash(word), F.lit(2100)).cast("string")


def identifiers(documents: DataFrame, sample_docs: int, skip: int = 0) -> DataFrame:
    """s and random (false): words alone, numbered, and three in a row joined in each way."""
    w = word_lists(documents, sample_docs, skip)

    def joined(mark: str, capital: bool):
        later = lambda i: F.initcap(F.element_at("w", i)) if capital else F.lower(F.element_at("w", i))
        return F.transform(F.sequence(F.lit(1), F.size("w") - 2), lambda i: F.concat(F.lower(F.element_at("w", i)), F.lit(mark), later(i + 1), F.lit(mark), later(i + 2)))

    number = F.transform("w", lambda x: F.concat(x, F.lit("_"), number_of(x)))
    return w.select(F.explode(F.concat(F.col("w"), number, *(joined(*j) for j in JOINS))).alias("s"), F.lit(False).alias("random"))


def identifier_pairs(w: DataFrame) -> DataFrame:
    """The counts that pairs(identifiers()) would give for some word lists, but for texts' ends, from distinct words and their
    counts: a pair inside a word counts as often as identifiers hold the word, and pairs across a join follow from the words'
    edges."""
    words = w.select(F.explode("w").alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    low = sum(1 if capital else 3 for _, capital in JOINS)
    forms = [("word", 2, F.col("word")), ("low", low, F.lower("word")), ("cap", 2, F.initcap("word")), ("number", 1, F.concat(F.substring("word", -1, 1), F.lit("_"), number_of(F.col("word"))))]
    made = words.select("n", F.explode(F.array(*(F.struct(s.alias("s"), F.lit(k).alias("k")) for _, k, s in forms))).alias("f"))
    inner = pairs(made.select(F.lit(False).alias("random"), "f.s", (F.col("n") * F.col("f.k")).alias("w")), "s", "random", F.col("w"))
    edge = F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda i: F.struct(F.lower(F.substring(F.element_at("w", i), -1, 1)).alias("a"), F.substring(F.element_at("w", i + 1), 1, 1).alias("b")))
    edges = w.select(F.explode(edge).alias("e")).groupBy("e.a", "e.b").agg(F.count("*").alias("n"))
    across = [F.concat(F.col("a"), F.lit(mark), F.upper("b") if capital else F.lower("b")) for mark, capital in JOINS]
    outer = pairs(edges.select(F.lit(False).alias("random"), F.explode(F.array(*across)).alias("s"), (2 * F.col("n")).alias("w")), "s", "random", F.col("w"))
    return inner.unionByName(outer)


def train(documents: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_strings: int = SAMPLE_STRINGS) -> list[float]:
    """Log-likelihood ratios of ALPHABET^2 transitions, row by row; the bounds on the samples are the parameters."""
    k = len(ALPHABET)
    counts = {True: [[0.5] * k for _ in range(k)], False: [[0.5] * k for _ in range(k)]}
    at = {c: i for i, c in enumerate(ALPHABET)}
    scratch = Scratch(documents.sparkSession, "secrets")
    words = scratch.put(word_lists(documents, sample_docs), "words")  # read twice; of at most sample_docs documents
    known = pairs(random_strings(documents.sparkSession, sample_strings), "s", "random").unionByName(identifier_pairs(words))
    for r in known.filter(F.col("pair").rlike("^[" + ALPHABET + "]{2}$")).collect():
        a, b = r["pair"]
        counts[r["random"]][at[a]][at[b]] += r["n"]
    scratch.keep()
    out = []
    for i in range(k):
        rows = {x: counts[x][i] for x in counts}
        sums = {x: sum(rows[x]) for x in rows}
        out += [math.log(rows[True][j] / sums[True]) - math.log(rows[False][j] / sums[False]) for j in range(k)]
    return out


def ratio(token: Column, table: Column) -> Column:
    """Sum of a token's log-likelihood ratios."""
    k = len(ALPHABET)
    code = F.transform(F.split(token, ""), lambda c: F.position(c, F.lit(ALPHABET)))
    steps = F.aggregate(code, F.struct(F.lit(0).alias("p"), F.lit(0.0).alias("sum")), lambda acc, c: F.struct(c.alias("p"), (acc["sum"] + F.when((acc["p"] > 0) & (c > 0), F.element_at(table, (acc["p"] - 1) * k + c)).otherwise(0.0)).alias("sum")))
    return steps["sum"]


def trimmed(spans: Column) -> Column:
    """Candidates without dots and dashes at their ends; those that are too short then go."""

    def cut(z: Column) -> Column:
        left = F.ltrim(z["m"], F.lit(".-"))
        start = z["start"] + F.length(z["m"]) - F.length(left)
        m = F.rtrim(left, F.lit(".-"))
        return F.struct(start.alias("start"), z["kind"].alias("kind"), (start + F.length(m)).alias("end"), m.alias("m"))

    return F.filter(F.transform(spans, cut), lambda z: F.length(z["m"]) >= LEAST)


def random_looking(token: Column, table: Column, threshold: float = THRESHOLD, no_digit: float = NO_DIGIT) -> Column:
    varied = F.size(F.array_distinct(F.split(token, ""))) >= DISTINCT
    return varied & (ratio(token, table) > F.when(token.rlike("[0-9]"), F.lit(threshold)).otherwise(F.lit(no_digit)))


def scan(documents: DataFrame, model: list[float] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """Adds base (the patterns' spans, by start and kind) and spans (with the model's) to all columns of the input."""
    if model is None:
        model = train(documents)
    table = F.split(F.lit(",".join(f"{x:.6f}" for x in model)), ",").cast("array<double>")
    df = documents.select(F.struct(*documents.columns).alias("__row"), F.coalesce("text", F.lit("")).alias("__text"))
    text = F.col("__text")
    low = F.lower(text)
    named = low.contains("passw") | low.contains("secret") | low.contains("token") | low.contains("api")
    df = matches(df, "assign", ASSIGN, named & text.rlike(ASSIGN), group=1, least=6)
    df = matches(df, "access", ACCESS, text.contains("AKIA"))
    df = matches(df, "hex", HEX, text.rlike(HEX))
    df = matches(df, "markov", CANDIDATE, text.rlike(CANDIDATE))
    df = df.withColumn("__base", F.array_sort(F.concat(bare(F.col("__assign")), bare(F.col("__access")), bare(F.col("__hex")))))
    base = F.col("__base")
    found = F.filter(trimmed(F.col("__markov")), lambda z: random_looking(z["m"], table, threshold) & ~F.exists(base, lambda b: (b["start"] < z["end"]) & (z["start"] < b["end"])))
    df = df.withColumn("__found", F.when(F.size("__markov") > 0, bare(found)).otherwise(F.array().cast(SPAN)))
    return df.select("__row", base.alias("base"), F.array_sort(F.concat(base, F.col("__found"))).alias("spans"), "__text")


def digest(documents: DataFrame, model: list[float] | None = None) -> DataFrame:
    """The counts, hash and list that the query returns."""
    found = scan(documents, model)
    n = lambda kind: F.size(F.filter("base", lambda z: z["kind"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")
    return found.select(F.col("__row.doc_id").alias("doc_id"), n("assign"), n("access"), n("hex"), F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def redact(documents: DataFrame, model: list[float] | None = None, mark: str = "[secret]") -> DataFrame:
    """The same rows and columns; every span of a text is replaced, overlapping ones as one. n_chars follows the text."""
    found = scan(documents, model)
    text = F.col("__text")
    cut = F.aggregate(
        "spans",
        F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at")),
        lambda acc, z: F.when(z["start"] >= acc["at"], F.struct(F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), (z["start"] - acc["at"]).cast("int")), F.lit(mark)).alias("out"), z["end"].alias("at"))).otherwise(F.struct(acc["out"].alias("out"), F.greatest(acc["at"], z["end"]).alias("at"))),
    )
    found = found.withColumn("__cut", F.when(F.size("spans") > 0, cut))
    clean = F.when(F.size("spans") > 0, F.concat(F.col("__cut.out"), F.substring(text, (F.col("__cut.at") + 1).cast("int"), F.length(text)))).otherwise(F.col("__row.text"))
    out = [(clean if c == "text" else F.when(F.size("spans") > 0, F.length(clean).cast(t)).otherwise(F.col("__row.n_chars")) if c == "n_chars" else F.col("__row")[c]).alias(c) for c, t in documents.dtypes]
    return found.select(*out)
