"""Secret scans, with DataFrame operations only.

Base rules find assignments, access keys and long hex strings by regular expressions. The entropy rule adds spans: in
runs of one character class it slides a window over the run, keeps the counts of the window's characters up to date as
one character enters and one leaves, and with them the sum of count * log2(count), in whole millionths so that nothing
drifts. Windows whose Shannon entropy reaches the class's threshold are joined to spans, unless the run is on the allow list.

Each document is scanned within its row: no shuffle, no Python. Where matches lie follows from the lengths of the
matches and of the text between them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siteq.llm.common import plain, table

# The rules (kind, pattern, group whose length counts, least length), in the order of the kinds.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_HINT = r"(?i:passw(?:or)?d|secret|token|api_?key)"
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_base64")
# Character classes of the entropy rule: letters, pattern of one, least bits of a window.
CLASSES = {
    "entropy_hex": ("0123456789abcdefABCDEF", "[0-9a-fA-F]", 3.2),
    "entropy_base64": ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-", "[A-Za-z0-9+/_=-]", 3.7),
}
# Parts of a run, divided by / _ = or -: words of three letters or more in lower or camel case, one or two lower-case letters, digits, or what holds
# a placeholder with up to 20 characters on either side, as many as a window has. Each part has to be one of these up to the next divider, so that none excuses what stands beside it; possessive, as long runs
# would overflow the stack of Java's regular expressions.
_WORDS = r"[a-z]{1,2}|[A-Z]?[a-z]{2,}(?:[A-Z][a-z]{2,})*+|[0-9]+"
_PLACEHOLDER = r"[A-Za-z0-9+]{0,20}(?i:example|sample|dummy|placeholder|changeme|xxxx|0{8}|1234567|abcdefg)[A-Za-z0-9+]{0,20}"
_PART = rf"(?:{_WORDS}|{_PLACEHOLDER})?(?=[/_=-]|$)"
# Runs that are no secrets: without a digit or without a letter, UUIDs, paths of words, digits and placeholders.
ALLOWED = (
    r"^[^0-9]*$",
    r"^[^A-Za-z]*$",
    r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$",
    rf"^{_PART}(?:[/_=-]{_PART})*+$",
)
WINDOW = 20
_UNIT = 1_000_000
SPAN = "array<struct<start: bigint, kind: int, end: bigint>>"


def _none() -> Column:
    return F.array().cast(SPAN)


def _bound(value: Column, f) -> Column:
    """f(value), with value computed once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


#: Matches whose lengths one fold sums up, and characters of a run that one fold reads: Spark copies a fold's state at every step, so it has to stay small.
PART, PIECE = 64, 4096


def located(text: Column, pattern: str) -> Column:
    """Array of (start, match) of the leftmost non-overlapping matches, in code points."""
    size = lambda x: (F.length(x["gap"]) + F.length(x["match"])).cast("bigint")
    grown = lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n))

    def places(part: Column, base: Column) -> Column:
        before = F.aggregate(part, F.array(base), lambda acc, x: grown(acc, size(x)))
        return _bound(before, lambda before: F.transform(part, lambda x, k: F.struct((F.get(before, k) + F.length(x["gap"])).alias("start"), x["match"].alias("match"))))

    def by_parts(both: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(both) - 1) / PART).cast("int")), lambda k: F.slice(both, k * PART + 1, F.lit(PART)))
        sums = lambda parts: F.transform(parts, lambda c: F.aggregate(c, F.lit(0).cast("bigint"), lambda acc, x: acc + size(x)))
        bases = lambda parts: F.aggregate(sums(parts), F.array(F.lit(0).cast("bigint")), grown)
        return _bound(parts, lambda parts: _bound(bases(parts), lambda bases: F.flatten(F.transform(parts, lambda c, k: places(c, F.get(bases, k))))))

    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    both = F.arrays_zip(F.slice(F.split(text, pattern, -1), 1, F.greatest(F.size(matches), F.lit(1))).alias("gap"), matches.alias("match"))
    found = _bound(both, lambda both: F.when(F.size(both) <= PART, places(both, F.lit(0).cast("bigint"))).otherwise(by_parts(both)))
    return F.when(F.size(matches) > 0, found).otherwise(F.array().cast("array<struct<start: bigint, match: string>>"))


def _span(start: Column, kind: str, end: Column) -> Column:
    return F.struct(start.cast("bigint").alias("start"), F.lit(KINDS.index(kind)).alias("kind"), end.cast("bigint").alias("end"))


def _rule(text: Column, kind: str, pattern: str, keep=None) -> Column:
    found = located(text, pattern)
    found = F.filter(found, keep) if keep else found
    return F.transform(found, lambda x: _span(x["start"], kind, x["start"] + F.length(x["match"])))


def high_entropy(run: Column, letters: str, least_bits: float, window: int = WINDOW) -> Column:
    """Array of (a, b): maximal unions of the windows of the run, a string of `letters`, with least_bits or more.

    The run is read in pieces; each starts with the window before its first character, so it finds the windows that end in it.
    """
    weigh = F.array(*(F.lit(round(c * math.log2(c) * _UNIT) if c else 0).cast("bigint") for c in range(window + 2)))
    most = F.lit(int((math.log2(window) - least_bits) * window * _UNIT)).cast("bigint")  # entropy = log2(window) - sum / window
    pairs = "array<struct<a: bigint, b: bigint>>"

    def piece(places: Column, k: Column) -> Column:
        first, low, high = F.greatest(k * PIECE - window + 1, F.lit(1)), k * PIECE, F.least((k + 1) * PIECE, F.size(places))
        moves = F.transform(F.sequence(first, high), lambda i: F.struct(i.alias("i"), F.get(places, i - 1).alias("enter"), F.when(i - window >= first, F.get(places, i - window - 1)).otherwise(0).alias("leave")))

        def step(acc: Column, x: Column) -> Column:
            i, enter, leave = x["i"], x["enter"], x["leave"]
            c_in, c_out = F.get(acc["counts"], enter - 1), F.get(acc["counts"], leave - 1)
            change = F.get(weigh, c_in + 1) - F.get(weigh, c_in) + F.coalesce(F.get(weigh, c_out - 1) - F.get(weigh, c_out), F.lit(0))
            total = F.when(enter == leave, acc["sum"]).otherwise(acc["sum"] + change)
            counts = F.transform(acc["counts"], lambda c, k: c + F.when(k == enter - 1, 1).otherwise(0) - F.when(k == leave - 1, 1).otherwise(0))
            n = F.size(acc["spans"])
            here = lambda a: F.array(F.struct(a.cast("bigint").alias("a"), i.cast("bigint").alias("b")))
            grown = F.when((n > 0) & (F.get(acc["spans"], n - 1)["b"] >= i - window), F.concat(F.slice(acc["spans"], F.lit(1), n - 1), here(F.get(acc["spans"], n - 1)["a"]))).otherwise(F.concat(acc["spans"], here(i - window)))
            return F.struct(
                F.when(enter == leave, acc["counts"]).otherwise(counts).alias("counts"),
                total.alias("sum"),
                F.when((i > low) & (i >= window) & (total <= most), grown).otherwise(acc["spans"]).alias("spans"),
            )

        zero = F.struct(F.array_repeat(F.lit(0), len(letters)).alias("counts"), F.lit(0).cast("bigint").alias("sum"), F.array().cast(pairs).alias("spans"))
        return F.aggregate(moves, zero, step, lambda acc: acc["spans"])

    def joined(spans: Column) -> Column:
        """Spans of two pieces that touch are one."""
        opens = F.filter(F.sequence(F.lit(0), F.size(spans) - 1), lambda k: (k == 0) | (F.get(spans, k)["a"] > F.get(spans, k - 1)["b"]))
        whole = _bound(opens, lambda opens: F.transform(opens, lambda at, j: F.struct(F.get(spans, at)["a"].alias("a"), F.get(spans, F.coalesce(F.get(opens, j + 1), F.size(spans)) - 1)["b"].alias("b"))))
        return F.when(F.size(spans) > 0, whole).otherwise(F.array().cast(pairs))

    places = F.transform(F.split(run, ""), lambda ch: F.instr(F.lit(letters), ch))
    pieces = lambda places: F.flatten(F.transform(F.sequence(F.lit(0), F.floor((F.size(places) - 1) / PIECE).cast("int")), lambda k: piece(places, k)))
    return _bound(places, lambda places: _bound(pieces(places), joined))


def _entropy(text: Column, kind: str, allowed: tuple[str, ...], window: int) -> Column:
    letters, one, bits = CLASSES[kind]

    def suspect(x: Column) -> Column:
        fine = F.lit(False)
        for pattern in allowed:
            fine = fine | x["match"].rlike(pattern)
        return ~fine

    runs = F.filter(located(text, f"{one}{{{window},}}"), suspect)
    spans = F.transform(runs, lambda r: F.transform(high_entropy(r["match"], letters, bits, window), lambda s: _span(r["start"] + s["a"], kind, r["start"] + s["b"])))
    return F.flatten(spans)


def _listed(spans: Column) -> Column:
    """kind:start:end of the spans, by start and then kind, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def scan(docs: DataFrame, allowed: tuple[str, ...] = ALLOWED, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, n_entropy, base_sha256, spans, base, found), a row for each row of docs.

    Takes doc_id and text; a null text is empty. base and found are arrays of (start, kind, end): kind is an index into
    KINDS, places are code points, end exclusive. found are the entropy spans that no base span overlaps. Rows with
    equal ids are scanned each; an empty table gives no rows. Other columns are ignored.
    """
    text = F.col("text")
    rows = plain(docs, "doc_id", "text").withColumn("text", F.coalesce("text", F.lit("")))
    when = lambda hint, spans: F.when(text.rlike(hint), spans).otherwise(_none())
    value = lambda x: F.length(F.regexp_extract(x["match"], ASSIGN, 2)) >= 6
    rows = rows.withColumns({
        "assign": when(ASSIGN_HINT, _rule(text, "assign", ASSIGN, value)),
        "access": when(ACCESS, _rule(text, "access", ACCESS)),
        "hex": when(HEX, _rule(text, "hex", HEX)),
        "entropy": F.concat(*(when(f"{CLASSES[k][1]}{{{window},}}", _entropy(text, k, allowed, window)) for k in CLASSES)),
    })
    rows = rows.withColumn("base", F.concat("assign", "access", "hex"))
    rows = rows.withColumn("found", F.filter("entropy", lambda e: ~F.exists("base", lambda b: (b["start"] < e["end"]) & (e["start"] < b["end"]))))
    rows = rows.withColumn("found", F.filter("found", lambda e: (e["kind"] == 3) | ~F.exists("found", lambda b: (b["kind"] == 3) & (b["start"] < e["end"]) & (e["start"] < b["end"]))))
    count = lambda c: F.size(c).cast("bigint")
    return rows.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"), count("found").alias("n_entropy"),
        F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(F.concat("base", "found")).alias("spans"), "base", "found",
    )


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """scan of all documents, without the span arrays."""
    return scan(table(spark, sf_dir, "documents")).drop("base", "found")
